"""Traversals: one frontier kernel, and the operators that configure it.

A level joins the frontier with the edges, drops what was visited and keeps one way into each
new node: the first by (parent, direction, relation, edge order). Every operator takes a batch
of seeds; state is keyed by seed, so a batch costs as many shuffles as one seed. Each level is
written to the checkpoint folder, which keeps plans short and makes a lost executor cost one
level.

Edges may be stored as they are walked (`store_walks`): once by source and once by target, in
buckets and sorted, the edges of hubs salted. A small frontier then reads its own buckets and
pages of them; a large one is shuffled to the buckets, while the edges stay where they are.
That pays for many walks of one graph. A graph without stored walks is read where its edges come
from: a frontier's ids are a filter or a broadcast semi-join, which Spark takes below the edges'
own aggregation, and only a large frontier makes it shuffle edges, and of these only the parts
(`Graph.parts`) that can start in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.identity import ascii_lower, normalize_label
from weftline.plans.lineage import cut

# Which relations carry which question.
AFFECTED_RELATIONS = ("calls", "references", "imports", "imports_from", "inherits", "extends", "implements", "uses")
MEMBER_RELATIONS = ("contains", "method")
IMPACT_RELATIONS = (*AFFECTED_RELATIONS, "deploys", "reads", "configures", "exposes")
CONFIDENCE_RANK = {"EXTRACTED": 0, "SYNTACTIC": 1, "INFERRED": 2, "AMBIGUOUS": 3}
TEST_PATH = r"\.(test|spec)\.|/test/|/tests/|/__tests__/"
EDGE_ORDER = ("source", "target", "relation", "context")
#: Up to this many frontier rows are broadcast to the edges; beyond, they are shuffled to their buckets.
BROADCAST_FRONTIER = 100_000
#: Up to this many frontier rows are fetched, so that only their nodes' edges are read.
SEEK = 1_000
#: A frontier of up to so many rows is stepped from without a file, if no more than SEEK rows come of it.
TRY = 100
#: After so many levels what was reached is written as one table, so that plans stay short.
FOLD = 32
#: Nodes with more edges are hubs, whose edges are dealt to SALTS buckets.
HUB, SALTS = 100_000, 16
#: Up to this many hubs are broadcast; there are no more than edges / HUB.
BROADCAST_HUBS = 100_000
#: Edges are first counted by so many hash bins of their nodes, when hubs are looked for.
BINS = 1 << 16
#: Up to this many ends that are no nodes are broadcast.
BROADCAST_LOOSE = 100_000


@dataclass(frozen=True)
class Walks:
    """The edges with salt and known (whether the end walked to is a node), bucketed by (source, salt) and by (target, salt); and the hubs (node)."""

    out: DataFrame
    back: DataFrame
    hubs: DataFrame

    def of(self, direction: str) -> list[DataFrame]:
        """(from, to, dir, relation, confidence, context, salt, known); dir 0 is along the edge, 1 against it."""
        along, against = _ends(self.out, False, "salt", "known"), _ends(self.back, True, "salt", "known")
        return {"out": [along], "in": [against], "both": [along, against]}[direction]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    walks: Walks | None = None
    #: The edges in parts by the prefixes of their ends' ids: (source's, target's, edges). No prefix begins another; one part with empty ones if not told.
    parts: tuple[tuple[str, str, DataFrame], ...] = ()

    def cached(self) -> Graph:
        return Graph(self.nodes.persist(), self.edges.persist(), self.walks)


def _ends(edges: DataFrame, back: bool, *more: str) -> DataFrame:
    a, b = ("target", "source") if back else ("source", "target")
    return edges.select(F.col(a).alias("from"), F.col(b).alias("to"), F.lit(int(back)).alias("dir"), "relation", "confidence", "context", *more)


def store_walks(g: Graph, buckets: int, name: str, folder: str) -> Graph:
    """g with its edges written as they are walked, as tables name_out and name_back below the folder."""
    spark, columns, found, hubs = g.edges.sparkSession, g.edges.columns, [], []
    every = cut(g.edges)  # read again for hubs, loose ends and either side
    loose = cut(every.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(g.nodes.select("id"), "id", "left_anti"))
    n_loose = loose.count()
    for side, a, b in (("out", "source", "target"), ("back", "target", "source")):
        edges = every if side == "out" else every.select("source", "target", "relation", "confidence", "context")
        hub = cut(hubs_of(every, a))
        few = hub.count()
        if few:
            mine = hub.select(F.col("node").alias(a), F.lit(True).alias("hub"))
            edges = edges.join(F.broadcast(mine) if few <= BROADCAST_HUBS else mine, a, "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64(b), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hub")
        else:
            edges = edges.withColumn("salt", F.lit(0))
        if n_loose:
            ends = loose.select(F.col("id").alias(b), F.lit(False).alias("known"))
            edges = edges.join(F.broadcast(ends) if n_loose <= BROADCAST_LOOSE else ends, b, "left").withColumn("known", F.col(b).isNotNull() & F.coalesce("known", F.lit(True)))
        else:
            edges = edges.withColumn("known", F.col(b).isNotNull())
        table = f"{name}_{side}"
        edges.repartition(buckets, a, "salt").write.bucketBy(buckets, a, "salt").sortBy(a, "salt").format("parquet").option("path", f"{folder}/{table}").saveAsTable(table)
        found.append(spark.table(table))
        hubs.append(hub)
    return Graph(g.nodes, found[0].select(*columns), Walks(found[0], found[1], hubs[0].unionByName(hubs[1]).distinct()))


def hubs_of(edges: DataFrame, end: str) -> DataFrame:
    """(node): those with more than HUB edges at that end. Nodes are counted only in the few hash bins that hold as many edges."""
    bin_of = F.pmod(F.xxhash64(end), F.lit(BINS)).alias("bin")
    full = edges.groupBy(bin_of).agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("bin")
    some = edges.select(end, bin_of).join(F.broadcast(full), "bin", "left_semi")  # no more than BINS
    return some.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > HUB).select(F.col(end).alias("node"))


def _order() -> Column:
    """The edge's own order, from a row as it is walked."""
    along = F.col("dir") == 0
    a, b = F.col("from"), F.col("to")
    return F.struct(F.when(along, a).otherwise(b).alias("source"), F.when(along, b).otherwise(a).alias("target"), F.col("relation"), F.col("context")).alias("ord")


class Walk:
    """Some edges of a graph in a direction, to be walked level by level."""

    def __init__(self, g: Graph, direction: str, only: Column | None = None, check: bool = True):
        keep = F.lit(True) if only is None else only
        self.stored = g.walks is not None
        if self.stored:
            self.tables, self.hubs = [t.where(keep) for t in g.walks.of(direction)], g.walks.hubs
            return
        self.ids = g.nodes.select("id") if check else None
        sides = {"out": [False], "in": [True], "both": [False, True]}[direction]
        ends = [(part[back], _ends(part[2].where(keep), back)) for part in g.parts or (("", "", g.edges),) for back in sides]
        self.prefixes, self.tables = [p for p, _ in ends], [t for _, t in ends]

    def where(self, keep) -> Walk:
        """The walk on what keep makes of its tables."""
        out = object.__new__(Walk)
        out.__dict__ |= self.__dict__ | {"tables": [keep(t) for t in self.tables]}
        return out

    def step(self, level: DataFrame) -> tuple[int, DataFrame]:
        """Rows of level (node, ...), and those rows joined with what is walked from their nodes: (..., from, to, dir, relation, confidence, ord, known)."""
        few = level.limit(SEEK + 1).collect()
        names = [c for c in level.columns if c != "node"]
        if not few:
            return 0, level
        if not self.stored:
            n, rows = self._read(level, few)
            rows = [r.withColumn("known", F.lit(True)) for r in rows]
        else:
            n = len(few) if len(few) <= SEEK else level.count()
            if n <= SEEK:
                rows = [_sought(table, few, level) for table in self.tables]
            elif n <= BROADCAST_FRONTIER:
                rows = [table.join(F.broadcast(level.withColumnRenamed("node", "from")), "from") for table in self.tables]
            else:
                rows = [salted(table, level, self.hubs) for table in self.tables]
        out = None
        for r in rows:
            r = r.select(*names, "from", "to", "dir", "relation", "confidence", _order(), "known")
            out = r if out is None else out.unionByName(r)
        return n, out

    def _read(self, level: DataFrame, few: list) -> tuple[int, list[DataFrame]]:
        """Rows of level, and what its nodes of each prefix meet in the tables of that prefix; few are its rows if there are no more than SEEK."""
        prefixes, found = sorted(set(self.prefixes)), []
        if len(few) <= SEEK:
            n, counts = len(few), [sum((r["node"] or "").startswith(p) for r in few) for p in prefixes]
        else:
            n, *counts = level.agg(F.count("*"), *[F.count_if(F.startswith("node", F.lit(p))) for p in prefixes]).first()
        for p, count in zip(prefixes, counts, strict=True):
            if not count:
                continue
            mine = level.where(F.startswith("node", F.lit(p)))
            if count <= SEEK:
                some = [r for r in few if (r["node"] or "").startswith(p)] if n <= SEEK else mine.collect()
            for table in (t for t, q in zip(self.tables, self.prefixes, strict=True) if q == p):
                if count <= SEEK:
                    found.append(_sought(table, some, level))
                    continue
                ends = mine.withColumnRenamed("node", "from")
                if count <= BROADCAST_FRONTIER:
                    found.append(table.join(F.broadcast(ends.select("from").distinct()), "from", "left_semi").join(F.broadcast(ends), "from"))
                else:
                    found.append(table.join(ends, "from"))
        return n, found or [_sought(self.tables[0], [], level)]

    def known(self, new: DataFrame, few: list | None) -> tuple[DataFrame, list | None]:
        """new (node, ..., known), few being its rows if they are with the driver, with what is known of whether each node is one."""
        if self.stored or self.ids is None:
            return new, few
        asked = lambda ids: self.ids.where(F.col("id").isin(sorted(ids)))
        if few is not None:
            real = {r["id"] for r in asked({r["node"] for r in few if r["node"] is not None}).collect()} if few else set()
            few = [(*[r[c] for c in new.columns if c != "known"], r["node"] in real) for r in few]
            schema = new.select(*[c for c in new.columns if c != "known"], "known").schema
            return new.sparkSession.createDataFrame(few, schema).select(*new.columns), few
        nodes = new.select(F.col("node").alias("id")).distinct()
        real = self.ids
        if new.count() <= BROADCAST_FRONTIER:
            real = F.broadcast(real.join(F.broadcast(nodes), "id", "left_semi"))
        real = real.select(F.col("id").alias("node"), F.lit(True).alias("_real"))
        return cut(new.join(real, "node", "left").withColumn("known", F.coalesce("_real", F.lit(False))).select(*new.columns)), None


def _sought(table: DataFrame, few: list, level: DataFrame) -> DataFrame:
    """Rows of a table from the nodes of a few rows of level, which become a filter of the table."""
    here = level.sparkSession.createDataFrame(few, level.schema).withColumnRenamed("node", "from")
    return table.where(F.col("from").isin(sorted({r["node"] for r in few if r["node"] is not None}))).join(F.broadcast(here), "from")


def _kept(new: DataFrame, n: int) -> tuple[DataFrame, list | None]:
    """new, which came of n rows, free of its lineage: as rows of the driver if those are few, else as a file; and those rows."""
    if n <= TRY:
        few = new.limit(SEEK + 1).collect()
        if len(few) <= SEEK:
            return new.sparkSession.createDataFrame(few, new.schema), few
    return cut(new), None


def salted(table: DataFrame, level: DataFrame, hubs: DataFrame) -> DataFrame:
    """The rows of a stored table from the nodes of level; a hub's row of level goes to each salt."""
    hubs = hubs.select(F.col("node"), F.lit(True).alias("_hub"))
    level = level.join(F.broadcast(hubs) if hubs.count() <= BROADCAST_HUBS else hubs, "node", "left")
    salts = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return table.join(level.withColumn("salt", F.explode(salts)).drop("_hub").withColumnRenamed("node", "from"), ["from", "salt"])


def first_way() -> Column:
    """The first way into a node, of rows as step() gives them."""
    return F.min_by(F.struct(F.col("from").alias("parent"), "dir", "relation", "confidence"), F.struct("from", "dir", "relation", "ord"))


def frontier(walk: Walk, seeds: DataFrame, depth: int | None, expand_unknown: bool = True, ways: bool = True) -> DataFrame:
    """(seed, node, depth, parent, dir, relation, confidence, known) of every node reached from seeds (seed, node), seeds at depth 0.

    Ids without a node are reported but, unless expand_unknown, not expanded; seeds are expanded
    anyway. Without ways, parent to confidence are null, and a level is aggregated by hash, not by sort.
    """
    no_way = [F.lit(None).cast(t).alias(c) for c, t in (("parent", "string"), ("dir", "int"), ("relation", "string"), ("confidence", "string"))]
    level, _ = _kept(seeds.select("seed", "node").distinct(), 0)
    reached = level.select("seed", "node", F.lit(0).alias("depth"), *no_way, F.lit(True).alias("known"))
    d = 0
    while depth is None or d < depth:
        d += 1
        n, found = walk.step(level)
        if not n:
            break
        found = found.withColumnRenamed("to", "node").join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        if ways:
            new = found.groupBy("seed", "node").agg(first_way().alias("way"), F.max("known").alias("known")).select("seed", "node", F.lit(d).alias("depth"), "way.*", "known")
        else:
            new = found.groupBy("seed", "node").agg(F.max("known").alias("known")).select("seed", "node", F.lit(d).alias("depth"), *no_way, "known")
        new, few = walk.known(*_kept(new, n))
        if few is not None and not few:
            break
        reached = reached.unionByName(new)
        reached = reached if d % FOLD else cut(reached)
        level = (new if expand_unknown else new.where("known")).select("seed", "node")
    return reached


def closure(walk: Walk, seeds: DataFrame) -> DataFrame:
    """(seed, node): everything reachable, seeds included; the generic fixpoint."""
    return frontier(walk, seeds, None, ways=False).select("seed", "node")


def member_closure(g: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, node): modules with all they contain, other seeds alone."""
    modules = seeds.join(g.nodes.where("kind = 'module'").select(F.col("id").alias("seed")), "seed", "left_semi").select("seed", F.col("seed").alias("node"))
    inside = closure(Walk(g, "out", F.col("relation").isin(*MEMBER_RELATIONS), check=False), modules)
    return inside.unionByName(seeds.select("seed", F.col("seed").alias("node"))).distinct()


def affected(g: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node, depth, via_relation): what breaks if a seed changes, at its least depth.

    Against edges of AFFECTED_RELATIONS that are not AMBIGUOUS. Seeds (seed) that are modules
    start from their members; starting nodes are not reported, nor are ids without a node, which
    are not walked through either.
    """
    sure = F.col("relation").isin(*AFFECTED_RELATIONS) & (F.col("confidence") != "AMBIGUOUS")
    hits = frontier(Walk(g, "in", sure), member_closure(g, seeds), depth, expand_unknown=False)
    return hits.where("depth > 0 and known").select("seed", "node", "depth", F.col("relation").alias("via_relation"))


def like_pattern(q: str) -> str:
    return f"%{q}%"


def find_by_label(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Nodes whose label is the query (ASCII case apart); else the `limit` shortest that are LIKE it, those equal when normalised if any."""
    lower = ascii_lower(F.col("label"))
    q = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    exact = nodes.where(lower == q)
    if not exact.isEmpty():
        return exact
    near = nodes.where(lower.like(like_pattern(q))).orderBy(F.length("label"), "id").limit(limit)
    same = near.where(normalize_label(F.col("label")) == normalize_label(F.lit(query)))
    return near if same.isEmpty() else same


def resolve_seed(nodes: DataFrame, query: str) -> DataFrame:
    """The node of that id, else the first by label, else none."""
    by_id = nodes.where(F.col("id") == query)
    return by_id if not by_id.isEmpty() else find_by_label(nodes, query).orderBy("id").limit(1)


def shortest_paths(g: Graph, pairs: DataFrame, max_hops: int = 8) -> DataFrame:
    """(seed, target, hops, steps): an undirected shortest path for each pair (seed, target), if there is one in max_hops.

    Both ends are searched, a level at a time and the smaller frontier first, until they meet.
    Of several shortest paths the one stays that comes first by (parent, direction, relation,
    edge order) from the target back: all nodes at which the searches meet are followed to the
    target by the levels of its search, which makes every shortest path's ways known. steps is an
    array of (from, to, relation, confidence), relation and confidence being the stored edge's;
    steps with an endpoint that is no node are left out of it.
    """
    walk, pairs = Walk(g, "both", check=False), pairs.distinct()
    pairs, _ = _kept(pairs.withColumn("pair", F.struct("seed", "target")), 0)
    way = [F.lit(None).cast(t).alias(c) for c, t in (("parent", "string"), ("dir", "int"), ("relation", "string"), ("confidence", "string"))]
    sides = [pairs.select("pair", F.col(end).alias("node"), F.lit(0).alias("depth"), *way) for end in ("seed", "target")]
    levels, deep, met = [s.select("pair", "node") for s in sides], [0, 0], None
    while True:
        # all searches have gone as far, so those that meet do so at this depth, and at every node of it on a shortest path
        ends = levels[0].withColumn("side", F.lit(0)).unionByName(levels[1].withColumn("side", F.lit(1)))
        ends = ends.groupBy("pair", "node").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        state = ends.groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(F.expr("n0 > 0 and n1 > 0")).alias("met"))
        state, _ = _kept(state, 0)
        sums = state.agg(*[F.sum(F.when(F.expr("met = 0 and n0 > 0 and n1 > 0"), F.col(c))) for c in ("n0", "n1")], F.sum("met")).first()
        if sums[2]:
            now = levels[0].join(levels[1], ["pair", "node"]).withColumns({"hops": F.lit(sum(deep)), "left": F.lit(deep[1])})
            now, _ = _kept(now, 0)
            met = now if met is None else met.unionByName(now)
        if sums[0] is None or sum(deep) == max_hops:
            break
        i = 0 if sums[0] <= sums[1] else 1
        going = state.where("met = 0 and n0 > 0 and n1 > 0").select("pair")
        levels = [x.join(going, "pair", "left_semi") for x in levels]
        n, found = walk.step(levels[i])
        found = found.withColumnRenamed("to", "node").join(sides[i].select("pair", "node"), ["pair", "node"], "left_anti")
        deep[i] += 1
        if i:  # the way back is found later, and only where the searches meet
            new = found.select("pair", "node").distinct().select("pair", "node", F.lit(deep[i]).alias("depth"), *way)
        else:
            new = found.groupBy("pair", "node").agg(first_way().alias("way")).select("pair", "node", F.lit(deep[i]).alias("depth"), "way.*")
        new, _ = _kept(new, n)
        sides[i], levels[i] = sides[i].unionByName(new), new.select("pair", "node")
    if met is None:
            return pairs.select("seed", "target", F.lit(0).alias("hops"), F.array().cast("array<struct<from:string,to:string,relation:string,confidence:string>>").alias("steps")).where("false")
    ways = sides[0].where("depth > 0").select("pair", "node", "parent", "relation", "confidence")
    level = met.select("pair", "node", "left")
    for _ in range(deep[1]):
        n, found = walk.step(level.where("left > 0"))
        if not n:
            break
        back = sides[1].select("pair", F.col("node").alias("to"), (F.col("depth") + 1).alias("left"))
        found = found.join(back, ["pair", "to", "left"], "left_semi").withColumnRenamed("to", "node")
        new = found.groupBy("pair", "node", "left").agg(first_way().alias("way")).select("pair", "node", (F.col("left") - 1).alias("left"), "way.parent", "way.relation", "way.confidence")
        new, _ = _kept(new, n)
        ways = ways.unionByName(new.drop("left"))
        level = new.select("pair", "node", "left")
    path = met.select("pair", "hops").distinct().withColumns({"at": F.col("pair.target"), "steps": F.array().cast("array<struct<from:string,to:string,relation:string,confidence:string>>")})
    up = ways.withColumnRenamed("node", "at")
    for _ in range(sum(deep)):  # from the target back to the seed
        path = path.join(up, ["pair", "at"], "left")
        step = F.array(F.struct(F.col("parent").alias("from"), F.col("at").alias("to"), "relation", "confidence"))
        path = path.withColumn("steps", F.when(F.col("parent").isNull(), F.col("steps")).otherwise(F.concat(step, "steps")))
        path = path.withColumn("at", F.coalesce("parent", "at")).drop("parent", "relation", "confidence")
    path, _ = _kept(path, 0)
    flat = path.select("pair", F.posexplode("steps").alias("i", "s"))
    ends = flat.select(F.explode(F.array("s.from", "s.to")).alias("id")).distinct()
    real, _ = _kept(g.nodes.select("id").join(ends, "id", "left_semi"), 0)
    kept = flat.join(real, F.col("s.from") == real["id"], "left_semi").join(real, F.col("s.to") == real["id"], "left_semi")
    kept = kept.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("k")).select("pair", F.transform("k", lambda x: x["s"]).alias("steps"))
    out = path.select("pair", "hops").join(kept, "pair", "left")
    return out.select("pair.seed", "pair.target", "hops", F.coalesce("steps", F.array().cast(kept.schema["steps"].dataType)).alias("steps"))


def impact(g: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node, depth): all nodes within `depth` steps over IMPACT_RELATIONS in either direction, the seed included."""
    real = seeds.join(g.nodes.select(F.col("id").alias("seed")), "seed", "left_semi").select("seed", F.col("seed").alias("node"))
    hits = frontier(Walk(g, "both", F.col("relation").isin(*IMPACT_RELATIONS)), real, depth, expand_unknown=False, ways=False)
    return hits.where("known").select("seed", "node", "depth")


def impact_categories(g: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, category, value): distinct files, tests among them, and ids of services and configs."""
    hit = impact(g, seeds, depth).join(g.nodes.withColumnRenamed("id", "node"), "node")
    file = hit.where("source_file <> ''")
    rows = file.select("seed", F.lit("file").alias("category"), F.col("source_file").alias("value"))
    rows = rows.unionByName(file.where(F.col("source_file").rlike(TEST_PATH)).select("seed", F.lit("test").alias("category"), F.col("source_file").alias("value")))
    rows = rows.unionByName(hit.where("kind = 'service'").select("seed", F.lit("service").alias("category"), F.col("node").alias("value")))
    rows = rows.unionByName(hit.where("file_type = 'config' or kind = 'config'").select("seed", F.lit("config").alias("category"), F.col("node").alias("value")))
    return rows.distinct()


def reachable(g: Graph, entries: DataFrame, direction: str = "forward") -> DataFrame:
    """(id, reached) of every node, from entries (id), over all relations and without a depth."""
    ids = g.nodes.select("id")
    start = entries.join(ids, "id", "left_semi").select(F.lit("all").alias("seed"), F.col("id").alias("node"))
    walk = Walk(g, "out" if direction == "forward" else "in")
    hit = frontier(walk, start, None, expand_unknown=False, ways=False).select(F.col("node").alias("id"), F.lit(True).alias("reached"))
    return ids.join(hit, "id", "left").select("id", F.coalesce("reached", F.lit(False)).alias("reached"))


def coverage(flags: DataFrame) -> DataFrame:
    """(reachable, unreachable, total, coverage): counts, and the share as a rounded percentage; 100 of an empty graph."""
    n, hit = F.count("*"), F.count_if("reached")
    share = F.when(n == 0, F.lit(100)).otherwise(F.floor(hit * 100 / n + 0.5)).cast("long")
    return flags.agg(hit.alias("reachable"), (n - hit).alias("unreachable"), n.alias("total"), share.alias("coverage"))


def source_sink_paths(g: Graph, sources: DataFrame, sinks: DataFrame, max_hops: int = 20) -> DataFrame:
    """(source, sink, hops, path, relations, confidences, weakest): each way from a source's tree into a sink.

    A forward tree grows from every source; an edge from a node of it into a sink gives a path.
    Sinks are neither walked through nor marked, but for a sink that is the source. A sink need
    not be a node; other ids that are none are not walked through. weakest is a path's weakest
    confidence.
    """
    ids = g.nodes.select("id")
    sinks, sources = cut(sinks.select("id").distinct()), sources.join(ids, "id", "left_semi").select("id").distinct()
    walk = Walk(g, "out").where(lambda t: t.join(sinks.withColumnRenamed("id", "to"), "to", "left_anti"))
    start = sources.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    tree = cut(frontier(walk, start, max_hops - 1, expand_unknown=False))
    against = Walk(g, "in", check=False)
    n, into = against.step(sinks.withColumnRenamed("id", "node"))
    if n:
        into = into.select(F.col("to").alias("node"), F.col("from").alias("sink"), F.col("relation").alias("r"), F.col("confidence").alias("c"))
        into = cut(into)
    else:
        into = sinks.select(*[F.col("id").alias(c) for c in ("node", "sink", "r", "c")])
    depth = tree.agg(F.max("depth")).first()[0] or 0
    last = tree.where("known").join(into, "node")
    last = cut(last.select("depth", "seed", "node", "sink", F.array("node", "sink").alias("path"), F.array("r").alias("relations"), F.array("c").alias("confidences")))
    level = last.where(F.col("depth") == depth).drop("depth")
    for d in range(depth, 0, -1):  # from the last node back to the source; only what ends in a sink is followed
        up = tree.where(F.col("depth") == d).select("seed", "node", "parent", "relation", "confidence")
        put = lambda c, xs: F.concat(F.array(c), xs).alias(xs)
        level = level.join(up, ["seed", "node"]).select("seed", F.col("parent").alias("node"), "sink", put("parent", "path"), put("relation", "relations"), put("confidence", "confidences"))
        level = cut(level.unionByName(last.where(F.col("depth") == d - 1).drop("depth")))
    out = level.select(F.col("seed").alias("source"), "sink", (F.size("path") - 1).alias("hops"), "path", "relations", "confidences")
    return out.withColumn("weakest", weakest(F.col("confidences")))


def confidence_rank(c: Column) -> Column:
    rank = F.lit(3)
    for name, r in CONFIDENCE_RANK.items():
        rank = F.when(c == name, r).otherwise(rank)
    return rank


def weakest(confidences: Column) -> Column:
    names = F.array(*[F.lit(n) for n in sorted(CONFIDENCE_RANK, key=CONFIDENCE_RANK.get)])
    return F.element_at(names, F.array_max(F.transform(confidences, confidence_rank)) + 1)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (id)."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)


def neighbourhood(g: Graph, seeds: DataFrame, depth: int = 2, max_nodes: int = 40) -> DataFrame:
    """(id, depth): undirected breadth-first visit from seeds (id, rank), cut at max_nodes in visiting order.

    Order is by depth, then parent's place, then along before against edges, then edge order.
    The frontier never exceeds max_nodes rows, so its one-row-group window is bounded.
    """
    walk = Walk(g, "both", check=False)
    seen = cut(seeds.select("id", F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("rank")).cast("long").alias("place")).where(F.col("place") <= max_nodes))
    level = seen
    for d in range(1, depth + 1):
        n = seen.count()
        if n >= max_nodes or level.isEmpty():
            break
        found = walk.step(level.select(F.col("id").alias("node"), F.col("place").alias("parent")))[1].join(F.broadcast(seen.select(F.col("id").alias("to"))), "to", "left_anti")
        new = found.groupBy("to").agg(F.min(F.struct("parent", "dir", "ord")).alias("first")).orderBy("first", "to").limit(max_nodes - n)
        level = cut(new.select(F.col("to").alias("id"), F.lit(d).alias("depth"), (F.row_number().over(Window.orderBy("first", "to")) + n).cast("long").alias("place")))
        seen = seen.unionByName(level)
    return seen.select("id", "depth", "place")
