"""Resolution of calls to definitions by a ladder of evidence, heritage re-targeting, dedup and upserts.

A call needs only counts and the first two ids of its candidates, so definitions are grouped by
label, by label and file, and by label and module before calls meet them. Homonyms therefore
never multiply the calls, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.identity import normalize_label
from weftline.plans.lineage import cut

DEFINABLE = ("function", "method", "class", "interface")
HERITAGE = ("inherits", "implements", "extends")
MOST = 4  # more candidates than this drop the call
#: Up to this many different (callee, file, receiver) that may resolve, or names that are called, are broadcast.
BROADCAST_KEYS = 200_000
CONFIDENCE_WEIGHT = {"EXTRACTED": 3, "INFERRED": 2}
KIND = "\0"  # between a candidate's id and its kind, so that candidates sort by id
EDGE_KEY = ("source", "target", "relation", "context")


def module_stem(module: Column) -> Column:
    """The last non-empty part of a module path, cut at dots and slashes, in lower case."""
    return F.lower(F.element_at(F.filter(F.split(module, r"[./\\]"), lambda x: x != ""), -1))


def file_stem(file: Column) -> Column:
    """The base name without its last extension, in lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(file, r"[/\\]"), -1), r"\.[^.]*$", ""))


def module_matches_file(module: Column, file: Column) -> Column:
    return F.coalesce(module_stem(module) == file_stem(file), F.lit(False))


def definitions(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*DEFINABLE)).select("id", normalize_label(F.col("label")).alias("name"), "source_file", "kind")


def _first_two(defs: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """keys, count, and the two smallest candidates of each group: ids with their kinds."""
    defs = defs.select(*keys, F.concat("id", F.lit(KIND), "kind").alias("c"))
    one = defs.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_n"), F.min("c").alias(f"{prefix}_1"))
    rest = defs.join(one.where(F.col(f"{prefix}_n") > 1).select(*keys, F.col(f"{prefix}_1").alias("_1")), keys).where(F.col("c") > F.col("_1"))
    return one.join(rest.groupBy(*keys).agg(F.min("c").alias(f"{prefix}_2")), keys, "left")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def last_imports(imports: DataFrame) -> DataFrame:
    """(source_file, local_name, module): the last binding of a name in a file wins."""
    return imports.groupBy("source_file", "local_name").agg(F.max_by("module", "ord").alias("module"))


def method_owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, owner): the normalised label of each method's owner, by its last `method` edge."""
    name = nodes.select(F.col("id").alias("source"), normalize_label(F.col("label")).alias("owner"))
    return edges.where("relation = 'method'").join(name, "source").groupBy(F.col("target").alias("id")).agg(F.max_by("owner", F.struct("source", "context")).alias("owner"))


def resolve_calls(nodes: DataFrame, edges: DataFrame, calls: DataFrame, imports: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """The edge of each call that resolves: (source, target, relation, confidence, context, source_file, weight, rung).

    calls: callee, from_id, source_file, receiver_type. imports: source_file, local_name,
    module, ord. scope: (source_file); definitions outside it count only for labels that have
    none inside. Ties go to the smallest id. Candidates are looked up for the different
    (callee, file, receiver), not for the calls, and only among definitions of called names.
    Calls that may resolve are then joined twice: with what was found, and with their own
    callers' definitions.
    """
    defs = definitions(nodes)
    if scope is not None:
        inside = defs.join(scope.select("source_file").distinct(), "source_file", "left_semi")
        named = inside.select("name").distinct()
        defs = inside.unionByName(defs.join(named, "name", "left_anti").select(*inside.columns))
    asked = ["callee", "source_file", "receiver_type"]
    keys = cut(calls.select(*asked).distinct().withColumns({"name": normalize_label(F.col("callee")), "receiver": normalize_label(F.col("receiver_type"))}))
    called = cut(keys.select("name").distinct())
    defs = defs.join(_small(called), "name", "left_semi")
    self_def = defs.select(F.col("id").alias("from_id"), "name", F.col("source_file").alias("own_file"), F.lit(1).alias("own"))
    bound = last_imports(imports).select("source_file", normalize_label(F.col("local_name")).alias("name"), "module", module_stem(F.col("module")).alias("stem")).dropDuplicates(["source_file", "name"])
    keys = keys.join(_first_two(defs, ["name"], "all"), "name")
    keys = keys.join(_first_two(defs, ["name", "source_file"], "file"), ["name", "source_file"], "left")
    keys = keys.join(bound, ["name", "source_file"], "left")
    keys = keys.join(_first_two(defs.withColumn("stem", file_stem(F.col("source_file"))), ["name", "stem"], "mod"), ["name", "stem"], "left")
    owned = defs.join(method_owners(nodes, edges), "id").select("id", "kind", "name", F.col("owner").alias("receiver"))
    keys = keys.join(_first_two(owned, ["name", "receiver"], "own_by"), ["name", "receiver"], "left").withColumnsRenamed({c: "_" + c for c in asked})
    few = lambda c, most: F.col(c).between(1, most + 1)  # noqa: E731  # one of them may be the caller itself
    keys = cut(keys.where(F.col("own_by_1").isNotNull() | few("file_n", MOST) | few("all_n", MOST) | F.col("module").isNotNull() & few("mod_n", 1)))
    rows = calls.join(_small(keys), [calls[c].eqNullSafe(keys["_" + c]) for c in asked]).join(self_def, ["from_id", "name"], "left")
    self_id = F.concat("from_id", F.lit(KIND))

    def but_self(prefix: str, applies: Column) -> tuple[Column, Column]:
        """Count and first id of the group without the caller itself."""
        mine = F.coalesce(applies, F.lit(False)) & F.col("own").isNotNull()
        n = F.coalesce(F.col(f"{prefix}_n"), F.lit(0)) - mine.cast("int")
        return n, F.when(mine & F.startswith(F.col(f"{prefix}_1"), self_id), F.col(f"{prefix}_2")).otherwise(F.col(f"{prefix}_1"))

    n_all, first_all = but_self("all", F.lit(True))
    n_file, first_file = but_self("file", F.col("own_file") == F.col("source_file"))
    n_mod, first_mod = but_self("mod", file_stem(F.col("own_file")) == F.col("stem"))
    first_own = F.when(F.startswith(F.col("own_by_1"), self_id), F.col("own_by_2")).otherwise(F.col("own_by_1"))
    pick = lambda rung, target, confidence: F.struct(F.lit(rung).alias("rung"), target.alias("target"), F.lit(confidence).alias("confidence"))
    imported = F.col("module").isNotNull()
    choice = (
        F.when(first_own.isNotNull(), pick("receiver", first_own, "EXTRACTED"))
        .when(n_file == 1, pick("same_file", first_file, "EXTRACTED"))
        .when(n_file.between(2, MOST), pick("same_file", first_file, "AMBIGUOUS"))
        .when(n_file > MOST, F.lit(None))
        .when(imported & (n_all == 1), pick("import", first_all, "EXTRACTED"))
        .when(imported & (n_mod == 1), pick("module", first_mod, "EXTRACTED"))
        .when(n_all == 1, pick("name", first_all, "INFERRED"))
        .when(n_all.between(2, MOST), pick("name", first_all, "AMBIGUOUS"))
    )
    rows = rows.withColumn("c", choice).where(F.col("c").isNotNull() & F.col("c.target").isNotNull())
    target, kind = F.substring_index("c.target", KIND, 1), F.substring_index("c.target", KIND, -1)
    relation = F.when(kind.isin("class", "interface"), "references").otherwise("calls")
    return rows.select(F.col("from_id").alias("source"), target.alias("target"), relation.alias("relation"), F.col("c.confidence").alias("confidence"), F.lit("").alias("context"), "source_file", F.lit(1.0).alias("weight"), F.col("c.rung").alias("rung"))


def retarget_heritage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Heritage edges whose target is no node go to the class or interface of that label: one, EXTRACTED; the first of several, AMBIGUOUS."""
    types = definitions(nodes).where(F.col("kind").isin("class", "interface")).groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    ids = nodes.select(F.col("id").alias("target"), F.lit(True).alias("_known"))
    rows = edges.join(ids, "target", "left")
    loose = F.col("relation").isin(*HERITAGE) & F.col("_known").isNull()
    label = normalize_label(F.element_at(F.split("target", ":"), -1))
    rows = rows.withColumn("name", F.when(loose, label)).join(types, "name", "left")
    return rows.select(*[c for c in edges.columns if c not in ("target", "confidence")], F.coalesce("_first", "target").alias("target"), F.when(F.col("_n") == 1, "EXTRACTED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise(F.col("confidence")).alias("confidence")).select(*edges.columns)


def confidence_weight(c: Column) -> Column:
    w = F.lit(1)
    for name, v in CONFIDENCE_WEIGHT.items():
        w = F.when(c == name, v).otherwise(w)
    return w


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def best_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge a key, the most confident, the first of equals; self-loops go, weights are not summed."""
    rest = [c for c in edges.columns if c not in EDGE_KEY]
    best = F.min_by(F.struct(*rest), F.struct(-confidence_weight(F.col("confidence")), *order))
    return edges.where("source <> target").groupBy(*EDGE_KEY).agg(best.alias("b")).select(*EDGE_KEY, "b.*").select(*edges.columns)


def upsert_nodes(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """old with new's rows, the last of an id winning; a known node keeps its community."""
    cols = [c for c in old.columns if c not in ("id", "community")]
    last = new.groupBy("id").agg(F.max_by(F.struct(*cols, "community"), order).alias("n"))
    both = old.select("id", F.struct(*cols, "community").alias("o")).join(last, "id", "full_outer")
    picked = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
    return both.select("id", *picked, F.when(F.col("o").isNotNull(), F.col("o.community")).otherwise(F.col("n.community")).alias("community")).select(*old.columns)


def upsert_edges(rows: DataFrame, order: str) -> DataFrame:
    """Edges by key: weights add up, confidence is the last row's, source_file and location the first's."""
    return rows.groupBy(*EDGE_KEY).agg(F.sum("weight").alias("weight"), F.max_by("confidence", order).alias("confidence"), F.min_by("source_file", order).alias("source_file"), F.min_by("source_location", order).alias("source_location"))


def update_communities(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """nodes with the communities of assigned (id, community); unknown ids are ignored."""
    return nodes.join(assigned.select("id", F.col("community").alias("_c")), "id", "left").withColumn("community", F.coalesce("_c", "community")).drop("_c").select(*nodes.columns)


def claim_files(results: DataFrame) -> DataFrame:
    """(file, extractor): each file goes to its first extractor by rank that reported no error. results: file, extractor, rank, errors."""
    return results.where("errors = 0").groupBy("file").agg(F.min_by("extractor", "rank").alias("extractor"))


def cache_split(files: DataFrame, cached: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files (path, hash) against cached (path, hash, version, ...); dead paths fall out of both."""
    now = cached.where(F.col("version") == version)
    return now.join(files, ["path", "hash"], "left_semi"), files.join(now, ["path", "hash"], "left_anti")
