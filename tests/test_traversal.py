"""Traversals on small graphs, and against a plain Python walk on random ones."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftline.operators import audit, community, html, stats
from weftline.operators import traversal as t
from weftline.operators.traversal import Graph


def make(spark, nodes, edges):
    n = [(x, x, "function", "code", f"{x}.ts", None) if isinstance(x, str) else x for x in nodes]
    e = [(a, b, r, c, "", "x.ts", None, 1.0) for a, b, r, c in edges]
    return Graph(spark.createDataFrame(n, "id string, label string, kind string, file_type string, source_file string, repo string"), spark.createDataFrame(e, "source string, target string, relation string, confidence string, context string, source_file string, source_location string, weight double"))


def seeds(spark, *ids, name="seed"):
    return spark.createDataFrame([(i,) for i in ids], f"{name} string")


def calls(*pairs, c="EXTRACTED", r="calls"):
    return [(a, b, r, c) for a, b in pairs]


@pytest.mark.parametrize(("edges", "depth", "want"), [
    (calls(("b", "a"), ("c", "b")), 3, {("b", 1), ("c", 2)}),
    (calls(("b", "a"), ("c", "b")), 1, {("b", 1)}),
    (calls(("b", "a"), c="AMBIGUOUS"), 3, set()),
    (calls(("b", "a"), r="contains"), 3, set()),
    (calls(("b", "a"), ("a", "b")), 5, {("b", 1)}),
    (calls(("gone", "a"), ("c", "gone")), 3, set()),
])
def test_affected(spark, edges, depth, want):
    got = t.affected(make(spark, ["a", "b", "c"], edges), seeds(spark, "a"), depth).collect()
    assert {(r["node"], r["depth"]) for r in got} == want


def test_first_edge_names_the_relation(spark):
    g = make(spark, ["a", "b"], calls(("b", "a"), r="uses") + calls(("b", "a"), r="calls"))
    assert t.affected(g, seeds(spark, "a")).first()["via_relation"] == "calls"


def test_modules_start_from_members(spark):
    nodes = [("m", "m", "module", "code", "m", None), ("c", "c", "class", "code", "c", None), "f", "x", "y"]
    g = make(spark, nodes, calls(("m", "c"), r="contains") + calls(("c", "f"), r="method") + calls(("x", "f"), ("y", "m")))
    assert {r["node"] for r in t.affected(g, seeds(spark, "m")).collect()} == {"x", "y"}
    assert {r["node"] for r in t.affected(g, seeds(spark, "c")).collect()} == set()


def test_seed_resolution(spark):
    g = make(spark, [("a", "Open File", "function", "code", "a", None), ("b", "open file", "function", "code", "b", None), ("c", "reopen_file_now", "function", "code", "c", None)], calls(("a", "b")))
    one = lambda q: [r["id"] for r in t.resolve_seed(g.nodes, q).collect()]
    assert one("b") == ["b"] and one("OPEN FILE") == ["a"] and one("file_now") == ["c"] and one("zzz") == []
    assert {r["id"] for r in t.find_by_label(g.nodes, "open_file").collect()} == {"a", "b"} or {r["id"] for r in t.find_by_label(g.nodes, "open_file").collect()} == {"a", "b", "c"}


def test_paths(spark):
    g = make(spark, list("abcdz"), calls(("a", "b"), ("c", "b"), ("c", "d")))
    pairs = spark.createDataFrame([("a", "a"), ("a", "d"), ("a", "z")], "seed string, target string")
    got = {(r["seed"], r["target"]): r for r in t.shortest_paths(g, pairs).collect()}
    assert set(got) == {("a", "a"), ("a", "d")} and got["a", "a"]["steps"] == [] and got["a", "a"]["hops"] == 0
    assert [(s["from"], s["to"]) for s in got["a", "d"]["steps"]] == [("a", "b"), ("b", "c"), ("c", "d")]
    assert t.shortest_paths(g, pairs, 2).where("target = 'd'").count() == 0


def test_steps_leave_out_dangling_ends(spark):
    g = make(spark, ["a", "b"], calls(("a", "gone"), ("gone", "b")))
    r = t.shortest_paths(g, spark.createDataFrame([("a", "b")], "seed string, target string")).first()
    assert r["hops"] == 2 and r["steps"] == []


def test_impact_categories(spark):
    nodes = [("s", "s", "service", "code", "s.ts", None), ("f", "f", "function", "code", "f.ts", None), ("t", "t", "function", "code", "f.test.ts", None), ("k", "k", "config", "config", "k.yml", None)]
    g = make(spark, nodes, calls(("s", "f"), r="deploys") + calls(("t", "f")) + calls(("f", "k"), r="reads"))
    rows = {(r["category"], r["value"]) for r in t.impact_categories(g, seeds(spark, "f")).collect()}
    assert rows == {("file", "s.ts"), ("file", "f.ts"), ("file", "f.test.ts"), ("file", "k.yml"), ("test", "f.test.ts"), ("service", "s"), ("config", "k")}
    assert t.impact(g, seeds(spark, "nobody")).count() == 0


def test_reachability(spark):
    g = make(spark, list("abcd"), calls(("a", "b"), ("b", "c"), ("c", "a")))
    assert t.coverage(t.reachable(g, seeds(spark, "a", name="id"))).first().asDict() == {"reachable": 3, "unreachable": 1, "total": 4, "coverage": 75}
    empty = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert t.coverage(t.reachable(empty, seeds(spark, "a", name="id"))).first()["coverage"] == 100


def plain_paths(nodes, edges, source, sinks, hops):
    """All ways from a breadth-first tree into a sink: (node path)."""
    if source not in nodes:
        return []
    tree, queue, out = {source: (source,)}, deque([source]), []
    while queue:
        n = queue.popleft()
        if len(tree[n]) > hops or n not in nodes:
            continue
        for a, b, *_ in sorted(edges):
            if a == n and b in sinks:
                out.append((*tree[n], b))
            elif a == n and b not in tree:
                tree[b] = (*tree[n], b)
                queue.append(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(24)]
    edges = sorted({(rng.choice([*ids, "ghost"]), rng.choice([*ids, "ghost"]), rng.choice(["calls", "uses", "contains", "reads"]), rng.choice(["EXTRACTED", "AMBIGUOUS", "INFERRED"])) for _ in range(50)})
    g = make(spark, ids, edges)
    got = {(r["seed"], r["node"]): r["depth"] for r in t.affected(g, seeds(spark, *ids), 3).collect()}
    want = {}
    for s in ids:
        dist, queue = {s: 0}, deque([s])
        while queue:
            n = queue.popleft()
            if dist[n] == 3 or n not in ids:
                continue
            for a, b, r, c in edges:
                if b == n and r in t.AFFECTED_RELATIONS and c != "AMBIGUOUS" and a not in dist:
                    dist[a] = dist[n] + 1
                    queue.append(a)
        want |= {(s, n): d for n, d in dist.items() if d and n in ids}
    assert got == want
    sinks = {ids[3], ids[7], "ghost"}
    paths = t.source_sink_paths(g, seeds(spark, *ids[:6], name="id"), seeds(spark, *sinks, name="id"), 20).collect()
    assert sorted((r["source"], r["sink"], r["hops"]) for r in paths) == sorted((s, p[-1], len(p) - 1) for s in ids[:6] for p in plain_paths(set(ids), edges, s, sinks, 20))


def test_partitioning_and_row_order_do_not_matter(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", rng.choice(["calls", "uses"]), "EXTRACTED") for _ in range(90)]
    g = make(spark, [f"n{i:02d}" for i in range(30)], edges)
    h = Graph(g.nodes.repartition(7), g.edges.orderBy(F.desc("target")).repartition(5))
    one = lambda x: sorted(map(tuple, t.affected(x, seeds(spark, "n01", "n02")).collect()))
    assert one(g) == one(h)
    visit = lambda x: [r["id"] for r in t.neighbourhood(x, spark.createDataFrame([("n01", 1), ("n02", 2)], "id string, rank int"), 2, 9).orderBy("place").collect()]
    assert visit(g) == visit(h) and len(visit(g)) == 9


def plain_communities(ids, weights):
    adj = {}
    for a, b, w in weights:
        adj.setdefault(a, {})[b] = w
    found = community.louvain(sorted(ids), adj, sum(w for *_, w in weights))
    first, number = {}, {}
    for n in sorted(ids):
        first.setdefault(found[n], len(first))
        number[n] = first[found[n]]
    return number


def test_communities_by_component_are_the_whole_walk(spark):
    rng = random.Random(0)
    ids = [f"n{i:02d}" for i in range(20)]
    edges = [(a, b, "calls", "EXTRACTED") for a, b in sorted({(rng.choice(ids[:10]), rng.choice(ids[:10])) for _ in range(16)} | {(rng.choice(ids[10:19]), rng.choice(ids[10:19])) for _ in range(16)})]
    g = make(spark, ids, edges).cached()
    weights = [(r["a"], r["b"], r["weight"]) for r in stats.weighted_adjacency(g).collect()]
    got = {r["id"]: r["community"] for r in community.communities(g).collect()}
    assert got == plain_communities(ids, weights)
    rounds = community.communities_in_rounds(g)
    assert {r["id"] for r in rounds.collect()} == set(ids)
    quality = lambda found: community.modularity(stats.weighted_adjacency(g), found).first()[0]
    assert quality(rounds) > 0.5 * quality(community.communities(g)) > 0


def test_pack_stays_under_its_budget(spark):
    nodes = [f"n{i:03d}" for i in range(60)]
    g = make(spark, nodes, calls(*[("n000", n) for n in nodes[1:]]))
    sinks = spark.createDataFrame([(n, "sql") for n in nodes[1:]], "id string, category string")
    found = audit.findings(t.source_sink_paths(g, seeds(spark, "n000", name="id"), sinks), sinks)
    whole = audit.build_pack(found, g, 1 << 20)
    assert whole["prunedPaths"] == 0 and len(whole["paths"]) == len(whole["edges"]) == 59 and len(whole["nodes"]) == 60
    size = lambda p: len(audit.serialised(p).encode())
    for budget in (4096, 5000, size(whole), size(whole) - 1):
        pack = audit.build_pack(found, g, budget)
        assert size(pack) <= budget and pack["prunedPaths"] == 59 - len(pack["paths"]) == len(whole["paths"]) - len(pack["paths"])
        assert pack["prunedPaths"] == 0 or size(pack) + size(whole) // 50 > budget
        assert [p["sink"] for p in pack["paths"]] == [p["sink"] for p in whole["paths"]][: len(pack["paths"])]
    pack = audit.build_pack(found, g, 4096)
    assert "sql-injection" in audit.render_markdown(pack) and "<table>" in audit.render_html(pack)
    assert all(f["suggestedActions"] == audit.SUGGESTED["sql-injection"] for f in pack["findings"])
    assert set(audit.SUGGESTED) == {kind for kind, _ in audit.FINDING_KINDS.values()} | {"taint-flow"}


def test_pages_escape_what_they_hold(spark):
    g = make(spark, ["a", "</script><b>"], calls(("a", "</script><b>"), ("a", "a")))
    text = html.graph_page(g, "<x>", 10, script="/* lib */")
    assert text.count("</script>") == 3 and "<title>&lt;x&gt;" in text and "/* lib */" in text
    data = html.data_of(text)
    assert [n["id"] for n in data["nodes"]] == ["</script><b>", "a"] and len(data["edges"]) == 2 and not data["truncated"]
    few = html.data_of(html.graph_page(g, "x", 1))
    assert [n["id"] for n in few["nodes"]] == ["a"] and len(few["edges"]) == 1 and few["truncated"]
    assert html.data_of(html.graph_page(make(spark, [], []), "x"))["nodes"] == []
