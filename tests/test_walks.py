"""Stored walks: the same results as without, by seeks, broadcasts and buckets; shortest paths from both ends against a walk from one."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tests.test_traversal import make, seeds
from weftline.operators import traversal as t

RELATIONS = ["calls", "contains", "uses", "deploys"]


def random_graph(spark, seed, n=30, m=70):
    rng = random.Random(seed)
    nodes = [(f"n{i}", f"n{i}", rng.choice(["module", "function", "config"]), "code", f"{i}.ts", None) for i in range(n)]
    ends = [f"n{i}" for i in range(n + 3)]  # three are no nodes
    edges = {(rng.choice(ends), rng.choice(ends), rng.choice(RELATIONS), rng.choice(["EXTRACTED", "AMBIGUOUS"])) for _ in range(m)}
    edges |= {("n0", f"n{i}", "calls", "EXTRACTED") for i in range(1, 20)}  # a hub
    return make(spark, nodes, sorted(edges)), nodes, sorted(edges)


def stored(spark, g, tmp_path):
    return t.store_walks(g, 4, f"w{uuid.uuid4().hex}", str(tmp_path))


#: Frontiers by seek, by broadcast, and by buckets with hubs salted.
WAYS = {"seek": {}, "broadcast": {"SEEK": 0}, "buckets": {"SEEK": 0, "BROADCAST_FRONTIER": 0, "HUB": 6, "SALTS": 3}}


@pytest.mark.parametrize("way", WAYS)
def test_stored_walks_change_nothing(spark, tmp_path, monkeypatch, way):
    for name, value in WAYS[way].items():
        monkeypatch.setattr(t, name, value)
    g, _, _ = random_graph(spark, 3)
    w = stored(spark, g, tmp_path)
    assert (w.walks.hubs.count() > 0) == (way == "buckets")
    s = seeds(spark, "n0", "n4")
    runs = [lambda x: t.affected(x, s, 2), lambda x: t.impact(x, s, 1)]
    if way == "seek":
        rank = spark.createDataFrame([("n0", 1), ("n7", 2)], "id string, rank int")
        ends = seeds(spark, "n3", "n11", "n32", name="id")
        runs += [lambda x: t.neighbourhood(x, rank), lambda x: t.source_sink_paths(x, s.withColumnRenamed("seed", "id"), ends, 4)]
    for run in runs:
        assert sorted(run(w).collect(), key=str) == sorted(run(g).collect(), key=str)


def test_edges_stay_in_their_buckets(spark, tmp_path, monkeypatch):
    """However large the frontier, only it is shuffled; the edges are read and joined where they lie."""
    monkeypatch.setattr(t, "SEEK", 0)
    monkeypatch.setattr(t, "BROADCAST_FRONTIER", 0)
    w = stored(spark, random_graph(spark, 4)[0], tmp_path)
    level = spark.createDataFrame([(f"n{i}", "s") for i in range(20)], "node string, seed string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for direction in ("out", "in"):
            plan = t.Walk(w, direction, F.col("relation") != "uses").step(level)[1]._jdf.queryExecution().executedPlan().toString().split("\n")
            scan = next(i for i, x in enumerate(plan) if "Scan parquet" in x and "_" + {"out": "out", "in": "back"}[direction] in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-*|"))
            above, at = [], depth(plan[scan])
            for x in reversed(plan[:scan]):
                if depth(x) < at:
                    above, at = [*above, x], depth(x)
            assert any("Join" in x for x in above) and not any("Exchange" in x for x in above), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def canonical_path(edges, ids, seed, target, most):
    """From the target back, the first (parent, direction, relation, edge) a level nearer to the seed."""
    ways = {}
    for a, b, r, c in edges:
        ways.setdefault(b, []).append((a, 0, r, (a, b, r, ""), c))
        ways.setdefault(a, []).append((b, 1, r, (a, b, r, ""), c))
    depth, level = {seed: 0}, [seed]
    while level:
        level = sorted({p for x in level for p, *_ in ways.get(x, []) if p not in depth})
        depth |= {x: 1 + min(depth[p] for p, *_ in ways[x] if p in depth) for x in level}
    if depth.get(target, most + 1) > most:
        return None
    steps, at = [], target
    while at != seed:
        p, _, r, _, c = min(x for x in ways[at] if depth.get(x[0], 99) == depth[at] - 1)
        steps.insert(0, (p, at, r, c))
        at = p
    return depth[target], [x for x in steps if x[0] in ids and x[1] in ids]


@pytest.mark.parametrize("seed", [1])
def test_paths_from_both_ends_are_those_from_one(spark, tmp_path, seed):
    g, nodes, edges = random_graph(spark, seed, n=40, m=45)
    ids, rng = {x[0] for x in nodes}, random.Random(seed)
    pairs = [(f"n{rng.randrange(43)}", f"n{rng.randrange(43)}") for _ in range(15)] + [("n1", "n1"), ("nowhere", "n1")]
    got = t.shortest_paths(stored(spark, g, tmp_path), spark.createDataFrame(pairs, "seed string, target string"), 4)
    found = {(r["seed"], r["target"]): (r["hops"], [tuple(s) for s in r["steps"]]) for r in got.collect()}
    want = {p: x for p in pairs if (x := canonical_path(edges, ids, *p, 4)) is not None}
    assert found == want
