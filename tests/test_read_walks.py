"""F14 to F18: what walks the graph stores no walks, and a frontier is met below the edges' own aggregation."""

from pyspark.sql import functions as F

from tests.test_walks import random_graph
from weftline.operators import traversal as t
from weftline.plans import workload
from weftline.plans.workload import Workload


def test_no_walks_are_stored(spark, sf_dir, monkeypatch):
    def stored(*_):
        raise AssertionError("walks were stored")

    monkeypatch.setattr(workload, "store_walks", stored)
    monkeypatch.setattr(workload, "_kept", {})
    assert Workload(spark, sf_dir).graph.walks is None


def test_parts_hold_the_edges(spark, sf_dir):
    g = Workload(spark, sf_dir).graph
    for a, b, edges in g.parts:
        assert edges.where(~(F.startswith("source", F.lit(a)) & F.startswith("target", F.lit(b)))).isEmpty()
    assert sum(edges.count() for *_, edges in g.parts) == g.edges.count()


def test_frontier_goes_below_the_aggregation(spark, sf_dir, monkeypatch):
    for seek in (1000, 0):
        monkeypatch.setattr(t, "SEEK", seek)
        level = spark.createDataFrame([("s", f"order:{i}") for i in range(20)], "seed string, node string")
        plan = t.Walk(Workload(spark, sf_dir).graph, "out").step(level)[1]._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
        scans = [i for i, x in enumerate(plan) if "l_orderkey" in x and "Relation" in x]
        assert len(scans) == 2
        for i in scans:
            above, at = [], depth(plan[i])
            for x in reversed(plan[:i]):
                if depth(x) < at:
                    above, at = [*above, x], depth(x)
            aggregate = next(k for k, x in enumerate(above) if "Aggregate" in x)
            assert any(("Filter" in x and "order:" in x) if seek else "LeftSemi" in x for x in above[:aggregate]), plan


def test_ways_of_reading_give_the_same(spark, monkeypatch):
    g = random_graph(spark, 6, m=300)[0]
    parts = tuple((p, "", g.edges.where(F.startswith("source", F.lit(p)))) for p in [f"n{i}" for i in range(3, 10)])
    g = t.Graph(g.nodes, g.edges.where(F.substring("source", 2, 1).isin(*"3456789")), parts=parts)
    whole = t.Graph(g.nodes, g.edges)
    s = spark.createDataFrame([("n4",), ("n9",), ("n5",)], "seed string")  # and so three that are no nodes are reached
    run = lambda x: sorted(t.frontier(t.Walk(x, "out"), s.select("seed", F.col("seed").alias("node")), 4, expand_unknown=False).collect(), key=str)
    want = run(whole)
    assert any(not r["known"] for r in want) and any(r["depth"] > 1 for r in want)
    for values in ({}, {"SEEK": 0}, {"SEEK": 0, "BROADCAST_FRONTIER": 0, "TRY": 0}, {"TRY": 0}, {"SEEK": 2, "BROADCAST_FRONTIER": 3}):
        with monkeypatch.context() as m:
            for name, value in values.items():
                m.setattr(t, name, value)
            assert run(g) == want and run(whole) == want
