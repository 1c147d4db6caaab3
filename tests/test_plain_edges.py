"""Edges are read without walks, and walks are stored without counting all nodes."""

from pyspark.sql import functions as F

from tests.test_walks import random_graph
from weftline.operators import traversal as t
from weftline.plans import workload
from weftline.plans.workload import Workload


def test_edges_are_read_without_walks(spark, sf_dir, monkeypatch):
    """F5 to F24: what only reads edges stores no walks, and a relation costs only its own tables."""

    def stored(*_):
        raise AssertionError("walks were stored")

    monkeypatch.setattr(workload, "store_walks", stored)
    monkeypatch.setattr(workload, "_kept", {})
    from weftline.plans.all_queries import QUERIES

    for name in ("A3_edges_by_relation", "J15_induced_subgraph", "S15_adjacency", "R6_edge_kinds", "G2_member_closure", "K3_atomic_swap"):
        QUERIES[name](spark, sf_dir).collect()
    plan = Workload(spark, sf_dir).edges.where("relation = 'contains'")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_hubs_by_bins(spark, monkeypatch):
    """only nodes of full bins are counted, and the hubs are those that counting all gives."""
    edges = random_graph(spark, 5)[0].edges
    for hub, bins in ((3, 7), (6, 65536), (500, 4)):
        monkeypatch.setattr(t, "HUB", hub)
        monkeypatch.setattr(t, "BINS", bins)
        for end in ("source", "target"):
            want = {r[end] for r in edges.groupBy(end).count().where(F.col("count") > hub).collect()}
            assert {r["node"] for r in t.hubs_of(edges, end).collect()} == want
