"""Sums between communities."""

from pyspark.sql import functions as F

from tests.test_walks import random_graph
from weftline.operators import community, stats


def test_sums_need_no_join_of_edges(spark, sf_dir):
    """communities that are read off ids join no edges, and give what joining them gives."""
    from weftline.plans.all_queries import QUERIES

    assert "Join" not in QUERIES["G11_super_graph"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    g = random_graph(spark, 5)[0]
    of = lambda end: F.substring(end, -1, 1)
    joined = community.between(stats.weighted_adjacency(g), g.nodes.select("id", of("id").alias("community")))
    known = g.nodes.select("id")
    edges = g.edges.join(known.withColumnRenamed("id", "source"), "source").join(known.withColumnRenamed("id", "target"), "target")
    named = community.between_named(edges, of)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, named.collect())) != []
