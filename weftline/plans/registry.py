"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.traversal import Graph
from weftline.plans.workload import Workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the workload as a query, with its SQL where there is one."""

    def register(f: Callable[[Workload], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Workload(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def graph(w: Workload) -> Graph:
    """The graph to be walked."""
    return w.graph


def plain(w: Workload) -> Graph:
    """The graph for all that reads its edges without walking them far: nothing is stored."""
    return Graph(w.nodes, w.edges)


def ids(w: Workload, *values: str, name: str = "seed") -> DataFrame:
    return w.spark.createDataFrame([(v,) for v in values], f"{name} string")
