"""Every query of the engine; importing the modules registers theirs."""

from weftline.plans import graph_queries, memory_queries, system_queries  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
