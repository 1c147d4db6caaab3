"""The gate in front of reads: fresh graphs are read, stale ones rebuilt or refused."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

T = TypeVar("T")


def posture(env: str | None, configured: str | None) -> str:
    """auto or refuse: the environment, then the configuration, then auto."""
    for value in (env, configured):
        if value in ("auto", "refuse"):
            return value
    return "auto"


def open_fresh(load: Callable[[], T | None], rebuild: Callable[[], None], signs: Callable[[], DataFrame], mode: str = "auto", build_if_missing: bool = False) -> T:
    """load()'s graph, after a rebuild if signs() has a row and the posture allows it.

    A missing graph is an error unless build_if_missing; a stale one is under `refuse`.
    """
    graph = load()
    if graph is None:
        if not build_if_missing:
            raise FileNotFoundError("no graph has been built")
        rebuild()
        return load()
    first = signs().limit(1).collect()
    if not first:
        return graph
    if mode == "refuse":
        raise RuntimeError(f"the graph is stale: {first[0]['reason']} {first[0]['path'] or ''}".strip())
    rebuild()
    return load()
