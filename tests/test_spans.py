"""Innermost spans against a plain search."""

import random

from weftline.sources import extract


def test_points_meet_blocks_and_not_all_spans(spark):
    """against a plain search, with open ends, empty spans and points outside; no join is by path alone."""
    rng = random.Random(7)
    spans = [(rng.choice("ab"), f"s{rng.randrange(30)}", a := rng.randint(-40, 200), a + rng.choice([-1, 0, 1, 5, 17, 64, 90])) for _ in range(120)]
    spans += [("a", "open", 150, 2**63 - 1), ("b", "before", -(2**62), -30), ("b", None, 3, 9)]
    points = [(rng.choice("abc"), rng.randint(-60, 320), i % 3) for i in range(200)] + [("a", 2**63 - 1, 0), (None, 4, 0), ("a", None, 0)]
    want = []
    for path, at, k in points:
        hit = [(z - a, -a, n is not None, n or "") for p, n, a, z in spans if p == path and at is not None and a <= at <= z]
        want.append((path, at, k, (min(hit)[3] or None) if hit else None))
    found = extract.enclosing(spark.createDataFrame(points, "path string, at long, k int"), spark.createDataFrame(spans, "path string, name string, first long, last long"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan and all("block" in x or "at#" in x for x in plan.split("\n") if "Join" in x), plan
