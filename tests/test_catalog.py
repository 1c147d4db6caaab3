"""Catalogs by grams and by cases find the same."""

import random

import pytest

from weftline.operators import audit


@pytest.mark.parametrize("seed", [1, 2])
def test_grams_and_cases_agree(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("aBc#") for _ in range(n))
    nodes = spark.createDataFrame([(f"n{i}", text(rng.randint(0, 12)) if i % 11 else None) for i in range(120)], "id string, label string")
    rows = [(f"p{i // 2}", rng.choice(["source", "sink"]), f"c{i % 3}", text(rng.randint(1, 5)), i) for i in range(60)]
    catalog = spark.createDataFrame(rows, "name string, role string, category string, needle string, ord int")
    want = sorted(map(tuple, audit.match_catalog(nodes, catalog).collect()))
    assert sorted(map(tuple, audit.match_catalog(nodes, catalog, cases=5).collect())) == want and len(want) > 50
    assert audit.match_catalog(nodes, catalog.where("length(needle) > 2"), cases=0).count() > 0
    assert audit.match_catalog(nodes, catalog.limit(0), cases=0).isEmpty()
