"""Catalogs with many patterns of one needle."""

from weftline.operators import audit


def test_homonymous_needles_count_once(spark, monkeypatch):
    """patterns with one needle and nodes with one label do not multiply each other."""
    seen, first = [], audit._first
    monkeypatch.setattr(audit, "_first", lambda rows, *more: (seen.append(rows.count()), first(rows, *more))[1])
    nodes = spark.createDataFrame([(f"n{i}", "old hammer" if i % 2 else "A VERY LONG LABEL OF 1234567 NUMBERS") for i in range(40)], "id string, label string")
    rows = [(f"p{i}", "sink", f"c{i % 3}", ["hammer", "very long label of 1234567", "456"][i % 3], i) for i in range(300)]
    found = audit.match_catalog(nodes, spark.createDataFrame(rows, "name string, role string, category string, needle string, ord int"))
    assert sorted(map(tuple, found.collect())) == sorted((f"n{i}", "sink", *(("p0", "c0") if i % 2 else ("p1", "c1"))) for i in range(40))
    assert max(seen) <= 80
