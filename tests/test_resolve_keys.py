"""Calls are resolved by keys that may resolve."""

from weftline.operators import resolve
from weftline.plans.workload import Workload


def test_dead_calls_are_dropped_by_their_keys(spark, monkeypatch):
    """of names with too many definitions no call reaches the joins; called names alone are looked up."""
    nodes = spark.createDataFrame([(f"d{i}", "many" if i < 30 else f"x{i}", "function", f"f{i}.ts") for i in range(60)], "id string, label string, kind string, source_file string")
    edges = spark.createDataFrame([], "source string, target string, relation string, context string")
    calls = spark.createDataFrame([("many", f"d{i}", f"g{i % 3}.ts", None) for i in range(60)] + [("x40", "d1", "f1.ts", None), ("x41", "d41", "f41.ts", None)], "callee string, from_id string, source_file string, receiver_type string")
    none = spark.createDataFrame([], "source_file string, local_name string, module string, ord int")
    kept, cut = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df: (out := cut(df), kept.append(out.count()))[0])
    found = resolve.resolve_calls(nodes, edges, calls, none).select("source", "target", "confidence").collect()
    assert [tuple(r) for r in found] == [("d1", "d40", "INFERRED")]
    assert kept[-1] == 2  # of 5 different keys


def test_last_imports_are_last_of_imports(spark, sf_dir):
    w = Workload(spark, sf_dir)
    assert sorted(map(tuple, resolve.last_imports(w.last_imports).collect())) == sorted(map(tuple, resolve.last_imports(w.imports).collect()))
    assert w.last_imports.groupBy("source_file", "local_name").count().where("count > 1").isEmpty()
