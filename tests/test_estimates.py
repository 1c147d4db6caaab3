"""Joins of rows that grow after Spark has estimated them."""

from weftline.sources import extract


def test_exploded_spans_are_not_broadcast(spark, tmp_path):
    """spans in blocks and points in levels are many times their files' size, by which Spark would broadcast them."""
    spark.createDataFrame([("a", f"s{i}", i, i + 9) for i in range(50)], "path string, symbol string, first long, last long").write.parquet(f"{tmp_path}/spans")
    spark.createDataFrame([("a", i, f"s{i % 7}") for i in range(50)], "path string, at long, symbol string").write.parquet(f"{tmp_path}/points")
    spans, points = spark.read.parquet(f"{tmp_path}/spans"), spark.read.parquet(f"{tmp_path}/points")
    for found in (extract.enclosing(points, spans.withColumnRenamed("symbol", "name")), extract.symbol_graph(spans, points)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
