"""Stores: snapshots behind a pointer, JSON lines with validation, node-link documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "CURRENT"  # Spark reads no file whose name starts with an underscore


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(tables: dict[str, DataFrame], root: str) -> str:
    """Writes tables as a new version of root and points to it at once; readers see the old or the new, never neither."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v={uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    p, fs = _hadoop(spark, f"{root}/{POINTER}.{version}")
    out = fs.create(p, True)
    out.write(bytearray(version.encode()))
    out.close()
    target, _ = _hadoop(spark, f"{root}/{POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = options
    context.rename(p, target, array)
    return version


def current(spark: SparkSession, root: str) -> str:
    p, fs = _hadoop(spark, f"{root}/{POINTER}")
    return root + "/" + spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0].strip() if fs.exists(p) else ""


def load(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    """The named tables of one version, resolved once."""
    at = current(spark, root)
    if not at:
        raise FileNotFoundError(f"{root} holds no snapshot")
    return [spark.read.parquet(f"{at}/{n}") for n in names]


def clear(tables: dict[str, DataFrame], root: str) -> str:
    return replace({k: v.limit(0) for k, v in tables.items()}, root)


def parse_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Rows of JSON lines with `_error`: blank lines are left out, bad ones have nulls and say so."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = lines.where(F.trim(value) != "").withColumn("j", F.from_json(value, wide, {"columnNameOfCorruptRecord": "_bad"}))
    required = [f.name for f in schema if not f.nullable]
    missing = F.concat_ws(",", *[F.when(F.col(f"j.{c}").isNull(), F.lit(c)) for c in required])
    error = F.when(F.col("j._bad").isNotNull(), "not JSON of this shape").when(missing != "", F.concat(F.lit("missing "), missing))
    return rows.select("j.*", error.alias("_error")).drop("_bad")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, all of which must be right: the first bad one fails the read."""
    rows = parse_lines(spark.read.text(path), schema)
    bad = rows.where("_error is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: {bad[0]['_error']}")
    return rows.drop("_error")


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, compression: str | None = None) -> None:
    """The graph as one node-link JSON document: the text parts under path, in order of their names, are the document.

    A line holds a node or a link; nodes come by id, links by their key. Both are sorted and
    written by all executors, so a graph of any size can be exported. Columns are sorted, each once,
    and only sorted rows become JSON. Ids and edge keys are unique.
    """
    sides = {1: (nodes, ["id"]), 3: (edges, ["source", "target", "relation", "context"])}
    text = lambda df, key: [c for c in key if df.schema[c].dataType == T.StringType()]  # noqa: E731  # what the key holds as it is
    rest = {rank: F.struct(F.lit(0).alias("_"), *[F.col(c) for c in df.columns if c not in text(df, key)]) for rank, (df, key) in sides.items()}
    keyed = {rank: df.select(F.lit(rank).alias("rank"), F.struct(*[(F.col(key[i]).cast("string") if i < len(key) else F.lit("")).alias(f"k{i}") for i in range(4)]).alias("key"), *[(rest[r] if r == rank else F.lit(None)).alias(f"rest{r}") for r in sides]) for rank, (df, key) in sides.items()}
    ends = [(0, '{"directed":true,"multigraph":true,"graph":{},"nodes":['), (2, '],"links":['), (4, "]}")]
    frame = nodes.sparkSession.createDataFrame(ends, "rank int, text string").select("rank", F.struct(*[F.lit("").alias(f"k{i}") for i in range(4)]).alias("key"), *[F.lit(None).alias(f"rest{r}") for r in sides], "text")
    whole = F.struct("key", "rest1", "rest3")
    rows = keyed[1].union(keyed[3])
    first = F.broadcast(rows.groupBy("rank").agg(F.min(whole).alias("first")))  # 2 rows
    rows = rows.join(first, "rank").select("rank", "key", "rest1", "rest3", F.when(~whole.eqNullSafe(F.col("first")), ",").otherwise("").alias("text"))
    value = F.col("text")
    for rank, (df, key) in sides.items():
        own = [(F.col(f"key.k{key.index(c)}") if c in text(df, key) else F.col(f"rest{rank}.{c}")).alias(c) for c in df.columns]
        value = F.when(F.col("rank") == rank, F.concat("text", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))).otherwise(value)
    rows.union(frame).orderBy("rank", "key", "rest1", "rest3").select(value.alias("value")).write.text(path, compression=compression)


def read_node_link(spark: SparkSession, path: str, nodes: T.StructType, edges: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The nodes and links of a document that write_node_link wrote."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("value"))
    parsed = lambda schema, key: lines.where(F.startswith("value", F.lit("{")) & F.endswith("value", F.lit("}"))).select(F.from_json("value", schema).alias("j")).where(F.col(f"j.{key}").isNotNull()).select("j.*")
    return parsed(nodes, "id"), parsed(edges, "source")


def write_export(rows: DataFrame, path: str) -> None:
    """JSON lines in order of created_at and id."""
    rows.orderBy("created_at", "id").write.mode("overwrite").json(path)
