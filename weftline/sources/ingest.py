"""Graphs that compiler-backed extractors made elsewhere: one JSON document a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "schemaVersion int, extractor struct<id: string, version: string>, nodes array<struct<id: string, label: string, fileType: string, kind: string, sourceFile: string, sourceLocation: string>>, edges array<struct<source: string, target: string, relation: string, confidence: string, context: string, sourceFile: string, sourceLocation: string, weight: double>>, diagnostics array<string>, errors array<string>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).option("multiLine", "true").json(path)


def parse_payloads(texts: DataFrame, column: str = "value") -> DataFrame:
    return texts.select(F.from_json(column, f"struct<{', '.join(x.replace(' ', ': ', 1) for x in _split(PAYLOAD))}>").alias("p")).select("p.*")


def _split(ddl: str) -> list[str]:
    """Top-level fields of a schema in DDL."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def payload_nodes(payloads: DataFrame) -> DataFrame:
    """Nodes of the payloads of schema 1, those with errors too, as their extractors gave them."""
    rows = payloads.where("schemaVersion = 1").select(F.explode("nodes").alias("n"))
    return rows.select("n.id", "n.label", F.col("n.fileType").alias("file_type"), "n.kind", F.col("n.sourceFile").alias("source_file"), F.col("n.sourceLocation").alias("source_location"))


def payload_edges(payloads: DataFrame) -> DataFrame:
    rows = payloads.where("schemaVersion = 1").select(F.explode("edges").alias("e"))
    return rows.select("e.source", "e.target", "e.relation", "e.confidence", F.coalesce("e.context", F.lit("")).alias("context"), F.col("e.sourceFile").alias("source_file"), F.col("e.sourceLocation").alias("source_location"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
