"""The event feed: append, tail, exactly-once topic saves, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.memory import save
from weftline.schemas import EVENTS

TYPES = ("graph.built", "memory.created", "audit.completed")


def envelope(kind: str, payload: Column, ident: Column | None = None, ts: Column | None = None) -> Column:
    return F.struct(F.lit(1).alias("schemaVersion"), (ident if ident is not None else F.uuid()).alias("id"), F.lit(kind).alias("type"), (ts if ts is not None else F.unix_millis(F.current_timestamp())).alias("ts"), F.to_json(payload).alias("payload"))


def append(events: DataFrame, path: str, enabled: bool = True) -> bool:
    """Adds events as JSON lines; a failure to do so, or a switched-off outbox, never fails the caller."""
    if not enabled:
        return False
    try:
        events.write.mode("append").json(path)
    except Exception:
        return False
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def redact(events: DataFrame, rule: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return rule(events) if rule else events


def iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def tail(events: DataFrame, n: int | None = None) -> DataFrame:
    """(line, ts, id): `<time> <type> <id>`, the last n by time."""
    rows = events.select(F.concat_ws(" ", iso(F.col("ts")), "type", "id").alias("line"), "ts", "id")
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n) if n else rows


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's events without repeats of an id within the watermark."""
    return events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, type, n) by tumbling windows; rows later than the watermark are dropped."""
    rows = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def save_stream(saves: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str):
    """Applies a stream of saves to the notes that load() gives; store(rows, batch) must be idempotent by batch."""
    def apply(batch: DataFrame, number: int) -> None:
        store(save(load(), batch), number)

    return saves.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
