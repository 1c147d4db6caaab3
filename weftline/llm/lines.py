"""Line deduplication by frequency within a host.

The pages of a host that contain a line, divided by the host's pages, is the line's frequency
there; lines above a ratio are boilerplate and are dropped. Copies of a page are one page on
both sides: else a page copied often enough would lose all its lines, whereas finding copies is
not this operator's task. Lines are counted by hash, combined before the shuffle. A host has at
most (lines a page) / ratio such lines, so the hashes to drop are gathered in one row a host and
looked up in the row of each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut

RATIO = 0.01
#: A line on fewer pages of a host than this is never boilerplate.
LEAST_PAGES = 3
#: Up to this many hashes (8 bytes each), those of all hosts are broadcast; beyond, joined by host.
BROADCAST_LINES = 500_000
BLANK = " \t\r\f\u000b"


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANK)))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, _key, n): hashes of the lines above the ratio and the number of different pages with them. Blank lines never are."""
    base = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_page"), lines_of(text).alias("_l"))
    totals = base.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    kept = F.filter(F.transform("_l", lambda x: F.trim(x, F.lit(BLANK))), lambda x: x != "")
    seen = base.select("_host", "_page", F.explode(F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x)))).alias("_key"))
    seen = seen.distinct().groupBy("_host", "_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return seen.join(totals, "_host").where(F.col("n") > ratio * F.col("_pages")).select("_host", "_key", "n")


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, dropped: str | None = None) -> DataFrame:
    """pages with the boilerplate lines cut out of text, all other columns as they were.

    Lines end at line feeds; blanks around a line don't count. Null hosts are one host, null
    texts stay null, and a text may become empty. Rows with equal texts count as one page.
    dropped: the name of a column for the number of lines cut.
    """
    bad = cut(boilerplate(pages, host, text, ratio, least))
    n = bad.count()
    by_host = bad.withColumnRenamed("_host", "__weftline_host").groupBy("__weftline_host").agg(F.collect_set("_key").alias("__weftline_bad"))
    by_host = F.broadcast(by_host) if n <= BROADCAST_LINES else by_host
    rows = pages.withColumn("__weftline_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).join(by_host, "__weftline_host", "left")
    lines = lines_of(text)
    rows = rows.withColumn("__weftline_bad", F.array_intersect(F.transform(lines, line_key), "__weftline_bad"))  # by hash; few are left
    rows = rows.withColumn("__weftline_keep", F.filter(lines, lambda x: ~F.array_contains("__weftline_bad", line_key(x))))
    touched = F.col("__weftline_bad").isNotNull() & F.col(text).isNotNull()
    count = F.when(touched, F.size(lines) - F.size("__weftline_keep")).otherwise(F.lit(0)).cast("long")
    out = rows.withColumn("__weftline_n", count).withColumn(text, F.when(touched & (F.col("__weftline_n") > 0), F.array_join("__weftline_keep", "\n")).otherwise(F.col(text)))
    out = out.withColumn(dropped, F.col("__weftline_n")) if dropped else out
    return out.drop("__weftline_host", "__weftline_bad", "__weftline_keep", "__weftline_n")
