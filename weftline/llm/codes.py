"""Vector code compression: codebooks of vector parts by Lloyd's rounds that move only what changed.

Every vector keeps, in the shared folder, the codes it had before; every codebook entry keeps
its running integer sums and count. A round assigns each part to its nearest entry and shuffles
only what parts that changed take away from their old entry and add to their new one, summed in
the task before. Sums are integers, so that adding and taking away leaves what a full sum would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Steps
from weftline.llm.vectors import in_fixed_point, joined, rows_of

BLOCK = 4096  # rows whose distances to all entries are held at once
#: Up to this many labels (16 bytes each) are broadcast with their sums; more are joined by shuffle.
BROADCAST_LABELS = 500_000


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indexes of each part's nearest entry, ties to the lower, and exact squared distances; books: (parts, entries, width)."""
    parts, _, width = books.shape
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * width * most * most < 1 << 53 else np.int64  # doubles of that size are exact, and faster
    codes, errors = np.zeros((len(x), parts), dtype=np.uint8), np.zeros((len(x), parts), dtype=np.int64)
    for p in range(parts):
        book = books[p].astype(kind)
        twice, norm = 2 * book.T, (book * book).sum(axis=1)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK, p * width : (p + 1) * width].astype(kind)
            far = norm - part @ twice
            best = far.argmin(axis=1)
            codes[at : at + BLOCK, p] = best
            errors[at : at + BLOCK, p] = far[np.arange(len(best)), best] + (part * part).sum(axis=1)
    return codes, errors


def _assigned(rows: DataFrame, books: np.ndarray, kinds: str) -> DataFrame:
    """rows (vec_id, label, x, code) with their new code, the one before and the error."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, errors = nearest(rows_of(b.column(2), b.num_rows), shared.value)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed, b.column(3), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "x", "code", "before", "error"])

    return rows.mapInArrow(go, f"{kinds}, x array<int>, code binary, before binary, error long")


def _changes(state: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, n, sums): what changed parts add to entries and take away from them, summed by task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = rows_of(b.column(0), b.num_rows).astype(np.int64)
            code, known = _bytes(b.column(1), parts), b.column(2).is_valid().to_numpy(zero_copy_only=False)
            before = np.zeros_like(code)
            before[known] = _bytes(b.column(2).drop_null(), parts)
            for p in range(parts):
                part, moved = x[:, p * width : (p + 1) * width], ~known | (code[:, p] != before[:, p])
                for sign, rows, to in ((1, moved, code), (-1, moved & known, before)):
                    np.add.at(n[p], to[rows, p], sign)
                    np.add.at(sums[p], to[rows, p], sign * part[rows])
        touched = np.argwhere((n != 0) | (sums != 0).any(axis=2))
        lists = [sums[p, e].tolist() for p, e in touched]
        yield pa.RecordBatch.from_arrays([pa.array(touched[:, 0], pa.int32()), pa.array(touched[:, 1], pa.int32()), pa.array(n[tuple(touched.T)]), pa.array(lists, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    changed = state.where(F.col("before").isNull() | (F.col("code") != F.col("before"))).select("x", "code", "before")
    return changed.mapInArrow(go, "part int, entry int, n long, sums array<long>")


def _bytes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts)


def _summed(rows: DataFrame, width: int) -> DataFrame:
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).select("part", "entry", "n", F.array(*[F.col(f"s{i}") for i in range(width)]).cast("array<long>").alias("sums"))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector of finite components.

    Vectors (vec_id, embedding, label) that are null or hold null or non-finite components are
    left out; other columns are ignored. Components become floor(scale * x); vectors shorter
    than the longest one, or than the next multiple of `parts`, count as ending in zeros. The
    codebooks start as the parts of the `entries` smallest vec_ids (nulls last, equal ids by
    their components); with fewer vectors they are shorter. Null labels are one label. Repeated
    rows count as often as they stand. No vectors give no rows.
    """
    spark = vectors.sparkSession
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    kept = in_fixed_point(vectors, scale, "vec_id", "label")
    span = kept.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if span["most"] is None:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-span["most"] // parts)
    if span["least"] < width * parts:
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("x"))))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # as many rows as entries
    books = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, width).swapaxes(0, 1)
    steps, state, sums = Steps(spark), kept.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        old, state = steps.n, steps.put(_assigned(state.select("vec_id", "label", "x", "code"), books, schema))
        delta = _changes(state, parts, len(first), width)
        sums = steps.put(_summed(delta if sums is None else sums.unionByName(_summed(delta, width)), width))
        if old:
            steps.drop(old - 1)  # the state before
            steps.drop(old)  # and the sums before
        books = books.copy()
        for r in sums.where("n > 0").collect():  # parts * entries rows
            books[r["part"], r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
    final = steps.put(_assigned(state.select("vec_id", "label", "x", "code"), books, schema).select("vec_id", "label", "code", "error"))
    by_label = steps.put(final.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    by_label = F.broadcast(by_label) if by_label.count() <= BROADCAST_LABELS else by_label
    digest = hashlib.sha256(joined(books).encode()).hexdigest()
    out = final.join(by_label, final["label"].eqNullSafe(by_label["_label"]), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
