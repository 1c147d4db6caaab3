"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a
step drawn from its name. Shards take turns, each claiming the first slot of its permutation
that is still free, so all get the same number of slots within one, and a change of one shard
moves few of the others' slots. A row's slot is a hash of its key; the table is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537  # prime; bounds what is broadcast
MAX_SHARDS = 65_535


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of every slot. Names must differ; size must be prime and no less than their number."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or len(shards) > min(size, MAX_SHARDS):
        raise ValueError("the table's size must be prime and at least the number of shards")
    at, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "little") % size)
        step.append(int.from_bytes(digest[8:16], "little") % (size - 1) + 1 if size > 2 else 1)
    owner, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) of the filled table; `size` rows, cut from one binary literal of two bytes a slot."""
    packed = b"".join(x.to_bytes(2, "big") for x in fill_table(shards, size))
    shard = F.conv(F.hex(F.substring(F.lit(packed), F.col("id").cast("int") * 2 + 1, F.lit(2))), 16, 10)
    return spark.range(size).select(F.col("id").cast("int").alias("__weftline_slot"), shard.cast("int").alias("__weftline_shard"))


def slot_of(key: str, size: int = TABLE_SIZE):
    """The key's slot: 60 bits of the MD5 of its text, modulo the size. Null is the empty text."""
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and shard number of every row; columns of those names are replaced.

    Rows are never moved: the table has `size` rows and is broadcast. Null keys go where the
    empty text goes, rows with equal keys to one shard. An empty df gives an empty result.
    """
    placed = df.drop(slot_col, shard_col).withColumn("__weftline_slot", slot_of(key, size))
    placed = placed.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "__weftline_slot")
    return placed.withColumnsRenamed({"__weftline_slot": slot_col, "__weftline_shard": shard_col})
