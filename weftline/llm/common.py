"""What several operators share: the shared folder, lineage cuts, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and free of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Steps:
    """Tables of a loop, written to the shared folder and read again.

    A checkpoint keeps the optimizer's estimate of its size; joined with itself turn after turn,
    that number doubles its digits until planning takes minutes. A file's size is what it is.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, scratch(spark, "steps"), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self, number: int | None = None) -> None:
        """Deletes the tables, or one of them; what was read from them must have been written elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder if number is None else f"{self.folder}/{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary")) % n


_kept: dict[str, object] = {}


def kept(name: str, make):
    """An object that this process keeps between tasks, until another operator's tasks let go of it."""
    if name not in _kept:
        trim()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Frees what other operators' tasks kept in this process, whose memory they share."""
    if _kept:
        _kept.clear()
        trim()


def trimmed(batches: Iterator) -> Iterator:
    """What a task yields; when it ends, its free memory is given back, for the process waits idle for the next task."""
    try:
        yield from batches
    finally:
        trim()


def trim() -> None:
    """Gives free memory back to the system; the allocators of Python, C and Arrow would hold it for this process."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
