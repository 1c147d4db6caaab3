"""Cutting the lineage of iterative plans."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again, so that a loop's plan stays short and lost executors cost one round.

    A checkpoint would keep the optimizer's estimate of the rows' size, which in a loop that
    joins a table with itself doubles its digits each time; files have the size they have. compression is for tables so large that disk counts for more than time.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
