"""What all executors share: the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set (local runs)."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder: what reads it several times sees the same rows, also after the
    loss of executors. Spark deletes the files when nothing refers to them (cleanCheckpoints) or with the folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def written(df: DataFrame) -> DataFrame:
    """`df` as compressed Parquet files in the shared folder, where they stay as long as it does: for tables that are read long after
    they were made, as fitted models are."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
