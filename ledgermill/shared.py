"""The folder that driver and executors share: tables that cut lineage, and state of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no folder (tests).
LOCAL = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a cluster it must be set, as executors don't see one another's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/ledgermill-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later plans begin there, and lost executors don't matter."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
