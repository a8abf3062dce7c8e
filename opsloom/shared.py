"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode a fresh local folder is set where it is unset; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="opsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def rounds(spark: SparkSession, name: str):
    """A function (df, step) that writes a DataFrame as Parquet in a new shared folder and reads it again, which cuts its lineage."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def written(df: DataFrame, step: str) -> DataFrame:
        df.write.parquet(f"{root}/{step}")
        return spark.read.schema(df.schema).parquet(f"{root}/{step}")

    return written
