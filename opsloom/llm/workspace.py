"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from opsloom.shared import shared_dir

#: While a table is written: shuffle files go when the job ends, and fewer rows than by default go to Python at once, since rows are whole texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


class Workspace:
    """A folder of written tables: each cuts lineage and survives lost executors.

    ``save`` writes a DataFrame as Parquet and reads it back. Shuffle files of
    the writing job are removed as soon as it ends, since the written table
    replaces them. ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        for k, v in WRITING.items():
            conf.set(k, v)
        try:
            options = {"compression": "zstd"} | options
            df.write.options(**options).parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
