"""Good, late and rejected rows of a stream, and what becomes of the rejected ones.

A batch is written once, to a folder of its number that is split by outcome, so
a batch that is tried again overwrites itself. Rejected rows keep their text, a
reason and the number of the attempt; a replay mends texts, judges them again
and writes a folder of its attempt. After the last attempt a row is dead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "raw string, at timestamp, reason string, attempt int, origin long"
ROUTED = f"{COLUMNS}, batch long, outcome string"


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks; null if it breaks none. A rule that is null is not broken."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def _written(spark: SparkSession, path: str, schema: str = ROUTED) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path.rsplit("/", 1)[0]).parquet(path)


def route_batch(batch: DataFrame, number: int, root: str, at: Column, rules: dict[str, Column], delay: str = "1 day") -> None:
    """Writes a batch with a column ``raw``. Late is a row older than ``delay`` before the newest good row of the batches before.

    That moment is one row a batch, so a batch tried again finds the same one.
    A row whose time cannot be read is not late; a rule has to reject it.
    """
    spark = batch.sparkSession
    clock = spark.read.schema("at timestamp").parquet(f"{root}/clock/batch={number - 1}").first()["at"] if number else None
    judged = batch.select("raw", at.alias("at"), first_reason(rules).alias("reason"), F.lit(1).alias("attempt"), F.lit(number).cast("long").alias("origin"))
    late = F.col("at") < F.lit(clock).cast("timestamp") - F.expr(f"interval {delay}")
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(late, "late").otherwise("good")
    judged.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(f"{root}/routed/batch={number}")
    newest = _written(spark, f"{root}/routed/batch={number}").filter("outcome = 'good'").agg(F.greatest(F.max("at"), F.lit(clock).cast("timestamp")).alias("at"))
    newest.write.mode("overwrite").parquet(f"{root}/clock/batch={number}")


def replay(spark: SparkSession, root: str, attempt: int, mend: Callable[[Column], Column], at: Column, rules: dict[str, Column]) -> None:
    """Mends the texts that attempt ``attempt - 1`` rejected and judges them again; what is good now is good, however late."""
    before = spark.read.schema(ROUTED).parquet(f"{root}/routed") if attempt == 2 else _written(spark, f"{root}/replayed/attempt={attempt - 1}", COLUMNS + ", outcome string")
    again = before.filter("outcome = 'rejected'").select(mend(F.col("raw")).alias("raw"), "origin")
    judged = again.select("raw", at.alias("at"), first_reason(rules).alias("reason"), "origin")
    outcome = F.when(F.col("reason").isNotNull(), "rejected").otherwise("good")
    judged.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(f"{root}/replayed/attempt={attempt}")


def outcomes(spark: SparkSession, root: str, attempts: int) -> DataFrame:
    """Every row once, with its last outcome: good, late, or dead after all attempts."""
    out = spark.read.schema(ROUTED).parquet(f"{root}/routed").filter("outcome <> 'rejected'").select("raw", "reason", "attempt", "origin", "outcome")
    for n in range(2, attempts + 1):
        again = _written(spark, f"{root}/replayed/attempt={n}", "raw string, at timestamp, reason string, origin long, attempt int, outcome string")
        keep = F.lit(True) if n == attempts else F.col("outcome") == "good"
        out = out.unionByName(again.filter(keep).select("raw", "reason", F.lit(n).alias("attempt"), "origin", "outcome"))
    return out.withColumn("outcome", F.when(F.col("outcome") == "rejected", "dead").otherwise(F.col("outcome")))
