"""Readers of telemetry files and the deduplicating sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom import schemas

#: File names that evaluation alone may read.
GUARDED = ("labels.json", "ground_truth.json")


def allowed(path: str) -> str:
    """The path, unless it names a file with the answers."""
    if path.rstrip("/").rsplit("/", 1)[-1] in GUARDED:
        raise PermissionError(f"{path} holds labels; detection must not read it")
    return path


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log entries; ``is_corrupt`` marks lines that are not JSON, ``message`` is text, else JSON fields, else k=v labels."""
    raw = spark.read.schema(schemas.LOG_ENTRY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(allowed(path))
    kv = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    message = F.coalesce(F.nullif("textPayload", F.lit("")), F.get_json_object("jsonPayload", "$.message"), F.get_json_object("jsonPayload", "$.msg"), kv)
    return raw.withColumns({"ts": F.try_to_timestamp("timestamp"), "message": message, "is_corrupt": F.col("_corrupt").isNotNull()}).drop("_corrupt")


def read_scrapes(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """Scrape files named ``<job>__<instance>.jsonl`` with job and instance from the name, in which other characters may be percent-encoded; of one phase, if it is named."""
    rows = spark.read.schema(schemas.SCRAPE).json(allowed(path)).withColumn("_f", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
    parts = F.split(F.url_decode(F.url_decode("_f")), "__")  # once for the path, once for the name
    rows = rows.filter(F.col("phase") == phase) if phase else rows
    return rows.select(F.get(parts, F.lit(0)).alias("job"), F.get(parts, F.lit(1)).alias("instance"), F.try_to_timestamp("scrape_time").alias("ts"), "phase", "exposition")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TARGETS).option("multiLine", True).json(allowed(path)).select(F.inline("targets"))


def attach_targets(scrapes: DataFrame, targets: DataFrame) -> DataFrame:
    """Scrapes with their target's labels."""
    return scrapes.join(targets, ["job", "instance"], "left")


def read_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of a topology file."""
    doc = spark.read.schema(schemas.TOPOLOGY).option("multiLine", True).json(allowed(path))
    edges = doc.select(F.explode("edges").alias("e")).select(F.get("e", 0).alias("relation"), F.get("e", 1).alias("src"), F.get("e", 2).alias("dst"))
    return doc.select(F.inline("entities")), edges


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A row for each change and entity; a change without entities holds for the whole estate (null entity)."""
    doc = spark.read.schema(schemas.CALENDAR).option("multiLine", True).json(allowed(path)).select(F.inline("changes"))
    return doc.select("change_id", "kind", F.explode_outer("entities").alias("entity"), F.try_to_timestamp("start").alias("start_ts"), F.try_to_timestamp("end").alias("end_ts"), "description")


def read_query_range(spark: SparkSession, path: str, start_s: int | None = None, end_s: int | None = None, pretty: bool = False) -> DataFrame:
    """Answers of range and instant queries, a document a line (``pretty``: a document a file), as (host, metric, at, value) rows.

    ``at`` is whole epoch seconds; points without a readable time or without a
    value are left out. Values that are no finite number are 0. The host is the
    label host_name, hostname or instance, else ``unknown_host``. Where folders
    are split by ``day``, only those of the range from ``start_s`` to before
    ``end_s`` are read. Lines that are not JSON give no rows.
    """
    docs = spark.read.schema(schemas.QUERY_RANGE).option("multiLine", pretty).json(allowed(path))
    if "day" in docs.columns:
        day = F.col("day").cast("date")
        docs = docs.filter(day >= F.timestamp_seconds(F.lit(start_s)).cast("date")) if start_s is not None else docs
        docs = docs.filter(day <= F.timestamp_seconds(F.lit(end_s - 1)).cast("date")) if end_s is not None else docs
    series = docs.select(F.explode("data.result").alias("s")).select("s.metric", F.explode(F.coalesce("s.values", F.array("s.value"))).alias("p")).filter(F.size("p") >= 2)
    label = lambda name: F.nullif(F.try_element_at("metric", F.lit(name)), F.lit(""))
    number = F.get("p", 1).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    at = F.floor(F.get("p", 0).try_cast("double")).cast("long")
    host = F.coalesce(label("host_name"), label("hostname"), label("instance"), F.lit("unknown_host"))
    rows = series.select(host.alias("host"), label("__name__").alias("metric"), at.alias("at"), F.coalesce(finite, F.lit(0.0)).alias("value")).filter(F.col("at").isNotNull())
    rows = rows.filter(F.col("at") >= start_s) if start_s is not None else rows
    return rows.filter(F.col("at") < end_s) if end_s is not None else rows


def pivot_metrics(points: DataFrame, names: list[str]) -> DataFrame:
    """A row for each host and time with a column for each named metric; the greatest of repeated points, 0 where there is none."""
    wide = points.groupBy("host", "at").pivot("metric", names).agg(F.max("value"))
    return wide.select("host", "at", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])


def append_new(batch: DataFrame, path: str, key: list[str], columns: list[str], batch_id: str = "0") -> None:
    """Stores the rows of a batch whose key no other batch holds; unknown columns are refused.

    A batch has a folder of its own, which it overwrites, so one that is tried
    again is stored once. Two batches that are written at one time may both
    hold a key; ``read_once`` gives it once.
    """
    unknown = set(batch.columns) - set(columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    spark = batch.sparkSession
    new = batch.dropDuplicates(key)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        others = spark.read.option("basePath", path).parquet(path).filter(F.col("batch").cast("string") != batch_id)
        new = new.join(others.select(*key), key, "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_once(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The rows stored by ``append_new``, each key once."""
    return spark.read.option("basePath", path).parquet(path).drop("batch").dropDuplicates(key)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Logs, metrics, alerts or predictions as JSON lines."""
    df.write.mode("append").json(path)
