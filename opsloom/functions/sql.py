"""Functions that SQL can call: expressions and tables registered in a session, planned by Catalyst like built-in ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "ops_safe_ratio(num DOUBLE, den DOUBLE) RETURNS DOUBLE": "CASE WHEN den > 0 THEN num / den END",
    "ops_clamp(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END",
    "ops_logistic(x DOUBLE) RETURNS DOUBLE": "1 / (1 + exp(-x))",
    "ops_robust_z(x DOUBLE, center DOUBLE, sigma DOUBLE, least_scale DOUBLE) RETURNS DOUBLE": "(x - center) / greatest(sigma, least_scale, abs(center) * 0.05D)",
    "ops_severity(z DOUBLE) RETURNS DOUBLE": "greatest(0.0D, least(1.0D, (z - 1.6D) / 7.4D))",
}
TABLES = {
    "ops_time_grid(first TIMESTAMP_NTZ, last TIMESTAMP_NTZ, step INTERVAL DAY TO SECOND) RETURNS TABLE (ts TIMESTAMP_NTZ)": "SELECT explode(sequence(first, last, step)) AS ts",
}


def register_functions(spark: SparkSession) -> None:
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for signature, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """The tables of a data folder as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
