"""Model queries: bands with probabilities, regressors, classifiers."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opsloom.functions.feature_catalog import FEATURES, derive, inputs, to_sql
from opsloom.functions.scalar import logistic
from opsloom.operators.aggregates import SIGMA_OF_MAD
from opsloom.operators.joins import covered_join
from opsloom.operators.timeseries import gap_fill, rollup_avg, robust_bands
from opsloom.plans.relational import CHANGES_SQL, changes, ev
from opsloom.tables import table


def detect_anomalies(s, d):
    """Two-sided probability of the robust z (logistic approximation of the normal), flagged over 0.95."""
    series = gap_fill(rollup_avg(ev(s, d), "hour", "ts", ["event_type"], "value"), "ts", ["event_type"], "value")
    z = F.abs(F.col("value") - F.col("center")) / F.greatest(F.col("sigma"), F.lit(0.01))
    b = robust_bands(series, ["event_type"], "value").withColumn("p", 2 * logistic(1.702 * z) - 1)
    return b.select("event_type", "ts", F.round("p", 6).alias("anomaly_probability"), (F.round("p", 6) > 0.95).alias("is_anomaly"))


def xreg_bands(s, d):
    """Bands after a closed-form regression on the maintenance flag."""
    c = changes(s, d)
    e = ev(s, d)
    flagged = covered_join(e, c, ["user_id"], "ts", "start_ts", "end_ts", "left_semi", ["entity"]).select("event_id", F.lit(1.0).alias("m"))
    x = e.join(flagged, "event_id", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    fit = x.groupBy("event_type").agg(F.avg(F.when(F.col("m") == 0, F.col("value"))).alias("base"), F.avg(F.when(F.col("m") == 1, F.col("value"))).alias("during"))
    r = x.join(fit, "event_type").withColumn("residual", F.col("value") - F.when(F.col("m") == 1, F.coalesce("during", "base")).otherwise(F.col("base")))
    return r.groupBy("event_type").agg(F.round(F.first("base"), 6).alias("base"), F.round(F.first(F.col("during") - F.col("base")), 6).alias("effect"), F.round(F.stddev_samp("residual"), 6).alias("sigma"))


def _frame(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("price"), (F.col("c_acctbal") / 1000).alias("balance"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_totalprice") > 250000).cast("double").alias("label"), (F.col("o_orderkey") % 3).cast("double").alias("kind"))


def logistic_classifier(s, d):
    """Balanced class weights, L2 0.1, 50 iterations."""
    f = VectorAssembler(inputCols=["price", "balance", "month"], outputCol="x").transform(_frame(s, d))
    n = f.agg(F.avg("label").alias("p"))
    f = f.crossJoin(F.broadcast(n)).withColumn("w", F.when(F.col("label") == 1, 0.5 / F.col("p")).otherwise(0.5 / (1 - F.col("p"))))
    m = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=0.1, maxIter=50).fit(f)
    scored = m.transform(f).withColumn("p_of", vector_to_array("probability"))
    return scored.select("o_orderkey", F.round(F.get("p_of", F.lit(1)), 4).alias("probability"), F.transform("p_of", lambda p: F.round(p, 4)).alias("probabilities"), "label")


def root_cause_classifier(s, d):
    """Multi-class trees (boosted trees in Spark are binary)."""
    f = VectorAssembler(inputCols=["price", "balance", "month"], outputCol="x").transform(_frame(s, d).withColumn("kind", F.floor(F.col("price")).cast("double")))
    m = RandomForestClassifier(featuresCol="x", labelCol="kind", numTrees=20, maxDepth=6, subsamplingRate=0.8, seed=42).fit(f)
    return m.transform(f).groupBy("kind", "prediction").agg(F.count("*").alias("n"))


PARTS = 20


def derived_features(s, d):
    """All features of the catalogue over a wide frame: an input is the sum of an event type's daily values in one of 20 parts of the ids."""
    part = F.col("event_id") % PARTS
    wide = ev(s, d).groupBy(F.col("event_type").alias("entity"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(*[F.sum(F.when(part == i % PARTS, F.col("value"))).alias(c) for i, c in enumerate(inputs())])
    return derive(wide.withColumn("kind", F.lit("unknown"))).select("entity", "ts", "feature", F.round("value", 4).alias("value"))


NAMES = [detect_anomalies, xreg_bands, logistic_classifier, root_cause_classifier, derived_features]
QUERIES = {f.__name__: f for f in NAMES}
ORACLE = {
    "detect_anomalies": f"""WITH rolled AS (SELECT date_trunc('hour', ts) AS ts, event_type, avg(value) AS value FROM events GROUP BY ALL), b AS (SELECT min(ts) AS s, max(ts) AS e FROM rolled),
grid AS (SELECT unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS ts, event_type FROM b, (SELECT DISTINCT event_type FROM rolled)), f AS (SELECT g.ts, g.event_type, coalesce(r.value, 0.0) AS value FROM grid g LEFT JOIN rolled r USING (ts, event_type)),
c AS (SELECT event_type, median(value) AS center, mad(value) * {SIGMA_OF_MAD}::DOUBLE AS sigma FROM f GROUP BY ALL), p AS (SELECT f.event_type, ts, round(2 * (1 / (1 + exp(-(1.702::DOUBLE * abs(value - center) / greatest(sigma, 0.01::DOUBLE))))) - 1, 6) AS p FROM f JOIN c USING (event_type))
SELECT event_type, ts, p AS anomaly_probability, p > 0.95 AS is_anomaly FROM p""",
    "xreg_bands": f"""WITH {CHANGES_SQL}, x AS (SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM changes c WHERE c.entity = e.user_id AND e.ts BETWEEN start_ts AND end_ts) THEN 1 ELSE 0 END AS m FROM events e),
f AS (SELECT event_type, avg(value) FILTER (WHERE m = 0) AS base, avg(value) FILTER (WHERE m = 1) AS during FROM x GROUP BY ALL)
SELECT event_type, round(any_value(base), 6) AS base, round(any_value(during - base), 6) AS effect, round(stddev_samp(value - CASE WHEN m = 1 THEN coalesce(during, base) ELSE base END), 6) AS sigma FROM x JOIN f USING (event_type) GROUP BY event_type""",
    "derived_features": f"""WITH w AS (SELECT event_type AS entity, date_trunc('day', ts)::TIMESTAMP AS ts, {", ".join(f"sum(value) FILTER (WHERE event_id % {PARTS} = {i % PARTS}) AS {c}" for i, c in enumerate(inputs()))} FROM events GROUP BY ALL)
""" + " UNION ALL ".join(f"SELECT entity, ts, '{n}' AS feature, round(({to_sql(f).replace('0.0D', '0.0::DOUBLE').replace('1.0D', '1.0::DOUBLE')})::DOUBLE, 4) AS value FROM w WHERE ({to_sql(f).replace('0.0D', '0.0::DOUBLE').replace('1.0D', '1.0::DOUBLE')}) IS NOT NULL" for n, _, f, *_ in FEATURES),
}
