"""Time-series rollups, gap filling, baselines and anomaly classes over ``events``.

The entity is ``event_type`` for dense grids and ``user_id`` elsewhere; times
are hours, since the test events are sparse.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import epoch_ms, safe_ratio, trunc
from opsloom.operators import aggregates as ag
from opsloom.operators import timeseries as ts
from opsloom.tables import table

HOUR, DAY = 3_600_000, 86_400_000


def _events(spark, d):
    return table(spark, d, "events")


def _rolled(spark, d, unit="hour"):
    return ts.rollup_avg(_events(spark, d), unit, "ts", ["event_type"], "value")


def minute_rollup_avg(spark, d):
    return _events(spark, d).groupBy(trunc("minute", "ts").alias("ts_minute"), "event_type").agg(
        F.round(F.avg("value"), 6).alias("avg_value"), F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.sum("value"), 4).alias("sum_value")
    )


def _filled(spark, d):
    return ts.gap_fill(_rolled(spark, d), "ts", ["event_type"], "value")


def gap_fill_minute(spark, d):
    """The dense one-minute grid."""
    out = ts.gap_fill(ts.rollup_avg(_events(spark, d), "minute", "ts", ["event_type"], "value"), "ts", ["event_type"], "value", "1 MINUTE")
    return out.select("ts", "event_type", F.round("value", 6).alias("value"))


def dense_hours(spark, d):
    return _filled(spark, d).select("ts", "event_type", F.round("value", 6).alias("value"))


def dense_eval_series(spark, d):
    """The last 15 hours before the latest, for the event types of the last day, zero where silent."""
    e = _events(spark, d)
    now = e.select(trunc("hour", F.max("ts")).alias("now"))
    bounds = now.select((F.col("now") - F.expr("INTERVAL 15 HOUR")).alias("start"), (F.col("now") - F.expr("INTERVAL 1 HOUR")).alias("end"))
    active = e.crossJoin(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 DAY")).select("event_type").distinct()
    grid = ts.dense_grid(active, bounds, "ts", "1 HOUR")
    return grid.join(_rolled(spark, d), ["ts", "event_type"], "left").select("ts", "event_type", F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"))


def anomaly_classify(spark, d):
    bands = ts.robust_bands(_filled(spark, d), ["event_type"], "value")
    flagged = (F.col("value") > F.col("upper_bound")) | (F.col("value") < F.col("lower_bound"))
    return bands.select(
        "event_type", "ts", F.round("value", 6).alias("actual"), F.round(F.greatest(F.lit(0.0), F.col("lower_bound")), 6).alias("expected_lower_bound"),
        F.round("upper_bound", 6).alias("expected_upper_bound"), flagged.alias("is_anomaly"), ts.anomaly_class(F.col("value"), F.col("lower_bound"), F.col("upper_bound"), flagged).alias("anomaly_class"),
    )


def recent_window_asof(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 DAY")).select("event_id", "ts", "event_type")


def row_number_first_last(spark, d):
    w = Window.partitionBy("user_id")
    up, down = w.orderBy("ts", "event_id"), w.orderBy(F.desc("ts"), F.desc("event_id"))
    e = _events(spark, d).select("user_id", "event_id", "value", F.row_number().over(up).alias("a"), F.row_number().over(down).alias("z"))
    return e.groupBy("user_id").agg(F.max(F.when(F.col("a") == 1, F.col("value"))).alias("first_value"), F.max(F.when(F.col("z") == 1, F.col("value"))).alias("last_value"))


def tumbling_window(spark, d):
    w = F.window("ts", "2 hours", startTime="30 minutes")
    return _events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "avg_value")


def feature_windows(spark, d):
    """Windows from the first day on; origin and end are read from the data (one row)."""
    e = _events(spark, d)
    span = e.agg(epoch_ms(trunc("day", F.min("ts"))).alias("a"), (epoch_ms(F.max("ts")) + 1).alias("z")).first()
    out = ts.feature_windows(e, "ts", ["event_type"], "value", span["a"] or 0, 7 * HOUR, span["z"] or 0)
    return out.select("bucket_start", "bucket_end", "event_type", "min", "max", "count", "first", "last", *[F.round(c, 6).alias(c) for c in ("mean", "sum", "stddev", "delta", "rate_per_s")])


def series_generate(spark, d):
    """Every five minutes from the first event to the last, cut to the hour."""
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    span = _events(spark, d).agg(hour(F.min("ts")).alias("first"), hour(F.max("ts")).alias("last"))
    return span.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 5 MINUTES"))).alias("ts"))


def counter_rate(spark, d):
    """A counter per user made by running sums that start anew every day."""
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, d).withColumn("counter", F.round(F.sum("value").over(day), 4))
    return ts.counter_rate(e, ["user_id"], "ts", "counter").select("event_id", "counter", F.round("rate", 6).alias("rate"))


def align_resample(spark, d):
    e = _events(spark, d)
    samples = e.groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    users = e.select("user_id").distinct()
    bounds = e.select(trunc("day", F.min("ts")).alias("start"), trunc("day", F.max("ts")).alias("end"))
    axis = ts.dense_grid(users, bounds, "ts", "6 HOURS")
    return ts.align_resample(axis, samples, ["user_id"], "ts", "value")


def range_frame_5m(spark, d):
    w = Window.partitionBy("user_id").orderBy(epoch_ms("ts")).rangeBetween(-6 * HOUR, 0)
    return _events(spark, d).select("event_id", F.count("*").over(w).alias("n"), F.max("value").over(w).alias("max_value"), F.round(F.avg("value").over(w), 6).alias("avg_value"))


LEVELS = {"global": ["event_type"], "hour": ["event_type", "hour"], "cell": ["event_type", "dow", "hour"]}


def seasonal_baseline_score(spark, d):
    e = _events(spark, d).groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    e = e.withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts")})
    b = ts.prequential_baseline(e, LEVELS, "ts", "value")
    center = ts.shrink(F.col("n_hour"), F.col("med_hour"), F.col("med_global"))
    center = ts.shrink(F.col("n_cell"), F.col("med_cell"), center)
    sigma = ts.shrink(F.col("n_hour"), F.col("mad_hour"), F.col("mad_global"))
    sigma = ts.shrink(F.col("n_cell"), F.col("mad_cell"), sigma) * ts.SIGMA_OF_MAD
    scale = F.greatest(sigma, F.lit(0.01), F.abs(center) * 0.05)
    z = F.when(F.col("n_global") >= 12, (F.col("value") - center) / scale).otherwise(F.lit(0.0))
    return b.select("event_type", "ts", F.col("n_global").cast("long").alias("n_prior"), F.round(center, 6).alias("center"), F.round(sigma, 6).alias("sigma"), F.round(z, 6).alias("z"))


def seasonal_profile_168h(spark, d):
    cells = _events(spark, d).select("event_type", F.weekday("ts").cast("long").alias("dow"), F.hour("ts").cast("long").alias("hour"), "value")
    keys = ["event_type", "dow", "hour"]
    return ag.exact_quantiles(cells, keys, "value", {"median_value": 0.5}).join(cells.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def episode_sessionize(spark, d):
    e = ts.episodes(_events(spark, d).filter("event_type = 'error'"), ["user_id"], "ts", 6 * 3600)
    return e.groupBy("user_id", "episode").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def dwell_streak(spark, d):
    return ts.streaks(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("value") >= 20).select("event_id", F.col("streak").cast("long").alias("streak"))


def onset_episode(spark, d):
    s = ts.streaks(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("value") >= 10)
    return s.filter("streak > 0").groupBy("user_id", "island").agg(F.min("ts").alias("onset"), F.max("ts").alias("last_seen"), F.max("streak").cast("long").alias("steps")).drop("island")


def interval_forecast(spark, d):
    """Seasonal-naive forecast of the next 24 hours with robust bands, by hour of day."""
    f = _filled(spark, d).withColumn("hour", F.hour("ts").cast("long"))
    last = f.agg(F.max("ts").alias("last"))
    bands = ts.robust_bands(f, ["event_type", "hour"], "value", 1.959964).select("event_type", "hour", "center", "lower_bound", "upper_bound").distinct()
    ahead = F.explode(F.sequence(F.col("last") + F.expr("INTERVAL 1 HOUR"), F.col("last") + F.expr("INTERVAL 24 HOUR"), F.expr("INTERVAL 1 HOUR")))
    steps = last.select(ahead.alias("ts")).withColumn("hour", F.hour("ts").cast("long"))
    return bands.join(F.broadcast(steps), "hour").select("event_type", "ts", F.round("center", 6).alias("forecast"), F.round("lower_bound", 6).alias("lower_bound"), F.round("upper_bound", 6).alias("upper_bound"))


def cpu_to_throughput(spark, d):
    h = _events(spark, d).groupBy(trunc("day", "ts").alias("day")).agg(F.sum(F.when(F.col("event_type") == "error", F.col("value"))).alias("errors"), F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("views"))
    return h.select("day", F.round(safe_ratio(F.col("errors"), F.col("views")), 6).alias("ratio"))


NAMES = [
    minute_rollup_avg, gap_fill_minute, dense_hours, dense_eval_series, anomaly_classify, recent_window_asof, row_number_first_last, tumbling_window, feature_windows,
    series_generate, counter_rate, align_resample, range_frame_5m, seasonal_baseline_score, seasonal_profile_168h, episode_sessionize, dwell_streak, onset_episode, interval_forecast, cpu_to_throughput,
]
QUERIES = {f.__name__: f for f in NAMES}

_ROLLED = "rolled AS (SELECT date_trunc('hour', ts) AS ts, event_type, avg(value) AS value FROM events GROUP BY ALL)"
_FILLED = (
    _ROLLED
    + """, b AS (SELECT min(ts) AS s, max(ts) AS e FROM rolled),
grid AS (SELECT unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS ts, event_type FROM b, (SELECT DISTINCT event_type FROM rolled)),
filled AS (SELECT g.ts, g.event_type, coalesce(r.value, 0.0) AS value FROM grid g LEFT JOIN rolled r USING (ts, event_type))"""
)
_SIG = ts.SIGMA_OF_MAD
_T = "(epoch_us(ts) // 1000)"


def _level(name, keys):
    w = f"PARTITION BY {', '.join(keys)} ORDER BY ts ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING"
    return f"count(value) OVER ({w}) AS n_{name}, median(value) OVER ({w}) AS med_{name}, mad(value) OVER ({w}) AS mad_{name}"


def _shrink(n, a, b):
    return f"(CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {n} / ({n} + 20.0::DOUBLE) * {a} + (1 - {n} / ({n} + 20.0::DOUBLE)) * {b} END)"


_CENTER = _shrink("n_cell", "med_cell", _shrink("n_hour", "med_hour", "med_global"))
_SIGMA = _shrink("n_cell", "mad_cell", _shrink("n_hour", "mad_hour", "mad_global"))

ORACLE = {
    "minute_rollup_avg": "SELECT date_trunc('minute', ts) AS ts_minute, event_type, round(avg(value), 6) AS avg_value, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(sum(value), 4) AS sum_value FROM events GROUP BY ALL",
    "gap_fill_minute": """WITH r AS (SELECT date_trunc('minute', ts) AS ts, event_type, avg(value) AS value FROM events GROUP BY ALL),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM r), (SELECT max(ts) FROM r), INTERVAL 1 MINUTE)) AS ts)
SELECT g.ts, h.event_type, round(coalesce(r.value, 0.0), 6) AS value FROM g CROSS JOIN (SELECT DISTINCT event_type FROM r) h LEFT JOIN r ON r.ts = g.ts AND r.event_type = h.event_type""",
    "dense_hours": f"WITH {_FILLED} SELECT ts, event_type, round(value, 6) AS value FROM filled",
    "dense_eval_series": f"""WITH {_ROLLED}, n AS (SELECT date_trunc('hour', max(ts)) AS now FROM events)
SELECT g.ts, g.event_type, round(coalesce(r.value, 0.0), 6) AS value FROM (SELECT unnest(generate_series(now - INTERVAL 15 HOUR, now - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts, event_type FROM n, (SELECT DISTINCT event_type FROM events, n WHERE ts >= now - INTERVAL 1 DAY)) g
LEFT JOIN rolled r ON r.ts = g.ts AND r.event_type = g.event_type""",
    "anomaly_classify": f"""WITH {_FILLED}, c AS (SELECT event_type, median(value) AS center, mad(value) * {_SIG}::DOUBLE AS sigma FROM filled GROUP BY ALL),
x AS (SELECT f.*, center - 3 * sigma AS lo, center + 3 * sigma AS hi FROM filled f JOIN c USING (event_type))
SELECT event_type, ts, round(value, 6) AS actual, round(greatest(0.0, lo), 6) AS expected_lower_bound, round(hi, 6) AS expected_upper_bound, (value > hi OR value < lo) AS is_anomaly,
CASE WHEN value > hi THEN 'SPIKE_ANOMALY' WHEN value < lo AND value = 0 THEN 'SILENT_HOST_DROP_TO_ZERO' WHEN value < lo THEN 'DIP_ANOMALY' ELSE 'NORMAL' END AS anomaly_class FROM x""",
    "recent_window_asof": "SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "row_number_first_last": "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL",
    "tumbling_window": "SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01 00:30:00') AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL",
    "feature_windows": f"""WITH o AS (SELECT epoch_ms(date_trunc('day', min(ts))::TIMESTAMP) AS a, max({_T}) + 1 AS z FROM events),
r AS (SELECT *, {_T} AS t, CAST(floor(({_T} - a) / {7 * HOUR}.0) AS BIGINT) * {7 * HOUR} + a AS bucket_start FROM events, o),
g AS (SELECT bucket_start, event_type, any_value(z) AS z, avg(value) AS mean, min(value) AS min, max(value) AS max, sum(value) AS sum, count(*) AS count, stddev_samp(value) AS stddev, min({{'t': t, 'v': value}}) AS f, max({{'t': t, 'v': value}}) AS l FROM r GROUP BY bucket_start, event_type)
SELECT bucket_start, least(bucket_start + {7 * HOUR}, z) AS bucket_end, event_type, min, max, count, f.v AS first, l.v AS last, round(mean, 6) AS mean, round(sum, 6) AS sum, round(stddev, 6) AS stddev, round(l.v - f.v, 6) AS delta,
round(CASE WHEN l.t > f.t THEN (l.v - f.v) / ((l.t - f.t) / 1000.0::DOUBLE) END, 6) AS rate_per_s FROM g""",
    "series_generate": "SELECT unnest(generate_series(date_trunc('hour', min(ts))::TIMESTAMP, date_trunc('hour', max(ts))::TIMESTAMP, INTERVAL 5 MINUTE)) AS ts FROM events",
    "counter_rate": f"""WITH c AS (SELECT *, round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS counter FROM events),
x AS (SELECT *, ({_T} - lag({_T}) OVER w) / 1000.0::DOUBLE AS dt, counter - lag(counter) OVER w AS dv FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, counter, round(CASE WHEN dv >= 0 AND dt > 0 THEN dv / dt END, 6) AS rate FROM x""",
    "align_resample": f"""WITH s AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL),
st AS (SELECT user_id, median(d) AS step FROM (SELECT user_id, {_T} - lag({_T}) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM s) GROUP BY ALL),
ax AS (SELECT user_id, unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT date_trunc('day', max(ts)) FROM events), INTERVAL 6 HOUR)) AS ts FROM (SELECT DISTINCT user_id FROM events))
SELECT ax.user_id, ax.ts, CASE WHEN epoch_ms(ax.ts) - epoch_ms(s.ts) <= st.step * 4 THEN s.value END AS value FROM ax ASOF LEFT JOIN s ON ax.user_id = s.user_id AND ax.ts >= s.ts LEFT JOIN st ON st.user_id = ax.user_id""",
    "range_frame_5m": f"SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS max_value, round(avg(value) OVER w, 6) AS avg_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_T} RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)",
    "seasonal_baseline_score": f"""WITH e AS (SELECT event_type, ts, max(value) AS value, hour(ts) AS hour, isodow(ts) AS dow FROM events GROUP BY event_type, ts),
x AS (SELECT *, {_level("global", ["event_type"])}, {_level("hour", ["event_type", "hour"])}, {_level("cell", ["event_type", "dow", "hour"])} FROM e),
y AS (SELECT *, {_CENTER} AS c, {_SIGMA} * {_SIG}::DOUBLE AS s FROM x)
SELECT event_type, ts, n_global AS n_prior, round(c, 6) AS center, round(s, 6) AS sigma, round(CASE WHEN n_global >= 12 THEN (value - c) / greatest(s, 0.01::DOUBLE, abs(c) * 0.05::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS z FROM y""",
    "seasonal_profile_168h": "SELECT event_type, isodow(ts) - 1 AS dow, hour(ts) AS hour, median(value) AS median_value, count(*) AS n FROM events GROUP BY ALL",
    "episode_sessionize": f"""WITH x AS (SELECT user_id, ts, CASE WHEN {_T} - lag({_T}) OVER (PARTITION BY user_id ORDER BY ts) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM events WHERE event_type = 'error'),
y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM x)
SELECT user_id, episode, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM y GROUP BY ALL""",
    "dwell_streak": """WITH x AS (SELECT *, sum(CASE WHEN value >= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT event_id, CAST(sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM x""",
    "onset_episode": """WITH x AS (SELECT *, sum(CASE WHEN value >= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, min(ts) AS onset, max(ts) AS last_seen, count(*) AS steps FROM x WHERE value >= 10 GROUP BY user_id, island""",
    "interval_forecast": f"""WITH {_FILLED}, c AS (SELECT event_type, hour(ts) AS hour, median(value) AS center, mad(value) * {_SIG}::DOUBLE AS sigma FROM filled GROUP BY ALL),
s AS (SELECT unnest(generate_series(max(ts) + INTERVAL 1 HOUR, max(ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS ts FROM filled)
SELECT event_type, s.ts, round(center, 6) AS forecast, round(center - 1.959964::DOUBLE * sigma, 6) AS lower_bound, round(center + 1.959964::DOUBLE * sigma, 6) AS upper_bound FROM c JOIN s ON hour(s.ts) = c.hour""",
    "cpu_to_throughput": """SELECT day, round(CASE WHEN v > 0 THEN e / v END, 6) AS ratio FROM (SELECT date_trunc('day', ts) AS day, sum(value) FILTER (WHERE event_type = 'error') AS e, sum(value) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY ALL)""",
}
