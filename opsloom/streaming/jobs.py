"""Structured Streaming twins of the batch operators.

Each job reads a folder or file as a stream, runs with the available-now
trigger and leaves a Parquet table in the shared checkpoint folder, so that its
result can be held against the batch operator's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsloom import schemas
from opsloom.operators.counters import StreamCounters, mark_stream
from opsloom.shared import shared_dir
from opsloom.streaming import routing
from opsloom.tables import table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.readStream.schema(schemas.EVENT).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that a single file will do
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def run_now(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream over what is there and returns its rows, with the ``batch`` that wrote each in update mode.

    Append goes to a table. In update mode every batch overwrites a folder of
    its own number, so that a batch that is tried again is not written twice.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    out = f"{root}/out"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    w.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()
    return spark.read.schema(df.schema.add("batch", "long")).parquet(out)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's updates the last."""
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by event type; windows leave the state a day after their end."""
    e = event_stream(spark, sf_dir).withWatermark("at", "1 day")
    counts = e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    out = latest(run_now(counts, "update", "tumbling"), ["w", "event_type"])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "max_value")


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events repeated on purpose, each kept once; state is bounded by the watermark."""
    e = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = e.withWatermark("at", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    return run_now(once.select("event_id", "event_type"), "append", "dedupe")


def session_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of a user's errors with a gap of six hours; a session closes, and leaves the state, a day after its end."""
    e = event_stream(spark, sf_dir).filter("event_type = 'error'").withWatermark("at", "1 day")
    out = run_now(e.groupBy(F.session_window("at", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")), "append", "sessions")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def count_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five events of a user, moving by two, in order within each batch; the state is the events of the open window."""
    size, stride = 5, 2

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(rows)).sort_values(["at", "event_id"])["event_id"].tolist()
        out = []
        for x in new:
            held.append(x)
            if len(held) == size:
                out.append(",".join(map(str, held)))
                held = held[stride:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ids": out})

    e = event_stream(spark, sf_dir).select("user_id", "at", "event_id")
    s = e.groupBy("user_id").applyInPandasWithState(step, "user_id long, ids string", "held array<long>", "append", GroupStateTimeout.NoTimeout)
    return run_now(s, "append", "chunks")


HISTORY_S = 1800
#: Rows that arrive later than this behind the newest row are dropped; a user silent for ``TTL_MS`` behind that leaves the state.
DELAY = "7 days"
TTL_MS = 30 * 86_400_000


def detector(e: DataFrame) -> DataFrame:
    """Per-user state across batches: rows seen, rows over the threshold, the streak of such rows, alerts fired, late rows.

    A streak of two fires, and not again within a day. The state also holds the
    last ``HISTORY_S`` seconds of values; ``recent`` is their number. Rows older
    than a day behind the latest seen before are late: counted, not judged. A user
    without rows for ``TTL_MS`` of event time leaves the state and starts anew.
    """
    schema = "user_id long, n long, over long, streak long, fired long, recent long, late long"
    held = "n long, over long, streak long, fired long, late long, last_fired double, last double, history array<double>"

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, over, streak, fired, late, last_fired, last, history = state.get if state.exists else (0, 0, 0, 0, 0, -1e18, -1e18, [])
        history, seen = list(history), last
        b = pd.concat(list(rows)).sort_values(["at", "event_id"])
        seconds = b["at"].astype("datetime64[ns]").astype("int64") / 1e9
        for at, value in zip(seconds, b["value"], strict=True):
            n += 1
            if at < seen - 86400:
                late += 1
                continue
            high = value >= 20
            over, streak = over + high, streak + 1 if high else 0
            if streak >= 2 and at - last_fired >= 86400:
                fired, last_fired = fired + 1, at
            last = max(last, at)
            history.append(at)
        history = [t for t in history if t > last - HISTORY_S]
        state.update((n, int(over), int(streak), fired, late, last_fired, last, history))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + TTL_MS)
        yield pd.DataFrame([[key[0], n, int(over), int(streak), fired, len(history), late]], columns=["user_id", "n", "over", "streak", "fired", "recent", "late"])

    return e.withWatermark("at", DELAY).groupBy("user_id").applyInPandasWithState(step, schema, held, "update", GroupStateTimeout.EventTimeTimeout)


def detector_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).select("user_id", "at", "event_id", "value")
    return latest(run_now(detector(e), "update", "detector"), ["user_id"])


ATTEMPTS = 3


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON texts in three deliveries with a restart between them; some come late, some are cut short, some have no type.

    The mend closes what was cut; what has no type is dead after the last attempt.
    """
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    span = e.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    third = F.least(F.lit(2), F.expr("(us - lo) * 3 div (hi - lo + 1)"))
    wave = F.when((third == 0) & (F.col("event_id") % 11 == 0), 2).otherwise(third)
    text = F.to_json(F.struct("event_id", F.col("us").alias("at_us"), F.when(F.col("event_id") % 19 != 0, F.col("event_type")).alias("event_type")))
    cut = F.when(F.col("event_id") % 17 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    texts = e.crossJoin(F.broadcast(span)).select("event_id", wave.alias("wave"), text.alias("text")).select("wave", cut.alias("value"))  # the span is one row
    root = f"{shared_dir(spark)}/routing-{uuid.uuid4().hex}"
    x = F.from_json("raw", "event_id long, at_us long, event_type string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    at = F.timestamp_micros(x["at_us"])
    rules = {"not JSON": x["_bad"].isNotNull(), "no time": x["at_us"].isNull(), "no event_type": x["event_type"].isNull()}
    for n in range(3):
        texts.filter(F.col("wave") == n).select("value").write.mode("append").text(f"{root}/in")
        raw = spark.readStream.text(f"{root}/in").withColumnRenamed("value", "raw")
        routed = raw.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        routed.foreachBatch(lambda b, i: routing.route_batch(b, i, root, at, rules)).start().awaitTermination()
    for n in range(2, ATTEMPTS + 1):
        routing.replay(spark, root, n, lambda raw: F.when(raw.endswith("}"), raw).otherwise(F.concat(raw, F.lit("}"))), at, rules)
    ident = F.regexp_extract("raw", r'"event_id":(\d+)', 1).cast("long")
    return routing.outcomes(spark, root, ATTEMPTS).select(ident.alias("event_id"), "outcome", "reason", "attempt", F.col("origin").alias("batch"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass each stage of a stream: read, those of a value, alerts among them; counted by a listener."""
    root = f"{shared_dir(spark)}/counted-{uuid.uuid4().hex}"
    read = mark_stream(event_stream(spark, sf_dir), "read")
    valued = mark_stream(read.filter("value >= 5"), "valued")
    alerts = mark_stream(valued.filter("event_type = 'error'"), "alerts")
    counters = StreamCounters()
    spark.streams.addListener(counters)
    try:
        w = alerts.select("event_id").writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        query = w.format("parquet").option("path", f"{root}/out").start()
        query.awaitTermination()
        return counters.table(spark, query)
    finally:
        spark.streams.removeListener(counters)


QUERIES = {"stream_tumbling": tumbling_counts, "stream_dedupe": dedupe, "stream_sessions": session_episodes, "stream_count_windows": count_chunks, "stream_detector": detector_state, "stream_dead_letters": dead_letters, "stream_stage_counts": stage_counts}
ORACLE = {
    "stream_stage_counts": "SELECT * FROM (VALUES ('read', (SELECT count(*) FROM events)), ('valued', (SELECT count(*) FROM events WHERE value >= 5)), ('alerts', (SELECT count(*) FROM events WHERE value >= 5 AND event_type = 'error'))) t(stage, n)",
    "stream_dead_letters": """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
t AS (SELECT event_id, ts, least(2, (epoch_us(ts) - lo) * 3 // (hi - lo + 1)) AS third FROM events, b),
w AS (SELECT event_id, ts, CASE WHEN third = 0 AND event_id % 11 = 0 THEN 2 ELSE third END AS batch FROM t),
c AS (SELECT k AS batch, max(ts) AS newest FROM range(3) r(k) LEFT JOIN w ON w.batch < k AND event_id % 17 <> 0 AND event_id % 19 <> 0 GROUP BY k)
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'dead' WHEN event_id % 17 = 0 THEN 'good' WHEN ts < newest - INTERVAL 1 DAY THEN 'late' ELSE 'good' END AS outcome,
CASE WHEN event_id % 19 = 0 THEN 'no event_type' END AS reason, CASE WHEN event_id % 19 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS attempt, w.batch FROM w JOIN c USING (batch)""",
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY ALL",
    "stream_dedupe": "SELECT event_id, event_type FROM events",
    "stream_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'error'),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM x) - INTERVAL 1 DAY""",
    "stream_count_windows": """WITH r AS (SELECT user_id, row_number() OVER w AS rn, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ids FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, array_to_string(ids, ',') AS ids FROM r WHERE rn % 2 = 1 AND len(ids) = 5""",
    "stream_detector": """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, max(ts) OVER (PARTITION BY user_id) AS z FROM events),
r(user_id, rn, streak, fired, last_fired) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::TIMESTAMP FROM e
  UNION ALL SELECT user_id, rn, streak, CASE WHEN fire THEN fired + 1 ELSE fired END, CASE WHEN fire THEN ts ELSE last_fired END FROM (
    SELECT *, streak >= 2 AND (last_fired IS NULL OR ts - last_fired >= INTERVAL 1 DAY) AS fire FROM (
      SELECT e.user_id, e.rn, e.ts, CASE WHEN e.value >= 20 THEN r.streak + 1 ELSE 0 END AS streak, r.fired, r.last_fired FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))),
s AS (SELECT user_id, arg_max(streak, rn) AS streak, max(fired) AS fired FROM r GROUP BY user_id)
SELECT e.user_id, count(*) AS n, count(*) FILTER (WHERE value >= 20) AS over, any_value(s.streak) AS streak, any_value(s.fired) AS fired, count(*) FILTER (WHERE ts > z - INTERVAL 1800 SECOND) AS recent, 0::BIGINT AS late FROM e JOIN s USING (user_id) GROUP BY e.user_id""",
}
