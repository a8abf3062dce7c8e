"""Streams that expire keys, route bad and late rows, and count stages; answers of range queries."""

import pandas as pd
from pyspark.sql import functions as F

from opsloom.operators.counters import StageCounters
from opsloom.sources import readers
from opsloom.streaming import jobs, routing

DAY = 86_400


def judge():
    number = F.expr("try_cast(raw AS bigint)")
    return F.timestamp_seconds(number), {"no number": number.isNull()}


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "raw string")


def found(spark, root, attempts):
    return sorted((r.raw, r.outcome, r.reason, r.attempt, r.origin) for r in routing.outcomes(spark, root, attempts).collect())


def test_each_row_has_one_outcome_though_batches_and_replays_run_twice(spark, tmp_path):
    root = f"file://{tmp_path}"
    first, second = texts(spark, str(9 * DAY), "x", "1o"), texts(spark, str(9 * DAY + 5), str(8 * DAY), str(8 * DAY - 1), None)
    for number, batch in ((0, first), (1, second), (1, second)):
        routing.route_batch(batch, number, root, *judge())
    for n in (2, 2, 3):
        routing.replay(spark, root, n, lambda raw: F.regexp_replace(raw, "o", "0"), *judge())
    got = {(r.raw, r.outcome, r.reason, r.attempt, r.origin) for r in routing.outcomes(spark, root, 3).collect()}
    assert routing.outcomes(spark, root, 3).count() == 7
    assert got == {
        (str(9 * DAY), "good", None, 1, 0), (str(9 * DAY + 5), "good", None, 1, 1), (str(8 * DAY), "good", None, 1, 1), (str(8 * DAY - 1), "late", None, 1, 1),
        ("10", "good", None, 2, 0), ("x", "dead", "no number", 3, 0), (None, "dead", "no number", 3, 1),
    }


def test_empty_batches_keep_the_clock(spark, tmp_path):
    root = f"file://{tmp_path}"
    for number, batch in enumerate((texts(spark), texts(spark, str(9 * DAY)), texts(spark), texts(spark, "1"))):
        routing.route_batch(batch, number, root, *judge())
    routing.replay(spark, root, 2, lambda raw: raw, *judge())
    assert found(spark, root, 2) == [("1", "late", None, 1, 3), (str(9 * DAY), "good", None, 1, 1)]


def test_a_silent_user_leaves_the_state(spark, tmp_path):
    """Three deliveries with a restart before each: user 1 goes on, user 2 is away for longer than the time to live."""
    rows = [[(1, 0, 1), (2, 0, 2)], [(1, 45, 3)], [(1, 46, 4), (2, 46, 5)]]
    seen = []
    for i, batch in enumerate(rows):
        df = pd.DataFrame([(u, pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), e, 30.0) for u, d, e in batch], columns=["user_id", "at", "event_id", "value"])
        spark.createDataFrame(df, "user_id long, at timestamp, event_id long, value double").write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.detector(spark.readStream.schema("user_id long, at timestamp, event_id long, value double").parquet(f"{tmp_path}/in"))
        w = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        w.foreachBatch(lambda b, n, i=i: seen.extend((i, r.user_id, r.n) for r in b.collect())).start().awaitTermination()
    assert sorted(seen) == [(0, 1, 1), (0, 2, 1), (1, 1, 2), (2, 1, 3), (2, 2, 1)]


def test_counts_of_a_batch_job(spark, tmp_path):
    counters = StageCounters()
    read = counters.mark(spark.range(100), "read")
    even = counters.mark(read.filter("id % 2 = 0"), "even")
    counters.mark(even.groupBy((F.col("id") % 7).alias("k")).count(), "groups").write.parquet(f"{tmp_path}/out")
    assert {r.stage: r.n for r in counters.table(spark).collect()} == {"read": 100, "even": 50, "groups": 7}


def test_answers_of_range_and_instant_queries(spark, tmp_path):
    docs = [
        '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"__name__":"cpu","instance":"b","host_name":"a"},"values":[[1704067200,"1.5"],[1704067260.9,"NaN"],[1704067320,"+Inf"],["x","1"],[5]]}]}}',
        '{"status":"success","data":{"resultType":"vector","result":[{"metric":{"__name__":"mem"},"value":[1704067200,"x"]},{"metric":null,"values":null}]}}',
        '{"status":"error"}',
        "no JSON",
    ]
    (tmp_path / "day=2024-01-01").mkdir()
    (tmp_path / "day=2024-01-02").mkdir()
    (tmp_path / "day=2024-01-01" / "a.json").write_text("\n".join(docs))
    (tmp_path / "day=2024-01-02" / "a.json").write_text(docs[0].replace("170406", "170415"))
    rows = readers.read_query_range(spark, str(tmp_path), end_s=1704153600)
    t = 1704067200
    assert sorted(map(tuple, rows.collect())) == [("a", "cpu", t, 1.5), ("a", "cpu", t + 60, 0.0), ("a", "cpu", t + 120, 0.0), ("unknown_host", "mem", t, 0.0)]
    assert readers.read_query_range(spark, str(tmp_path), start_s=t + 60, end_s=t + 120).count() == 1
    assert "PartitionFilters: [isnotnull(day" in rows._jdf.queryExecution().toString()
    wide = readers.pivot_metrics(rows, ["cpu", "mem"]).orderBy("host", "at").collect()
    assert [tuple(r) for r in wide] == [("a", t, 1.5, 0.0), ("a", t + 60, 0.0, 0.0), ("a", t + 120, 0.0, 0.0), ("unknown_host", t, 0.0, 0.0)]
