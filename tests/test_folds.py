"""Sequential decisions: edges of the rules, late rows, busy keys."""

import pytest
from pyspark.sql import functions as F

from opsloom.operators import folds, logs


def decisions(spark, times, **kw):
    df = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate(times)], "k string, i long, t double")
    return [r.decision for r in folds.rate_limit(df, ["k"], "t", arrival=["i"], **kw).orderBy("i").collect()]


def test_a_trigger_as_old_as_the_window_does_not_count(spark):
    assert decisions(spark, [0, 900, 1800, 3600]) == ["TRIGGERED"] * 4
    assert decisions(spark, [0, 900, 1800, 3599])[-1] == "RATE_LIMITED_HOURLY_CAP"


def test_late_calls_are_held_against_triggers_on_both_sides(spark):
    assert decisions(spark, [1000, 200, 50, 5000, 1400]) == ["TRIGGERED", "SUPPRESSED_RATE_LIMIT", "TRIGGERED", "TRIGGERED", "TRIGGERED"]


@pytest.mark.parametrize("fold", ["rate", "refractory", "dwell"])
def test_a_busy_key_that_never_rests(spark, fold):
    """A third of a million rows of one key without a pause; the state stays small."""
    n = 300_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("t"), F.lit(1.0).alias("v"))
    if fold == "rate":
        out = {r.decision: r["count"] for r in folds.rate_limit(df, ["k"], "t", 900, 3).groupBy("decision").count().collect()}
        assert sum(out.values()) == n and n // 3600 * 3 <= out["TRIGGERED"] <= -(-n // 900) and set(out) == {"TRIGGERED", "SUPPRESSED_RATE_LIMIT", "RATE_LIMITED_HOURLY_CAP"}
    elif fold == "refractory":
        assert folds.refractory_fire(df, ["k"], "t", "v").count() == -(-(n - 1) // 1800)
    else:
        assert folds.dwell_alerts(df, ["k"], "t", "v", 0.5).count() == -(-(n - 300) // 3600)


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 0.0), (None, 10.0), (1, 10.0)], "k long, t double")
    got = folds.rate_limit(df, ["k"], "t").collect()
    assert sorted(r.decision for r in got) == ["SUPPRESSED_RATE_LIMIT", "TRIGGERED", "TRIGGERED"]


LINES = "k string, t double, id string, sev string, txt string"


def test_a_trace_flushes_at_once(spark):
    df = spark.createDataFrame([("h", 0.0, "a", "INFO", "Traceback (most recent call last):"), ("h", 1.0, "b", "INFO", "next")], LINES)
    got = {tuple(r.log_ids): r.has_stack_trace for r in folds.count_chunks(df, ["k"], "t", "id", "sev", "txt").collect()}
    assert got == {("a",): True, ("b",): False}


def test_a_gap_of_exactly_the_limit_does_not_flush(spark):
    rows = [("h", t, str(i), "INFO", "x") for i, t in enumerate([0.0, 30.0, 30.5])]
    got = sorted(r.log_ids for r in folds.count_chunks(spark.createDataFrame(rows, LINES), ["k"], "t", "id", "sev", "txt").collect())
    assert got == [["0", "1"], ["2"]]


def test_long_chunks_keep_head_and_tail(spark):
    df = spark.createDataFrame([("h", 0.0, "a", "INFO", "x" * 3500 + "y" * 3500)], LINES)
    text = folds.count_chunks(df, ["k"], "t", "id", "sev", "txt").first().chunk_text
    assert text == "x" * 2977 + "\n... [CHUNK TRUNCATED FOR TOKEN LIMIT] ...\n" + "y" * 2977


def test_every_severity_has_its_rank(spark):
    df = spark.createDataFrame([("INFO", "WARN", "WARN"), ("ERROR", "EMERGENCY", "EMERGENCY"), ("FATAL", "ALERT", "ALERT"), ("odd", "NOTICE", "NOTICE")], "a string, b string, top string")
    assert all(r.hit for r in df.select((logs.severity_rank(F.col("b")) > logs.severity_rank(F.col("a"))).alias("hit")).collect())
    two = spark.createDataFrame([("f", 1, "WARN", "at the start"), ("f", 2, "INFO", "\tmore of it")], "f string, n long, sev string, txt string")
    assert [r.sev for r in logs.coalesce_entries(two, ["f"], [], ["n"], "txt", "sev").collect()] == ["WARN"]


def test_a_line_of_a_chunk(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "warn", "api", "h1", "slow")], "t string, s string, v string, h string, x string")
    assert df.select(logs.chunk_line(*map(F.col, "tsvhx"))).first()[0] == "[2024-01-01T00:00:00Z] [WARN] [api@h1] slow"
