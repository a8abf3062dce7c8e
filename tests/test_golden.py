"""Small cases with known answers for the operators that SQL cannot express."""

import math

import pytest
from pyspark.sql import functions as F

from opsloom.functions import feature_catalog as fc
from opsloom.functions import scalar
from opsloom.functions.scalar import short_number
from opsloom.functions.embedding import embed_signatures
from opsloom.operators import aggregates as ag
from opsloom.operators import detect, folds, joins, logs, timeseries
from opsloom.operators import vectors as v
from opsloom.operators.vectors import vector_search
from opsloom.sources import readers


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_rate_limit_cooldown(spark):
    df = spark.createDataFrame([("a", 1000.0), ("a", 1120.0), ("a", 2000.0)], "k string, t double")
    assert [r.decision for r in folds.rate_limit(df, ["k"], "t", 900).orderBy("t").collect()] == ["TRIGGERED", "SUPPRESSED_RATE_LIMIT", "TRIGGERED"]


def test_rate_limit_cap(spark):
    df = spark.createDataFrame([("a", t) for t in (100.0, 200.0, 300.0)], "k string, t double")
    assert [r.decision for r in folds.rate_limit(df, ["k"], "t", 10, 2).orderBy("t").collect()] == ["TRIGGERED", "TRIGGERED", "RATE_LIMITED_HOURLY_CAP"]


def test_refractory_and_escalation(spark):
    scores = [0.5, 0.5, 0.55, 0.8, 0.2, 0.6, 0.6]
    df = spark.createDataFrame([("e", float(i * 60), v) for i, v in enumerate(scores)], "k string, t double, v double")
    assert [r.t for r in folds.refractory_fire(df, ["k"], "t", "v").orderBy("t").collect()] == [60.0, 180.0]


def test_chunks(spark):
    rows = [("h", float(i), i, "INFO", f"line {i}") for i in range(1, 8)]
    df = spark.createDataFrame(rows, "h string, t double, id long, sev string, txt string")
    got = folds.count_chunks(df, ["h"], "t", "id", "sev", "txt").collect()
    assert [r.log_ids for r in got] == [["1", "2", "3", "4", "5"], ["3", "4", "5", "6", "7"], ["5", "6", "7"]]
    assert all(len(r.chunk_id) == 32 for r in got)
    one = folds.count_chunks(df.limit(1).withColumn("sev", F.lit("CRITICAL")), ["h"], "t", "id", "sev", "txt").collect()
    assert [(r.log_ids, r.severity) for r in one] == [(["1"], "CRITICAL")]


def test_coalesce_keeps_the_highest_severity(spark):
    rows = [(0, 1, "h", "INFO", "Request failed"), (0, 2, "h", "CRITICAL", "\tat a.b.C.run(C.java:1)"), (0, 3, "g", "INFO", "\tat other")]
    df = spark.createDataFrame(rows, "f int, n int, host string, sev string, txt string")
    got = sorted(values(logs.coalesce_entries(df, ["f"], ["host"], ["n"], "txt", "sev"), "host", "sev", "n_lines"))
    assert got == [("g", "INFO", 1), ("h", "CRITICAL", 2)]


def test_normalise(spark):
    raw = "2026-01-02T03:04:05Z id 123e4567-e89b-12d3-a456-426614174000 from 10.0.0.1:8080 took 142ms at 0xdeadbeef in /var/log/app.log code 7\n\tat a.B.c(B.java:12)"
    got = spark.createDataFrame([(raw,)], "t string").select(logs.normalize(F.col("t")).alias("n"), logs.has_trace(F.col("t")).alias("h")).first()
    assert got.h and got.n.endswith("(B.java:<LINE>)")
    for p in ("<TIMESTAMP>", "<UUID>", "<IP_PORT>", "<DURATION>", "<HEX_ID>", "<PATH>", "<NUM>"):
        assert p in got.n


def test_long_trace_loses_its_middle(spark):
    raw = "Traceback (most recent call last):\n" + "\n".join(f'  File "/a/b{i}.py", line {i}, in f' for i in range(25)) + "\nValueError: last"
    got = spark.createDataFrame([(raw,)], "t string").select(logs.normalize(F.col("t")).alias("n")).first().n
    assert "[10 middle frames omitted]" in got.replace("<NUM>", "10") and got.endswith("ValueError: last") and got.count("File") == 15


def test_signature(spark):
    got = spark.createDataFrame([("userLogin42 failed from 10.0.0.1 after 3.5s",)], "t string").select(logs.signature(F.col("t")).alias("s")).first().s
    assert got == "user login <num> failed from <ip> after <dur>"


def test_exposition(spark):
    text = '# TYPE a counter\na{x="1\\"2",y="\\\\n"} 3 1700000000000\nb NaN\nc{x="1",x="2"} 1\nd{bad} 1\ne +Inf\n'
    got = {r.name: r for r in logs.parse_exposition(spark.createDataFrame([(1, text)], "i int, t string"), "t", ["i"]).collect()}
    assert got["a"].labels == {"x": '1"2', "y": "\\n"} and got["a"].value == 3 and got["a"].timestamp_ms == 1700000000000 and not got["a"].error
    assert math.isnan(got["b"].value) and got["c"].error and got["d"].error and got["e"].value == float("inf")


def test_anomaly_classes(spark):
    df = spark.createDataFrame([(9.0, 2.0, 8.0), (0.0, 2.0, 8.0), (1.0, 2.0, 8.0), (5.0, 2.0, 8.0)], "v double, lo double, hi double")
    out = (F.col("v") > F.col("hi")) | (F.col("v") < F.col("lo"))
    got = [r[0] for r in df.select(timeseries.anomaly_class(F.col("v"), F.col("lo"), F.col("hi"), out)).collect()]
    assert got == ["SPIKE_ANOMALY", "SILENT_HOST_DROP_TO_ZERO", "DIP_ANOMALY", "NORMAL"]


def test_counter_reset_is_unknown(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 00:00:00', 5.0D), ('a', timestamp_ntz'2024-01-01 00:00:10', 25.0D), ('a', timestamp_ntz'2024-01-01 00:00:20', 3.0D) t(k, ts, v)")
    assert values(timeseries.counter_rate(df, ["k"], "ts", "v").orderBy("ts"), "rate") == [(None,), (2.0,), (None,)]


def test_interval_join_edges(spark):
    a = spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-01 00:10:00' AS ts")
    b = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:05:00', 'in'), (1, timestamp_ntz'2024-01-01 00:04:59.999', 'out'), (1, timestamp_ntz'2024-01-01 00:10:00', 'now'), (2, timestamp_ntz'2024-01-01 00:09:00', 'other') t(k, bt, m)")
    assert {r.m for r in joins.interval_join(a, b, ["k"], "ts", "bt", 300_000).collect()} == {"in", "now"}
    assert values(joins.left_interval_join(a.withColumn("k", F.lit(9)), b, ["k"], "ts", "bt", 300_000), "m") == [(None,)]


def test_suppression(spark):
    got = spark.range(1).select(detect.suppressed(F.lit(0.6), F.lit(0.9), F.lit(False)).alias("a"), detect.suppressed(F.lit(0.99), F.lit(0.95), F.lit(True)).alias("b"), detect.suppressed(F.lit(0.6), F.lit(0.01), F.lit(False)).alias("c")).first()
    assert (got.a, got.b, got.c) == (True, False, False)


def test_zero_vectors(spark):
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(scalar.cosine_distance(z, z).alias("d")).first().d == 1.0
    with pytest.raises(ValueError):
        base = spark.range(5).select("id", F.array(F.lit(1.0)).alias("v"))
        vector_search(base, base, "id", "id", "v", 1, most_queries=2)


def test_features(spark):
    wide = spark.createDataFrame([("e", 1, "node", 2.0, 4.0, 1.0, None)], "entity string, ts int, kind string, r_cpu_idle double, cores double, load1 double, mem_total double")
    got = {r.feature: r.value for r in fc.derive(wide).collect()}
    assert got == {"host.cpu_busy_ratio": 0.5, "host.runq_per_cpu": 0.25}
    assert len(fc.FEATURES) == 47


def test_embedding_is_unit_and_stable(spark):
    df = spark.createDataFrame([(1, "connection <ip> refused after <dur>"), (2, "connection <ip> refused after <dur>"), (3, "connection <ip> reset"), (4, ""), (5, None), (6, "disk full on node")], "id int, signature string")
    got = {r.id: r.vector for r in embed_signatures(df, "signature").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert {len(v) for v in got.values()} == {96} and got[1] == got[2] and got[4] == got[5] == [0.0] * 96
    assert all(abs(dot(got[i], got[i]) - 1) < 1e-9 for i in (1, 3, 6)) and dot(got[1], got[3]) > dot(got[1], got[6])


def test_readers(spark, tmp_path):
    (tmp_path / "job__host%3A9100.jsonl").write_text('{"scrape_time": "2024-01-01T00:00:00Z", "phase": "history", "exposition": "up 1"}\n')
    (tmp_path / "logs.jsonl").write_text('{"insertId": "a", "timestamp": "2024-01-01T00:00:00Z", "textPayload": "hi"}\nnot json\n{"insertId": "b", "jsonPayload": {"msg": "yo"}}\n')
    (tmp_path / "cal.json").write_text('{"changes": [{"change_id": "c", "kind": "maintenance", "entities": [], "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T01:00:00Z"}]}')
    (tmp_path / "topo.json").write_text('{"entities": [{"entity_id": "n1", "kind": "node"}], "edges": [["contains", "n1", "n2"]]}')
    assert values(readers.read_scrapes(spark, str(tmp_path / "job__*.jsonl")), "job", "instance", "exposition") == [("job", "host:9100", "up 1")]
    assert sorted(values(readers.read_logs(spark, str(tmp_path / "logs.jsonl")), "message", "is_corrupt"), key=repr) == sorted([("hi", False), (None, True), ("yo", False)], key=repr)
    assert values(readers.read_calendar(spark, str(tmp_path / "cal.json")), "change_id", "entity") == [("c", None)]
    assert values(readers.read_topology(spark, str(tmp_path / "topo.json"))[1], "relation", "src", "dst") == [("contains", "n1", "n2")]
    with pytest.raises(PermissionError):
        readers.read_logs(spark, str(tmp_path / "labels.json"))


def test_append_is_idempotent(spark, tmp_path):
    """A batch that is tried again is stored once, and so is a key that two batches hold."""
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    store = f"{tmp_path}/store"
    for _ in range(2):
        readers.append_new(df, store, ["id"], ["id", "v"])
    readers.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), store, ["id"], ["id", "v"], "1")
    assert sorted(r.id for r in readers.read_once(spark, store, ["id"]).collect()) == [1, 2, 3] and spark.read.parquet(store).count() == 3
    with pytest.raises(ValueError):
        readers.append_new(df.withColumn("x", F.lit(1)), store, ["id"], ["id", "v"])


def test_number_text(spark):
    cases = {0.0: "0", -0.0: "0", 1.0: "1", 12.5: "12.5", -3.25: "-3.25", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e300: "1.5e+300", 0.0001: "0.0001", 0.00001: "1e-05", 123456789.125: "123456789.125", float("inf"): "+Inf", float("-inf"): "-Inf"}
    got = spark.createDataFrame([(float(k),) for k in cases], "v double").select("v", short_number(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == list(cases.values())


def test_exact_quantiles_of_a_busy_key(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = [*rng.normal(0, 5, 500).tolist(), *[7.0] * 300, 0.0, -0.0, 1e-300, -1e300]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("c", None)], "k string, v double")
    q = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q995": 0.995, "q1": 1.0}
    got = {r.k: r for r in ag.exact_quantiles(df, ["k"], "v", q).collect()}
    assert set(got) == {"a", "b"} and {got["b"][n] for n in q} == {1.0}
    assert [got["a"][n] for n in q] == pytest.approx([np.quantile(values, x) for x in q.values()])


def test_vector_index_recall(spark, sf):
    rows, centers = v.cell_index(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding")
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = base.filter("vec_id % 50 = 0")
    exact = {(r.query_id, r.base_id) for r in v.vector_search(base, queries, "vec_id", "vec_id", "embedding", 5).collect()}
    found = {(r.query_id, r.base_id) for r in v.cell_search(rows, centers, queries, "vec_id", "vec_id", "embedding", 5).collect()}
    assert rows.count() == base.count() and len(exact & found) >= 0.9 * len(exact)


def test_overlap_join_counts_each_pair_once(spark):
    a = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-04 00:00:00'), (2, timestamp_ntz'2024-01-02 10:00:00', timestamp_ntz'2024-01-02 11:00:00') t(k, s, e)")
    b = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2023-12-31 00:00:00', timestamp_ntz'2024-01-03 00:00:00', 'a'), (NULL, timestamp_ntz'2024-01-02 00:00:00', timestamp_ntz'2024-01-03 12:00:00', 'b'), (2, timestamp_ntz'2024-01-02 11:00:00', timestamp_ntz'2024-01-03 00:00:00', 'c') t(rk, rs, re, m)")
    got = sorted((r.k, r.m) for r in joins.overlap_join(a, b, "k", "rk", "s", "e", "rs", "re").collect())
    assert got == [(1, "a"), (1, "b"), (2, "b")]
