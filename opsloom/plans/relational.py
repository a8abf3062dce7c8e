"""Filters, joins, aggregates, sorts and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import epoch_ms, trunc
from opsloom.operators import aggregates as ag
from opsloom.operators import joins, rules
from opsloom.operators.spans import overlap_totals
from opsloom.shared import rounds
from opsloom.tables import table

HOUR, DAY = 3_600_000, 86_400_000
T = "(epoch_us(ts) // 1000)"
CHANGES_SQL = "changes AS (SELECT event_id AS change_id, user_id AS entity, user_id % 3 AS kind, ts AS start_ts, ts + INTERVAL 12 HOUR AS end_ts, value AS risk FROM events WHERE event_type = 'signup')"


def theil_sen_sql(source, key, window):
    """Common table expressions that end in slopes (key, slope, n_points), from (key, t, value)."""
    step = "((n - 1) / 89.0::DOUBLE)"
    near = lambda k: f"round_even((floor(r / {step}) + {k}) * {step}, 0) = r"
    return f"""last AS (SELECT {key}, max(t) AS z FROM {source} GROUP BY ALL),
pts AS (SELECT {key}, t, value, row_number() OVER (PARTITION BY {key} ORDER BY t, value) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {source} JOIN last USING ({key}) WHERE t >= z - {window}),
thin AS (SELECT * FROM pts WHERE n >= 2 AND (n * (n - 1) / 2 <= 4096 OR r = 0 OR r = n - 1 OR {near(0)} OR {near(1)})),
med AS (SELECT a.{key}, median((b.value - a.value) / (b.t - a.t)) AS slope FROM thin a JOIN thin b ON a.{key} = b.{key} AND b.t > a.t GROUP BY ALL),
slopes AS (SELECT c.{key}, coalesce(med.slope, 0.0) AS slope, c.n_points FROM (SELECT {key}, count(*) AS n_points FROM thin GROUP BY ALL) c LEFT JOIN med USING ({key}))"""


def ev(s, d):
    return table(s, d, "events")


def changes(s, d):
    """A change window of twelve hours for each signup."""
    e = ev(s, d).filter("event_type = 'signup'")
    return e.select(F.col("event_id").alias("change_id"), F.col("user_id").alias("entity"), (F.col("user_id") % 3).alias("kind"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 12 HOUR")).alias("end_ts"), F.col("value").alias("risk"))


def scan_filter_project(s, d):
    o = table(s, d, "orders")
    return o.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderpriority").isNotNull()).select("o_orderkey", "o_custkey", "o_totalprice")


def log_sink_filter(s, d):
    e = ev(s, d).filter(F.col("event_type").isin("error", "signup") & ~F.col("props").rlike('"k": (1|2)[0-9]?\\}'))
    return e.select("event_id", "event_type", "props")


def edge_materialize(s, d):
    pair = table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return pair.select(F.sha2(F.concat_ws("|", F.lit("supplies"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")), 256).alias("edge_id"), "l_suppkey", "l_partkey")


METRICS = ("node_load1", "node_cpu_seconds_total", "ifInErrors", "ospfNbrEvents", "apache_duration_ms_total", "jvm_gc_collection_seconds_count", "jvm_gc_collection_seconds_bucket", "jvm_gc_collection_seconds", "own_sum", "own_bucket", "node_vmstat_pgpgin", "up")


def metric_type_lookup(s, d):
    """Known families by name, others by suffix: is the metric a counter or a level?"""
    name = F.get(F.array(*map(F.lit, METRICS)), (F.col("event_id") % len(METRICS)).cast("int"))
    kind = F.when(rules.is_counter(name), F.lit("counter")).otherwise(F.lit("level"))
    return ev(s, d).groupBy(name.alias("metric"), kind.alias("kind")).agg(F.count("*").alias("n"))


def status_rule(s, d):
    li = table(s, d, "lineitem")
    bad = (F.col("l_quantity") >= 48) | (F.col("l_discount") >= 0.095) | (F.col("l_extendedprice") >= 95000)
    return li.groupBy(F.when(bad, F.lit("ANOMALY")).otherwise(F.lit("HEALTHY")).alias("status"), "l_returnflag").agg(F.count("*").alias("n"))


def suppress_left_join(s, d):
    """Errors with the greatest risk among covering changes, and the action that follows."""
    e = ev(s, d).filter("event_type = 'error'").select("event_id", "user_id", "ts", "value")
    c = changes(s, d)
    met = joins.covered_join(e, c, ["user_id"], "ts", "start_ts", "end_ts", "left", ["entity"]).groupBy("event_id", "value").agg(F.count("change_id").alias("n_changes"), F.max("risk").alias("risk"))
    action = F.when(F.col("n_changes") > 0, F.lit("NO_ACTION_SUPPRESSED")).when(F.col("value") >= 60, F.lit("AUTO_REMEDIATE")).otherwise(F.lit("MANUAL_REVIEW"))
    return met.select("event_id", "n_changes", "risk", action.alias("action"))


def entity_resolve(s, d):
    """The first of fifteen labels that is not blank, else the alias of the customer's nation."""
    keys, k = F.array(*map(F.lit, rules.ENTITY_LABELS)), (F.col("c_custkey") % 16).cast("int")
    named = F.map_from_arrays(F.slice(keys, F.least(k, F.lit(14)) + 1, F.lit(15)), F.transform(F.slice(keys, F.least(k, F.lit(14)) + 1, F.lit(15)), lambda x: F.concat(F.lit(" "), x, F.lit("-"), F.col("c_custkey").cast("string"))))
    blank = F.map_from_arrays(F.slice(keys, F.lit(1), F.least(k, F.lit(14))), F.transform(F.slice(keys, F.lit(1), F.least(k, F.lit(14))), lambda x: F.lit("  ")))
    labels = F.when(k == 15, blank).otherwise(F.map_concat(blank, named))
    alias = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("alias"))
    return table(s, d, "customer").join(alias, "c_nationkey", "left").select("c_custkey", F.coalesce(rules.first_label(labels), "alias").alias("entity"))


def message_extract(s, d):
    """The text, else a JSON field, else sorted k=v pairs."""
    k = F.get_json_object("props", "$.k")
    pairs = F.from_json("props", "map<string,string>")
    kv = F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return ev(s, d).select("event_id", F.coalesce(F.when(F.col("event_type") == "view", F.col("event_type")), F.when(k.cast("int") % 2 == 0, k), kv).alias("message"))


def phase_classify(s, d):
    e = ev(s, d)
    cut = e.agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("a"), (F.min("ts") + F.expr("INTERVAL 20 DAY")).alias("b"))
    phase = F.when(F.col("ts") < F.col("a"), F.lit("history")).when(F.col("ts") < F.col("b"), F.lit("window")).otherwise(F.lit("unknown"))
    return e.crossJoin(F.broadcast(cut)).groupBy(phase.alias("phase"), "event_type").agg(F.count("*").alias("n"))


def join_inner_equi(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def interval_join_5m(s, d):
    """Purchases with the three latest errors of the same user in the six hours before."""
    a = ev(s, d).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = ev(s, d).filter("event_type = 'error'").select("user_id", F.col("ts").alias("log_ts"), "props")
    met = joins.left_interval_join(a, b, ["user_id"], "ts", "log_ts", 6 * HOUR)
    top = ag.string_agg_topn(met, ["event_id"], F.col("log_ts"), F.col("props"), 3, "messages")
    return met.groupBy("event_id").agg(F.count("log_ts").alias("n")).join(top, "event_id", "left")


def correlated_distinct(s, d):
    """The same correlation with distinct messages in their own order."""
    a = ev(s, d).filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    b = ev(s, d).filter("event_type = 'error'").select("user_id", F.col("ts").alias("log_ts"), "props")
    met = joins.left_interval_join(a, b, ["user_id"], "ts", "log_ts", 6 * HOUR)
    texts = ag.string_agg_distinct(met, ["user_id"], F.col("props"), 3, "messages").withColumnRenamed("user_id", "_u")
    per = met.groupBy("user_id").agg(F.max("value").alias("max_value"), F.count("log_ts").alias("n"))
    return per.join(texts, F.col("user_id").eqNullSafe(F.col("_u"))).drop("_u")


def maintenance_regressor(s, d):
    e = ev(s, d).groupBy(trunc("hour", "ts").alias("hour"), "user_id").agg(F.round(F.avg("value"), 6).alias("avg_value"))
    c = changes(s, d)
    return joins.covered_join(e, c, ["user_id"], "hour", "start_ts", "end_ts", "left", ["entity"]).groupBy("hour", "user_id", "avg_value").agg(F.max(F.when(F.col("change_id").isNotNull(), 1).otherwise(0)).alias("is_maintenance"))


def or_key_interval_join(s, d):
    """A change counts if its entity is the user or the user's successor."""
    e = ev(s, d).filter("event_type = 'error'").select("event_id", "ts", "user_id", (F.col("user_id") + 1).alias("service"))
    return joins.or_key_max(e, "event_id", ["user_id", "service"], changes(s, d), "entity", "ts", "start_ts", "end_ts", F.lit(1), "in_change").select("event_id", "in_change")


def rca_feature_join(s, d):
    """Hourly metrics joined along the edges order -> line -> part with equal time."""
    o, li, p = table(s, d, "orders"), table(s, d, "lineitem"), table(s, d, "part")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey).filter(F.date_trunc("month", "o_orderdate") == F.date_trunc("month", "l_shipdate"))
    return j.groupBy("p_brand", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.max("o_totalprice").alias("max_price"))


def attach_target_labels(s, d):
    t = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("target"))
    labels = F.map_concat(F.create_map(F.lit("type"), F.col("event_type")), F.create_map(F.lit("target"), F.col("target")))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return ev(s, d).withColumn("k", F.col("user_id") % 25).join(F.broadcast(t), "k").select("event_id", pairs.alias("labels"))


def change_window_overlap(s, d):
    """A user's days with the changes that overlap them: their own by a join, those of the whole estate as totals."""
    e = ev(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.count("*").alias("n")).filter("n > 1")
    e = rounds(s, "days")(e.drop("n"), "days")
    c = changes(s, d).withColumn("entity", F.when(F.col("change_id") % 97 != 0, F.col("entity")))
    c = c.groupBy("entity", "start_ts", "end_ts").agg(F.count("*").alias("_c"), F.max("risk").alias("risk"))  # equal spans meet a row once
    own = joins.overlap_join(e, c.filter("entity is not null"), "user_id", "entity", "s", "e", "start_ts", "end_ts")
    wide = overlap_totals(e, c.filter("entity is null"), "s", "e", "start_ts", "end_ts", "_c", "risk")
    out = own.select("user_id", "day", "_c", "risk").unionByName(wide.select("user_id", "day", "_c", "risk"))
    return out.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.sum("_c").alias("n_changes"), F.max("risk").alias("max_risk"))


def asof_backward(s, d):
    a = ev(s, d).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = ev(s, d).filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_backward(a, b, ["user_id"], "ts", "value", "last_view").select("event_id", "last_view")


def first_crossing_lookback(s, d):
    """Strongest, first value over 20 and latest value of the user's views in the day before a purchase."""
    a = ev(s, d).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = ev(s, d).filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("v"))
    met = joins.interval_join(a, b, ["user_id"], "ts", "at", DAY)
    return met.groupBy("event_id").agg(F.max("v").alias("strongest"), F.min(F.when(F.col("v") > 20, F.col("at"))).alias("first_crossing"), F.max_by("v", F.struct("at", "v")).alias("latest"))


def _daily_pair(s, d):
    e = ev(s, d).groupBy("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    return e.agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("m"))


def spearman_corr(s, d):
    out = ag.spearman(_daily_pair(s, d), ["event_type"], "n", "m")
    return out.select("event_type", F.round("spearman", 6).alias("spearman"))


def spearman_align(s, d):
    """Two traces aligned on equal hours, and how their ranks agree."""
    h = ev(s, d).groupBy(trunc("hour", "ts").alias("ts"), "event_type").agg(F.avg("value").alias("v"))
    a = h.filter("event_type = 'view'").select("ts", F.col("v").alias("x"))
    b = h.filter("event_type = 'click'").select("ts", F.col("v").alias("y"))
    return ag.spearman(a.join(b, "ts").withColumn("pair", F.lit("view-click")), ["pair"], "x", "y").select("pair", F.round("spearman", 6).alias("spearman"))


def idempotent_ingest_anti(s, d):
    """A batch with repeats and rows that are in the store already."""
    e = ev(s, d)
    store = e.filter("event_id % 3 = 0").select("event_id")
    batch = e.unionByName(e.filter("event_id % 5 = 0"))
    return batch.join(store, "event_id", "left_anti").dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def stddev_family(s, d):
    return ev(s, d).groupBy("user_id").agg(*[F.round(f("value"), 6).alias(n) for f, n in ((F.stddev_samp, "stddev_samp"), (F.stddev_pop, "stddev_pop"), (F.var_samp, "var_samp"))])


def group_by_json_label(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    key = F.concat(F.lit("k="), F.coalesce((k % 10).cast("string"), F.lit("")))
    return ev(s, d).groupBy(key.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def string_agg_topn(s, d):
    return ag.string_agg_topn(ev(s, d), ["user_id"], F.struct("ts", "event_id"), F.col("event_type"), 3, "latest")


def string_agg_distinct(s, d):
    return ag.string_agg_distinct(ev(s, d), ["user_id"], F.col("event_type"), 3, "types")


def hourly_xreg_features(s, d):
    return ev(s, d).groupBy(trunc("hour", "ts").alias("hour")).agg(F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("has_error"), F.max(F.coalesce(F.when(F.col("event_type") == "signup", F.col("value")), F.lit(0.0))).alias("max_signup"))


def distinct_hosts(s, d):
    return ev(s, d).select("user_id", "event_type").distinct()


def log_count_windows(s, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    p = ev(s, d).groupBy(trunc("day", "ts").alias("day")).pivot("event_type", kinds).count()
    return p.select("day", *[F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in kinds])


def class_counts(s, d):
    return ev(s, d).filter(F.col("value") > 20).groupBy("event_type").agg(F.count("*").alias("n"))


def combine_per_key(s, d):
    """The ids of a key in rows of a thousand, each with the key's maximum."""
    e = ev(s, d).filter("event_type = 'purchase'")
    ids = ag.id_chunks(e, ["user_id"], "event_id").join(e.groupBy("user_id").agg(F.max("value").alias("max_value")), "user_id")
    return ids.select("user_id", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "max_value")


def weighted_quantile(s, d):
    return ag.weighted_quantile(table(s, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", 0.9, "q90")


def percentile_exact(s, d):
    q = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p995": 0.995}
    return ag.exact_quantiles(ev(s, d), ["event_type"], "value", q).select("event_type", *[F.round(c, 6).alias(c) for c in q])


def median_mad(s, d):
    return ag.median_mad(ev(s, d), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "mad", "robust_sigma")])


def theil_sen_slope(s, d):
    e = ev(s, d).select("user_id", (epoch_ms("ts") / 60000.0).alias("t"), "value")
    return ag.theil_sen(e, ["user_id"], "t", "value", 20 * 1440).select("user_id", F.round("slope", 8).alias("slope"), "n_points")


def ewma(s, d):
    return ag.ewma(ev(s, d), ["user_id"], ["ts", "event_id"], "value", 0.3).select("user_id", F.round("ewma", 6).alias("ewma"))


def pooled_ratios(s, d):
    e = ev(s, d).withColumn("seed", F.col("user_id") % 10)
    per = e.groupBy("seed").agg(F.count_if(F.col("event_type") == "error").alias("num"), F.count_if(F.col("event_type") == "view").alias("den"))
    pooled = per.agg(F.lit(-1).cast("long").alias("seed"), F.sum("num").alias("num"), F.sum("den").alias("den"))
    return per.unionByName(pooled).select("seed", F.round(F.col("num") / F.nullif(F.col("den"), F.lit(0)), 6).alias("ratio"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def confusion_matrix(s, d):
    o = table(s, d, "orders")
    return o.groupBy("o_orderstatus").pivot("o_orderpriority", PRIORITIES).count().select("o_orderstatus", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias("p" + p[0]) for p in PRIORITIES])


COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def table_row_counts(s, d):
    out = None
    for t in COUNTED:
        c = table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def time_bounds(s, d):
    e, o = ev(s, d).agg(F.min("ts").alias("a"), F.max("ts").alias("z")), table(s, d, "orders").agg(F.min("o_orderdate").alias("oa"), F.max("o_orderdate").alias("oz"))
    return e.crossJoin(F.broadcast(o)).select(F.least("a", "oa").alias("first"), F.greatest("z", "oz").alias("last"))


def sort_multi_key(s, d):
    return ev(s, d).select("event_type", "user_id", "event_id", "value").orderBy(F.asc("event_type"), F.desc("user_id"), F.asc("event_id"))


def topk_flows(s, d):
    """The 20 heaviest supplier-to-part flows."""
    f = table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("traffic"))
    return f.orderBy(F.desc("traffic"), "l_suppkey", "l_partkey").limit(20)


def active_change_top1(s, d):
    """The riskiest change that covers an error, ends included; ties by smallest id."""
    e = ev(s, d).filter("event_type = 'error'").select("event_id", "user_id", "ts")
    c = changes(s, d)
    met = joins.covered_join(e, c, ["user_id"], "ts", "start_ts", "end_ts", "inner", ["entity"])
    return met.groupBy("event_id").agg(F.max_by("change_id", F.struct("risk", -F.col("change_id"))).alias("change_id"), F.max("risk").alias("risk"))


def unified_signals_union_all(s, d):
    a = ev(s, d).select(F.lit("event").alias("signal"), F.col("user_id").alias("entity"), "value")
    b = table(s, d, "orders").select(F.lit("order").alias("signal"), F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("value"))
    return a.unionByName(b).groupBy("signal").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.max("value").alias("max_value"))


def observed_entities_union(s, d):
    return ev(s, d).select(F.col("user_id").alias("entity")).union(table(s, d, "orders").select("o_custkey")).distinct()


def shared_dependency_intersect(s, d):
    li = table(s, d, "lineitem")
    return li.filter("l_suppkey = 1").select("l_partkey").intersect(li.filter("l_suppkey = 2").select("l_partkey"))


def affected_except(s, d):
    return table(s, d, "customer").select("c_custkey").subtract(table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


def epoch_unit_normalize(s, d):
    """Numbers over 1e16 are nanoseconds, over 1e11 milliseconds, else seconds."""
    raw = epoch_ms("ts")
    n = F.when(F.col("event_id") % 3 == 0, raw * 1000000).when(F.col("event_id") % 3 == 1, raw).otherwise(F.floor(raw / 1000))
    ms = F.when(F.col("n") > 10**16, F.expr("n div 1000000")).when(F.col("n") > 10**11, F.col("n")).otherwise(F.col("n") * 1000)
    return ev(s, d).withColumn("n", n).select("event_id", ms.cast("long").alias("ms"))


def bounded_history(s, d):
    """Only a cell's last 12 observations count."""
    w = Window.partitionBy("event_type", F.hour("ts")).orderBy(F.desc("ts"), F.desc("event_id"))
    return ev(s, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 12").groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.median("value").alias("median_value"))


NAMES = [
    scan_filter_project, log_sink_filter, edge_materialize, metric_type_lookup, status_rule, suppress_left_join, entity_resolve, message_extract, phase_classify, join_inner_equi,
    interval_join_5m, correlated_distinct, maintenance_regressor, or_key_interval_join, rca_feature_join, attach_target_labels, change_window_overlap, asof_backward, first_crossing_lookback,
    spearman_corr, spearman_align, idempotent_ingest_anti, stddev_family, group_by_json_label, string_agg_topn, string_agg_distinct, hourly_xreg_features, distinct_hosts, log_count_windows,
    class_counts, combine_per_key, weighted_quantile, percentile_exact, median_mad, theil_sen_slope, ewma, pooled_ratios, confusion_matrix, table_row_counts, time_bounds, sort_multi_key,
    topk_flows, active_change_top1, unified_signals_union_all, observed_entities_union, shared_dependency_intersect, affected_except, epoch_unit_normalize, bounded_history,
]
QUERIES = {f.__name__: f for f in NAMES}

_PAIR = "SELECT a.event_id, a.user_id, a.ts, a.value, b.ts AS log_ts, b.props FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.ts <= a.ts AND epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000 <= 21600000 WHERE a.event_type = 'purchase'"
_KINDS = ["click", "error", "purchase", "signup", "view"]
ORACLE = {
    "scan_filter_project": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IS NOT NULL",
    "log_sink_filter": """SELECT event_id, event_type, props FROM events WHERE event_type IN ('error', 'signup') AND NOT regexp_matches(props, '"k": (1|2)[0-9]?\\}')""",
    "edge_materialize": "SELECT sha256('supplies|' || l_suppkey || '|' || l_partkey) AS edge_id, l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)",
    "metric_type_lookup": f"""WITH v(k, metric) AS (VALUES {", ".join(f"({i}, '{m}')" for i, m in enumerate(METRICS))})
SELECT metric, CASE WHEN metric IN ('node_cpu_seconds_total', 'ifInErrors', 'ospfNbrEvents', 'jvm_gc_collection_seconds_count', 'jvm_gc_collection_seconds_bucket', 'own_sum', 'node_vmstat_pgpgin') THEN 'counter' ELSE 'level' END AS kind, count(*) AS n FROM events JOIN v ON v.k = event_id % {len(METRICS)} GROUP BY ALL""",
    "status_rule": "SELECT CASE WHEN l_quantity >= 48 OR l_discount >= 0.095 OR l_extendedprice >= 95000 THEN 'ANOMALY' ELSE 'HEALTHY' END AS status, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL",
    "suppress_left_join": f"""WITH {CHANGES_SQL}, x AS (SELECT e.event_id, e.value, count(change_id) AS n_changes, max(risk) AS risk FROM events e LEFT JOIN changes c ON e.user_id = c.entity AND e.ts BETWEEN start_ts AND end_ts WHERE event_type = 'error' GROUP BY ALL)
SELECT event_id, n_changes, risk, CASE WHEN n_changes > 0 THEN 'NO_ACTION_SUPPRESSED' WHEN value >= 60 THEN 'AUTO_REMEDIATE' ELSE 'MANUAL_REVIEW' END AS action FROM x""",
    "entity_resolve": f"""SELECT c_custkey, CASE WHEN c_custkey % 16 = 15 THEN n_name ELSE {list(rules.ENTITY_LABELS)}[c_custkey % 16 + 1] || '-' || c_custkey END AS entity FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "message_extract": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' WHEN CAST(props->>'$.k' AS INT) % 2 = 0 THEN props->>'$.k' ELSE 'k=' || (props->>'$.k') END AS message FROM events""",
    "phase_classify": "WITH b AS (SELECT min(ts) AS m FROM events) SELECT CASE WHEN ts < m + INTERVAL 10 DAY THEN 'history' WHEN ts < m + INTERVAL 20 DAY THEN 'window' ELSE 'unknown' END AS phase, event_type, count(*) AS n FROM events, b GROUP BY ALL",
    "join_inner_equi": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "interval_join_5m": f"WITH m AS ({_PAIR}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY log_ts DESC, props DESC) AS rn FROM m) SELECT event_id, count(log_ts) AS n, string_agg(props, ' | ' ORDER BY log_ts DESC, props DESC) FILTER (WHERE rn <= 3 AND log_ts IS NOT NULL) AS messages FROM r GROUP BY event_id",
    "correlated_distinct": f"WITH m AS ({_PAIR}) SELECT user_id, max(value) AS max_value, count(log_ts) AS n, coalesce(array_to_string(list_sort(list_distinct(list(props) FILTER (WHERE props IS NOT NULL)))[1:3], ' | '), '') AS messages FROM m GROUP BY user_id",
    "maintenance_regressor": f"""WITH {CHANGES_SQL}, e AS (SELECT date_trunc('hour', ts) AS hour, user_id, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL)
SELECT hour, user_id, avg_value, max(CASE WHEN change_id IS NOT NULL THEN 1 ELSE 0 END) AS is_maintenance FROM e LEFT JOIN changes ON user_id = entity AND hour BETWEEN start_ts AND end_ts GROUP BY ALL""",
    "or_key_interval_join": f"WITH {CHANGES_SQL} SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM changes c WHERE (c.entity = e.user_id OR c.entity = e.user_id + 1) AND e.ts BETWEEN start_ts AND end_ts) THEN 1 ELSE 0 END AS in_change FROM events e WHERE event_type = 'error'",
    "rca_feature_join": "SELECT p_brand, o_orderstatus, count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity, max(o_totalprice) AS max_price FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE date_trunc('month', o_orderdate) = date_trunc('month', l_shipdate) GROUP BY ALL",
    "attach_target_labels": "SELECT event_id, 'target=' || n_name || ',type=' || event_type AS labels FROM events JOIN nation ON n_nationkey = user_id % 25",
    "change_window_overlap": f"""WITH {CHANGES_SQL}, c2 AS (SELECT * REPLACE (CASE WHEN change_id % 97 <> 0 THEN entity END AS entity) FROM changes), e AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS s, max(ts) AS e, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1)
SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS n_changes, max(risk) AS max_risk FROM e JOIN c2 ON (c2.entity = user_id OR c2.entity IS NULL) AND start_ts < e.e AND end_ts > e.s GROUP BY ALL""",
    "asof_backward": "WITH b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT a.event_id, b.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts",
    "first_crossing_lookback": f"""SELECT a.event_id, max(b.value) AS strongest, min(b.ts) FILTER (WHERE b.value > 20) AS first_crossing, arg_max(b.value, (b.ts, b.value)) AS latest FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts <= a.ts AND epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000 <= {DAY} WHERE a.event_type = 'purchase' GROUP BY ALL""",
    "spearman_corr": """WITH p AS (SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS n, round(max(value), 2) AS m FROM events GROUP BY ALL),
r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY n) + (count(*) OVER (PARTITION BY event_type, n) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY event_type ORDER BY m) + (count(*) OVER (PARTITION BY event_type, m) - 1) / 2.0::DOUBLE AS y FROM p)
SELECT event_type, round(CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) ELSE 0 END, 6) AS spearman FROM r GROUP BY ALL""",
    "spearman_align": """WITH h AS (SELECT date_trunc('hour', ts) AS ts, event_type, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT a.v AS x, b.v AS y FROM h a JOIN h b ON a.ts = b.ts AND a.event_type = 'view' AND b.event_type = 'click'),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS y FROM p) SELECT 'view-click' AS pair, round(corr(x, y), 6) AS spearman FROM r""",
    "idempotent_ingest_anti": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 3 <> 0 GROUP BY ALL",
    "stddev_family": "SELECT user_id, round(stddev_samp(value), 6) AS stddev_samp, round(stddev_pop(value), 6) AS stddev_pop, round(var_samp(value), 6) AS var_samp FROM events GROUP BY ALL",
    "group_by_json_label": "SELECT 'k=' || coalesce(CAST(CAST(props->>'$.k' AS INT) % 10 AS VARCHAR), '') AS label, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL",
    "string_agg_topn": "SELECT user_id, string_agg(event_type, ' | ' ORDER BY ts DESC, event_id DESC) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY user_id",
    "string_agg_distinct": "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type)))[1:3], ' | ') AS types FROM events GROUP BY user_id",
    "hourly_xreg_features": "SELECT date_trunc('hour', ts) AS hour, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS has_error, max(CASE WHEN event_type = 'signup' THEN value ELSE 0.0 END) AS max_signup FROM events GROUP BY ALL",
    "distinct_hosts": "SELECT DISTINCT user_id, event_type FROM events",
    "log_count_windows": f"SELECT date_trunc('day', ts) AS day, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in _KINDS)} FROM events GROUP BY ALL",
    "class_counts": "SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL",
    "combine_per_key": "WITH p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 1000 AS chunk, max(value) OVER (PARTITION BY user_id) AS top FROM events WHERE event_type = 'purchase') SELECT user_id, chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids, any_value(top) AS max_value FROM p GROUP BY user_id, chunk",
    "weighted_quantile": "WITH p AS (SELECT l_returnflag, l_discount, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_discount) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM p) SELECT l_returnflag, min(l_discount) AS q90 FROM r WHERE c >= t * 0.9::DOUBLE GROUP BY ALL",
    "percentile_exact": "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.995, "p995"))) + " FROM events GROUP BY ALL",
    "median_mad": f"SELECT event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad, round(mad(value) * {ag.SIGMA_OF_MAD}::DOUBLE, 6) AS robust_sigma FROM events GROUP BY ALL",
    "theil_sen_slope": f"WITH e AS (SELECT user_id, {T} / 60000.0::DOUBLE AS t, value FROM events), {theil_sen_sql('e', 'user_id', 28800)} SELECT user_id, round(slope, 8) AS slope, n_points FROM slopes",
    "ewma": """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, rn, value AS e FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, r.e + (o.value - r.e) * 0.3::DOUBLE FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT user_id, round(arg_max(e, rn), 6) AS ewma FROM r GROUP BY user_id""",
    "pooled_ratios": """WITH p AS (SELECT user_id % 10 AS seed, count(*) FILTER (WHERE event_type = 'error') AS num, count(*) FILTER (WHERE event_type = 'view') AS den FROM events GROUP BY ALL)
SELECT seed, round(num / nullif(den, 0)::DOUBLE, 6) AS ratio FROM (SELECT * FROM p UNION ALL SELECT -1, sum(num), sum(den) FROM p)""",
    "confusion_matrix": "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS p{p[0]}" for p in PRIORITIES) + " FROM orders GROUP BY ALL",
    "table_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in COUNTED),
    "time_bounds": "SELECT least(min(ts), (SELECT min(o_orderdate) FROM orders)) AS first, greatest(max(ts), (SELECT max(o_orderdate) FROM orders)) AS last FROM events",
    "sort_multi_key": "SELECT event_type, user_id, event_id, value FROM events ORDER BY event_type, user_id DESC, event_id",
    "topk_flows": "SELECT l_suppkey, l_partkey, round(sum(l_quantity), 2) AS traffic FROM lineitem GROUP BY ALL ORDER BY traffic DESC, l_suppkey, l_partkey LIMIT 20",
    "active_change_top1": f"WITH {CHANGES_SQL} SELECT event_id, arg_max(change_id, (risk, -change_id)) AS change_id, max(risk) AS risk FROM events e JOIN changes c ON e.user_id = c.entity AND e.ts BETWEEN start_ts AND end_ts WHERE event_type = 'error' GROUP BY ALL",
    "unified_signals_union_all": "SELECT 'event' AS signal, count(*) AS n, count(DISTINCT user_id) AS entities, max(value) AS max_value FROM events UNION ALL SELECT 'order', count(*), count(DISTINCT o_custkey), max(o_totalprice) FROM orders",
    "observed_entities_union": "SELECT user_id AS entity FROM events UNION SELECT o_custkey FROM orders",
    "shared_dependency_intersect": "SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2",
    "affected_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "epoch_unit_normalize": f"SELECT event_id, CASE WHEN event_id % 3 = 2 THEN {T} // 1000 * 1000 ELSE {T} END AS ms FROM events",
    "bounded_history": "SELECT event_type, hour(ts) AS hour, count(*) AS n, median(value) AS median_value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, hour(ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 12 GROUP BY event_type, hour(ts)",
}
