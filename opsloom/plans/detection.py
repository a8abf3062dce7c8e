"""Detection, attribution, suppression and evaluation over events bound to roles.

Readings: daily means of each (user, event type); family and direction follow
from the event type. Changes: twelve hours from each signup. Predictions are
purchases, onsets are errors.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import clamp, logistic, robust_z
from opsloom.operators import aggregates as ag
from opsloom.operators import attribution as at
from opsloom.operators import detect as dt
from opsloom.operators import folds, rules
from opsloom.operators import graph as g
from opsloom.operators.joins import covered_join, interval_join
from opsloom.operators.timeseries import streaks
from opsloom.plans.relational import CHANGES_SQL, changes, ev
from opsloom.shared import rounds
from opsloom.tables import table

SIG = ag.SIGMA_OF_MAD
WEIGHTS = {"saturation": 2.2, "errors": 1.8, "latency": 1.2}
FAMILY = {"click": "saturation", "view": "saturation", "error": "errors", "purchase": "latency", "signup": "latency"}
EXPLAINS = [(0, "saturation"), (0, "latency"), (1, "errors"), (2, "saturation")]


def _readings(s, d):
    """user, day, feature, family, direction, value, z, severity; the daily means and the result are written, since most queries read them more than once."""
    written = rounds(s, "readings")
    e = written(ev(s, d).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value")), "means")
    base = ag.median_mad(e, ["feature"], "value")
    fam = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    r = e.join(F.broadcast(base), "feature")  # a row a feature
    r = r.withColumns({"family": F.element_at(fam, F.col("feature")), "direction": F.when(F.col("feature") == "purchase", -1).otherwise(1)})
    r = r.withColumn("z", robust_z(F.col("value"), F.col("median"), F.col("robust_sigma"), 0.01))
    return written(r.withColumn("severity", dt.severity(F.col("z"), F.col("direction"))), "readings")


def _evidence(s, d):
    """entity, moment, causal, confidence of each day: purchases are symptoms and speak for no cause."""
    r = _readings(s, d)
    causal = r.groupBy("user_id", "day").agg(F.coalesce(F.max(F.when(F.col("feature") != "purchase", F.col("severity"))), F.lit(0.0)).alias("causal"))
    hot = dt.hazard(dt.family_severity(r, ["user_id", "day"]), _weights(s), ["user_id", "day"])
    both = causal.join(hot, ["user_id", "day"])
    return r, both.select(F.col("user_id").alias("entity"), F.unix_seconds(F.col("day").cast("timestamp")).alias("moment"), "causal", F.round("confidence", 12).alias("confidence"))


def _dependents(s, d):
    """entity, cause: each user rests on the user of a third of its number, and so on up to 0."""
    users = ev(s, d).select(F.col("user_id").alias("a")).distinct()
    steps = users.select("a", F.floor(F.col("a") / 3).alias("b")).filter("a <> b")
    return g.closure(s, steps, users, None).select(F.col("origin").alias("entity"), F.col("node").alias("cause"))


def robust_z_score(s, d):
    return _readings(s, d).select("user_id", "day", "feature", F.round("z", 6).alias("z"))


def severity_from_z(s, d):
    return _readings(s, d).select("user_id", "day", "feature", F.round("severity", 6).alias("severity"))


def family_severity_max(s, d):
    return dt.family_severity(_readings(s, d), ["user_id", "day"]).select("user_id", "day", "family", F.round("severity", 6).alias("severity"))


def _weights(s):
    return s.createDataFrame(list(WEIGHTS.items()), "family string, weight double")


def hazard_confidence(s, d):
    f = dt.family_severity(_readings(s, d), ["user_id", "day"])
    return dt.hazard(f, _weights(s), ["user_id", "day"]).select("user_id", "day", F.round("confidence", 6).alias("confidence"))


def hazard_all_families(s, d):
    """The hazard of every family's weight, families dealt to events by id."""
    names = F.array(*[F.lit(n) for n in dt.FAMILY_WEIGHTS])
    r = ev(s, d).select("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), F.get(names, (F.col("event_id") % len(dt.FAMILY_WEIGHTS)).cast("int")).alias("family"), clamp(F.col("value") / 200).alias("severity"))
    weights = s.createDataFrame(list(dt.FAMILY_WEIGHTS.items()), "family string, weight double")
    return dt.hazard(dt.family_severity(r, ["user_id", "week"]), weights, ["user_id", "week"]).select("user_id", "week", F.round("confidence", 6).alias("confidence"))


def contribution_share(s, d):
    return dt.contribution_share(_readings(s, d), ["user_id", "day"]).select("user_id", "day", "family", "feature", F.round("share", 6).alias("share"))


def causal_summary(s, d):
    """The strongest reading that is not a symptom; ties by the greatest name."""
    r = _readings(s, d).filter("feature <> 'purchase'").withColumn("sev", F.round("severity", 9))
    return r.groupBy("user_id", "day").agg(F.max_by("feature", F.struct("sev", "feature")).alias("cause"))


def _levels(s, d):
    """The learned failure level of each user's values."""
    e = ev(s, d)
    q = ag.exact_quantiles(e, ["user_id"], "value", {"center": 0.5, "p995": 0.995})
    stats = q.join(e.groupBy("user_id").agg(F.stddev_pop("value").alias("sigma")), "user_id")
    return stats.select("user_id", dt.failure_level(F.col("center"), F.col("sigma"), F.col("p995"), F.lit(1), F.lit("learned")).alias("level"))


def time_to_limit(s, d):
    """At every event the slope of its user's last five days, six points at least, and the hours until the learned level at that slope."""
    e = ev(s, d).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0).alias("t"), "value")
    steps = folds.sliding_theil_sen(e, ["user_id"], ["t", "event_id"], "value", 5 * 86400.0, least=6)
    ttl = dt.time_to_limit(F.col("value"), F.col("slope"), F.col("level"), F.lit(1))
    return steps.join(_levels(s, d), "user_id").select("event_id", "n_points", F.round(F.col("slope") * 3600, 6).alias("slope_h"), F.round(ttl / 3600, 3).alias("hours"))


def predicted_horizon(s, d):
    """Seconds to failure of each user and day: the soonest of the trajectories of signals that contribute and of the hazard's own, else the time since the onset."""
    r, hot = _evidence(s, d)
    r = r.withColumn("t", F.unix_seconds(F.col("day").cast("timestamp")).cast("double"))
    q = ag.exact_quantiles(r, ["feature"], "value", {"center": 0.5, "p995": 0.995}).join(r.groupBy("feature").agg(F.stddev_pop("value").alias("sigma")), "feature")
    slopes = folds.sliding_theil_sen(r.select("user_id", "feature", "t", "value", "direction", "severity"), ["user_id", "feature"], ["t"], "value", 10 * 86400.0, least=4)
    level = dt.failure_level(F.col("center"), F.col("sigma"), F.col("p995"), F.col("direction"), F.lit("learned"))
    ttl = dt.time_to_limit(F.col("value"), F.col("slope"), level, F.col("direction"))
    signal = slopes.join(F.broadcast(q), "feature").filter("severity > 0").groupBy("user_id", "t").agg(F.min(ttl).alias("signal"))
    h = hot.select(F.col("entity").alias("user_id"), F.col("moment").cast("double").alias("t"), "confidence")
    ramp = folds.sliding_theil_sen(h, ["user_id"], ["t"], "confidence", 10 * 86400.0, least=4)
    runs = streaks(ramp, ["user_id"], ["t"], F.col("confidence") >= 0.05)
    onset = F.when(F.col("streak") > 0, F.min(F.when(F.col("streak") == 1, F.col("t"))).over(Window.partitionBy("user_id", "island")))
    j = runs.withColumn("onset", onset).join(signal, ["user_id", "t"], "left")
    toward = F.when(F.col("slope") > 0, (1 - F.col("confidence")) / F.col("slope"))
    return j.select("user_id", F.col("t").cast("long").alias("moment"), dt.horizon(F.col("signal"), toward, elapsed=F.col("t") - F.col("onset"), lo=3600, hi=20 * 86400).alias("horizon_s"))


def change_explained_fraction(s, d):
    c = dt.contribution_share(_readings(s, d), ["user_id", "day"]).withColumn("hard_fault", F.col("feature") == "signup").filter("share is not null").withColumn("share", F.round("share", 9))
    act = changes(s, d).select(F.col("entity").alias("user_id"), F.date_trunc("day", "start_ts").cast("timestamp_ntz").alias("day"), "change_id", "kind", "start_ts")
    fam = s.createDataFrame([(k, f, True) for k, f in EXPLAINS], "kind long, family string, explains boolean")
    return dt.explained_fraction(c, act, fam, ["user_id", "day"]).select("user_id", "day", "change_id", F.round("fraction", 6).alias("fraction"))


def suppression_judge(s, d):
    f = dt.family_severity(_readings(s, d), ["user_id", "day"])
    conf = dt.hazard(f, _weights(s), ["user_id", "day"])
    ex = change_explained_fraction(s, d)
    j = conf.join(ex, ["user_id", "day"], "left")
    return j.select("user_id", "day", dt.suppressed(F.round("confidence", 9), F.coalesce("fraction", F.lit(0.0)), F.lit(False), 0.1).alias("suppressed"))


def _attributed(s, d):
    up = rounds(s, "dependents")(_dependents(s, d), "pairs")
    _, e = _evidence(s, d)
    return at.attribute(e, up, up, 86400, lookback_s=7 * 86400, scale_s=3 * 86400.0, level=0.05)


def attribution_rank(s, d):
    """The three best causes of each user in distress, of those it rests on and itself, with every term."""
    terms = ["local", "coverage", "precision", "precedence", "correlation", "score"]
    return _attributed(s, d).filter("rank <= 3").select("subject", "moment", "cause", "rank", *[F.round(c, 6).alias(c) for c in terms])


def _alerts(s, d):
    return ev(s, d).filter("event_type = 'error'").select(F.col("event_id").alias("alert_id"), (F.col("user_id") % 10).alias("cause"), "ts", F.col("value").alias("confidence"))


def incident_collapse(s, d):
    c = dt.collapse_incidents(_alerts(s, d), "cause", "ts", "confidence", "alert_id", 3600)
    return c.select("cause", F.col("rep.alert_id").alias("representative"), "start", "end", "n")


def cascade_merge(s, d):
    c = dt.collapse_incidents(_alerts(s, d), "cause", "ts", "confidence", "alert_id", 3600)
    up = s.createDataFrame([(n, a, n - a) for n in range(10) for a in range(n) if n // 3 == a // 3], "node long, ancestor long, hops int")
    return dt.merge_cascades(c, up, "cause").select("cause", "episode", "root_cause", "root_episode", "n")


def semantic_fusion(s, d):
    c = ev(s, d).filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("candidate_id"))
    g = ev(s, d).filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signal_id"))
    return dt.fuse(c, g, "user_id", "ts", 6 * 3600).select("signal_id", "candidate_id", "created")


def remediation_advice(s, d):
    f = dt.family_severity(_readings(s, d), ["user_id", "day"]).withColumn("severity", F.round("severity", 9))
    top = f.groupBy("user_id", "day").agg(F.max_by("family", F.struct("severity", "family")).alias("family"), F.max("severity").alias("sev"))
    text = F.when(F.col("sev") == 0, F.lit("observe")).when(F.col("family") == "errors", F.lit("roll back the last change")).when(F.col("family") == "saturation", F.lit("add capacity")).otherwise(F.lit("inspect dependencies"))
    return top.select("user_id", "day", text.alias("advice"))


def workflow_resolve(s, d):
    names = {"error": "restart", "click": "scale"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return ev(s, d).select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), F.concat(F.lit("runbook-"), (F.col("user_id") % 4).cast("string"))).alias("workflow"))


def prediction_match(s, d):
    """Onsets (errors) with the earliest prediction (purchase) of their user up to two days before."""
    p = ev(s, d).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("prediction_id"), F.col("ts").alias("emitted"))
    o = ev(s, d).filter("event_type = 'error'").select("user_id", F.col("event_id").alias("onset_id"), F.col("ts").alias("onset"))
    met = interval_join(o, p, ["user_id"], "onset", "emitted", 2 * 86_400_000).filter(F.col("emitted") < F.col("onset"))
    lead = F.timestamp_diff("SECOND", F.min("emitted"), F.max("onset"))
    return met.groupBy("onset_id").agg(F.count("*").alias("n"), F.min_by("prediction_id", F.struct("emitted", "prediction_id")).alias("first_prediction"), lead.alias("lead_s"))


def score_recall_leadtime(s, d):
    o = ev(s, d).filter("event_type = 'error'").select(F.col("event_id").alias("onset_id"), (F.col("user_id") % 3).alias("track"))
    j = o.join(prediction_match(s, d), "onset_id", "left")
    j = rounds(s, "leads")(j, "leads")
    counts = j.groupBy("track").agg(F.round(F.count("lead_s") / F.count("*"), 6).alias("recall"), F.count_if(F.col("lead_s").between(900, 43200)).alias("in_band"))
    return counts.join(ag.exact_quantiles(j, ["track"], "lead_s", {"median_lead_s": 0.5}), "track", "left")


def score_fpr(s, d):
    """Benign events (clicks) alerted upon: an error of the user within six hours after."""
    b = ev(s, d).filter("event_type = 'click'").select(F.col("event_id").alias("b"), "user_id", F.col("ts").alias("bt"))
    a = ev(s, d).filter("event_type = 'error'").select("user_id", "ts")
    hit = interval_join(a, b, ["user_id"], "ts", "bt", 6 * 3_600_000).select("b").distinct().withColumn("hit", F.lit(1))
    return b.join(hit, "b", "left").groupBy((F.col("user_id") % 3).alias("track")).agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 6).alias("fpr"))


def strict_window_semi_anti(s, d):
    """Days of a user without an onset that day or the next that still had an alert."""
    e = ev(s, d)
    bins = e.select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bin")).distinct()
    on = e.filter("event_type = 'error'").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"))
    near = on.select("user_id", F.explode(F.array(F.col("d"), F.col("d") - F.expr("INTERVAL 1 DAY"))).alias("bin")).distinct()
    quiet = bins.join(near, ["user_id", "bin"], "left_anti")
    alerts = e.filter("event_type = 'purchase'").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bin")).distinct()
    return quiet.join(alerts, ["user_id", "bin"], "left_semi")


def score_attribution(s, d):
    j = _readings(s, d).withColumn("sev", F.round("severity", 9)).groupBy("user_id", "day").agg(F.max_by("family", F.struct("sev", "family")).alias("predicted"), F.max("sev").alias("sev"))
    truth = F.when(F.col("user_id") % 2 == 0, F.lit("saturation")).otherwise(F.lit("errors"))
    return j.filter("sev > 0").groupBy((F.col("user_id") % 3).alias("track")).agg(F.round(F.count_if(F.col("predicted") == truth) / F.count("*"), 6).alias("accuracy"), F.count("*").alias("n"))


def score_alert_reduction(s, d):
    c = changes(s, d)
    e = ev(s, d)
    inside = covered_join(e, c, ["user_id"], "ts", "start_ts", "end_ts", "left_semi", ["entity"]).select("event_id", "event_type")
    n = lambda k: F.count_if(F.col("event_type") == k)
    return inside.agg(n("error").alias("ours"), n("view").alias("static"), F.round(1 - n("error") / F.nullif(n("view"), F.lit(0)), 6).alias("reduction"))


def score_collapse(s, d):
    c = dt.collapse_incidents(_alerts(s, d), "cause", "ts", "confidence", "alert_id", 3600).select("cause", "episode", F.explode("members").alias("alert_id"))
    return c.groupBy("cause").agg(F.countDistinct("episode").alias("incidents"), F.count("*").alias("alerts"), F.round(F.countDistinct("episode") / F.count("*"), 6).alias("ratio"))


def score_novel(s, d):
    known = ["\"k\": 1", "\"k\": 2"]
    novel = ~F.exists(F.array(*[F.lit(k) for k in known]), lambda k: F.col("props").contains(k))
    return ev(s, d).groupBy("event_type").agg(F.count_if(novel).alias("n_novel"), F.count("*").alias("n"))


def track_from_domain(s, d):
    """The track of a day's strongest family, families standing in for domains."""
    domain = F.when(F.col("family") == "saturation", F.lit("application")).when(F.col("family") == "errors", F.lit("database")).when(F.col("family") == "latency", F.lit("network"))
    f = dt.family_severity(_readings(s, d), ["user_id", "day"]).filter("severity > 0").withColumn("severity", F.round("severity", 9))
    top = f.groupBy("user_id", "day").agg(F.max_by(domain, F.struct("severity", "family")).alias("domain"))
    return top.select("user_id", "day", "domain", dt.track_of(F.col("domain")).alias("track"))


def suppression_ab(s, d):
    """Recall of onsets without and with suppression of predictions inside change windows, and the loss in percentage points."""
    p = ev(s, d).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("prediction_id"), F.col("ts").alias("emitted"))
    hushed = covered_join(p, changes(s, d), ["user_id"], "emitted", "start_ts", "end_ts", "left_semi", ["entity"]).select("prediction_id", F.lit(True).alias("hushed"))
    o = ev(s, d).filter("event_type = 'error'").select("user_id", F.col("event_id").alias("onset_id"), F.col("ts").alias("onset"))
    met = interval_join(o, p.join(hushed, "prediction_id", "left"), ["user_id"], "onset", "emitted", 2 * 86_400_000).filter(F.col("emitted") < F.col("onset"))
    per = met.groupBy("onset_id").agg(F.max(F.col("hushed").isNull()).alias("on"))
    r = o.join(per, "onset_id", "left").agg(F.count("*").alias("n"), F.count("on").alias("off"), F.count_if("on").alias("on"))
    return r.select("n", F.round(F.col("off") / F.col("n"), 6).alias("recall_off"), F.round(F.col("on") / F.col("n"), 6).alias("recall_on"), F.round((F.col("off") - F.col("on")) * 100 / F.col("n"), 4).alias("delta_pp"))


def gate_metrics(s, d):
    """metric, value: what the gates are held against; tracks are users by remainder."""
    j = ev(s, d).filter("event_type = 'error'").select(F.col("event_id").alias("onset_id"), (F.col("user_id") % 3).alias("track")).join(prediction_match(s, d), "onset_id", "left")
    only = lambda k, c: c if k is None else F.when(F.col("track") == k, c)
    names = {None: "", 0: "_unresponsiveness", 1: "_cross_domain"}
    cols = {}
    for k, n in names.items():
        cols[f"recall{n}"] = F.round(F.count(only(k, F.col("lead_s"))) / F.nullif(F.count(only(k, F.lit(1))), F.lit(0)), 6)
        cols[f"lead_time_median{n}_s"] = F.median(only(k, F.col("lead_s"))).cast("double")
    rows = [j.agg(*[c.alias(n) for n, c in cols.items()])]
    fpr = score_fpr(s, d).withColumn("hits", F.col("fpr") * F.col("n"))
    rows.append(fpr.agg(*[F.round(F.sum(only(k, F.col("hits"))) / F.sum(only(k, F.col("n"))), 6).alias(f"fpr{n}") for k, n in names.items()]))
    acc = score_attribution(s, d).withColumn("hits", F.col("accuracy") * F.col("n"))
    rows.append(acc.agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("domain_accuracy"), F.round(F.sum(only(2, F.col("hits"))) / F.sum(only(2, F.col("n"))), 6).alias("db_cascade_attribution_accuracy")))
    rows.append(score_alert_reduction(s, d).select(F.col("reduction").alias("patching_alert_reduction")))
    rows.append(suppression_ab(s, d).select(F.col("delta_pp").alias("suppression_recall_delta_pp")))
    rows.append(score_collapse(s, d).agg(F.count_if(F.col("incidents") > 1).cast("double").alias("upstream_faults_with_multiple_incidents"), F.count("*").cast("double").alias("upstream_faults_alerted")))
    rows.append(score_novel(s, d).agg(F.round(F.sum("n_novel") / F.sum("n"), 6).alias("novel_signature_flagged"), F.count_if(F.col("n_novel") > 0).cast("double").alias("novel_signature_absence_proofs")))
    out = None
    for r in rows:
        long = r.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in r.columns])))
        out = long if out is None else out.unionByName(long)
    return out


def gate_eval(s, d):
    """All gates against the metrics; an undefined value is not a pass."""
    return rules.judge_gates(gate_metrics(s, d))


def result_digest(s, d):
    """The digest of the predictions of each user: equal whatever order and partitions they were made in."""
    return dt.digest(ev(s, d).select("user_id", "event_id", "event_type", "props"), ["user_id"])


def train_window_select(s, d):
    """Rows of the history phase, or the leading 40 % of a user's rows."""
    w = Window.partitionBy("user_id")
    e = ev(s, d).withColumns({"rn": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.count("*").over(w)})
    return e.filter(F.col("rn") <= F.floor(F.col("n") * 0.4)).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("until"))


def semantic_window_summary(s, d):
    e = ev(s, d)
    return e.groupBy("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("lines"), F.max("value").alias("max_score"), F.round(F.avg("value"), 6).alias("mean_score"), F.count_if(F.col("value") > 30).alias("flagged"), F.countDistinct("props").alias("signatures"), F.max_by("event_type", F.struct("value", "event_id")).alias("top"))


def incident_process(s, d):
    """Suppress inside a change window, else dispatch or hold: a row an incident."""
    e = ev(s, d).filter("event_type = 'error'")
    c = changes(s, d).select("entity", "start_ts", "end_ts")
    hit = covered_join(e, c, ["user_id"], "ts", "start_ts", "end_ts", "left_semi", ["entity"]).select("event_id", F.lit(True).alias("hit"))
    status = F.when(F.col("hit"), F.lit("SUPPRESSED")).when(logistic(F.col("value") / 10 - 3) >= 0.5, F.lit("DISPATCHED")).otherwise(F.lit("HELD"))
    return e.join(hit, "event_id", "left").select("event_id", status.alias("status"))


def rca_prompt(s, d):
    """The text that a language model would be asked: the facts in a fixed order."""
    logs = ag.string_agg_topn(ev(s, d), ["user_id"], F.struct("ts", "event_id"), F.col("props"), 3, "logs", "; ")
    e = ev(s, d).groupBy("user_id").agg(F.count("*").alias("n")).join(logs, "user_id")
    return e.select("user_id", F.concat(F.lit("Host "), F.col("user_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" events. Recent logs: "), F.col("logs"), F.lit(". State the root cause.")).alias("prompt"))


def generate_table(s, d):
    """Typed columns read from a JSON answer with a declared schema."""
    answer = F.to_json(F.struct(F.col("event_type").alias("category"), (F.col("value") / 100).alias("confidence"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("code")))
    return ev(s, d).select("event_id", F.from_json(answer, "category string, confidence double, code string").alias("r")).select("event_id", "r.category", F.round("r.confidence", 6).alias("confidence"), "r.code")


def contract_validate(s, d):
    """Predictions against closed sets and cross-field rules; a row a broken rule."""
    o = table(s, d, "orders")
    rules = {"R1_status": ~F.col("o_orderstatus").isin("F", "O"), "R2_price": F.col("o_totalprice") <= 1000, "R3_priority": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 50000)}
    broken = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return o.select("o_orderkey", broken.alias("rule"))


def hot_ratio(s, d):
    """Fraction-of-total features: null unless the denominator is positive; unknown parts make a strict sum unknown."""
    e = ev(s, d).withColumn("v", F.when(F.col("value") > 100, F.lit(None)).otherwise(F.col("value")))
    g = e.groupBy("user_id").agg(ag.strict_sum("v").alias("strict"), F.sum("v").alias("tolerant"))
    return g.select("user_id", F.round("strict", 4).alias("strict"), F.round(clamp(F.col("strict") / F.nullif(F.col("tolerant"), F.lit(0.0))), 6).alias("ratio"))


NAMES = [
    robust_z_score, severity_from_z, family_severity_max, hazard_confidence, hazard_all_families, contribution_share, causal_summary, time_to_limit, predicted_horizon, change_explained_fraction, suppression_judge,
    attribution_rank, incident_collapse, cascade_merge, semantic_fusion, remediation_advice, workflow_resolve, prediction_match, score_recall_leadtime, score_fpr, strict_window_semi_anti, score_attribution,
    score_alert_reduction, score_collapse, score_novel, track_from_domain, suppression_ab, gate_metrics, gate_eval, result_digest, train_window_select, semantic_window_summary, incident_process, rca_prompt, generate_table, contract_validate, hot_ratio,
]
QUERIES = {f.__name__: f for f in NAMES}

_FAM = "CASE WHEN feature IN ('click', 'view') THEN 'saturation' WHEN feature = 'error' THEN 'errors' ELSE 'latency' END"
_R = f"""e AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type AS feature, avg(value) AS value FROM events GROUP BY ALL),
b AS (SELECT feature, median(value) AS c, mad(value) * {SIG}::DOUBLE AS s FROM e GROUP BY feature),
z AS (SELECT e.*, {_FAM.replace("feature", "e.feature")} AS family, CASE WHEN e.feature = 'purchase' THEN -1 ELSE 1 END AS dir, (value - c) / greatest(s, 0.01::DOUBLE, abs(c) * 0.05::DOUBLE) AS z FROM e JOIN b USING (feature)),
r AS (SELECT *, greatest(0, least(1, (z * dir - 1.6::DOUBLE) / (9.0::DOUBLE - 1.6::DOUBLE))) AS severity FROM z),
f AS (SELECT user_id, day, family, max(severity) AS severity, arg_min(feature, (-severity, feature)) AS feature FROM r GROUP BY ALL)"""
_W = "CASE family WHEN 'saturation' THEN 2.2::DOUBLE WHEN 'errors' THEN 1.8::DOUBLE ELSE 1.2::DOUBLE END"
_H = f"h AS (SELECT user_id, day, 1 / (1 + exp(-(-3.3::DOUBLE + sum({_W} * severity)))) AS confidence FROM f GROUP BY ALL)"
_X = f"""{CHANGES_SQL}, sh AS (SELECT user_id, day, family, feature, round(severity / nullif(sum(severity) OVER (PARTITION BY user_id, day), 0), 9) AS share FROM f),
tot AS (SELECT user_id, day, sum(share) AS total, bool_or(feature = 'signup') AS hard FROM sh WHERE share IS NOT NULL GROUP BY ALL),
pt AS (SELECT s.user_id, s.day, change_id, start_ts, sum(CASE WHEN (kind = 0 AND family IN ('saturation', 'latency')) OR (kind = 1 AND family = 'errors') OR (kind = 2 AND family = 'saturation') THEN share ELSE 0 END) AS part FROM sh s JOIN changes c ON c.entity = s.user_id AND date_trunc('day', start_ts) = s.day WHERE share IS NOT NULL GROUP BY ALL),
fr AS (SELECT pt.*, CASE WHEN hard THEN 0 WHEN total > 0 THEN part / total ELSE 0 END AS fraction FROM pt JOIN tot USING (user_id, day)),
ex AS (SELECT user_id, day, change_id, round(fraction, 6) AS fraction FROM fr QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY fraction DESC, start_ts, change_id) = 1)"""
_INC = """al AS (SELECT event_id AS alert_id, user_id % 10 AS cause, ts, value AS confidence FROM events WHERE event_type = 'error'),
n AS (SELECT *, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY cause ORDER BY ts) > 3600000 THEN 1 ELSE 0 END AS new FROM al),
ep AS (SELECT *, CAST(sum(new) OVER (PARTITION BY cause ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM n)"""
_PM = """pm AS (SELECT o.event_id AS onset_id, count(*) AS n, arg_min(p.event_id, (p.ts, p.event_id)) AS first_prediction, date_diff('microsecond', min(p.ts), max(o.ts)) // 1000000 AS lead_s FROM events o JOIN events p ON o.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts < o.ts AND epoch_us(o.ts) // 1000 - epoch_us(p.ts) // 1000 <= 172800000 WHERE o.event_type = 'error' GROUP BY o.event_id)"""
_REC = f"WITH {_PM}, o AS (SELECT event_id AS onset_id, user_id % 3 AS track FROM events WHERE event_type = 'error') SELECT track, round(count(lead_s) / count(*)::DOUBLE, 6) AS recall, median(lead_s) AS median_lead_s, count(*) FILTER (WHERE lead_s BETWEEN 900 AND 43200) AS in_band FROM o LEFT JOIN pm USING (onset_id) GROUP BY track"
_FPR = "SELECT user_id % 3 AS track, count(*) AS n, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM events a WHERE a.user_id = b.user_id AND a.event_type = 'error' AND b.ts <= a.ts AND epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000 <= 21600000)) / count(*)::DOUBLE, 6) AS fpr FROM events b WHERE event_type = 'click' GROUP BY ALL"
_COL = f"WITH {_INC} SELECT cause, count(DISTINCT episode) AS incidents, count(DISTINCT alert_id) AS alerts, round(count(DISTINCT episode) / count(DISTINCT alert_id)::DOUBLE, 6) AS ratio FROM ep GROUP BY cause"
_TTL = """e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE - 1704067200.0::DOUBLE AS t, value FROM events),
pr AS (SELECT x.event_id, p.t AS pt, p.value AS pv, q.t AS qt, q.value AS qv FROM e x JOIN e p ON p.user_id = x.user_id AND p.t >= x.t - 432000 AND (p.t, p.event_id) <= (x.t, x.event_id) JOIN e q ON q.user_id = x.user_id AND (q.t, q.event_id) <= (x.t, x.event_id) AND q.t > p.t),
cnt AS (SELECT x.event_id, count(*) AS n_points FROM e x JOIN e p ON p.user_id = x.user_id AND p.t >= x.t - 432000 AND (p.t, p.event_id) <= (x.t, x.event_id) GROUP BY ALL),
sl AS (SELECT event_id, median((qv - pv) / (qt - pt)) AS slope FROM pr GROUP BY ALL),
lv AS (SELECT user_id, greatest(quantile_cont(value, 0.995), median(value) + 6 * stddev_pop(value)) AS level FROM e GROUP BY ALL),
ttl AS (SELECT e.event_id, n_points, CASE WHEN n_points >= 6 THEN coalesce(slope, 0.0) END AS slope, CASE WHEN n_points >= 6 AND slope > 0 AND level > value THEN (level - value) / slope / 3600 END AS hours FROM e JOIN cnt USING (event_id) LEFT JOIN sl USING (event_id) JOIN lv USING (user_id))"""
_EV = f"""{_R}, {_H}, ev AS (SELECT user_id AS entity, epoch_us(day) // 1000000 AS moment, round(confidence, 12) AS confidence, causal FROM h JOIN (SELECT user_id, day, coalesce(max(severity) FILTER (feature <> 'purchase'), 0.0) AS causal FROM r GROUP BY ALL) USING (user_id, day))"""
_UP = "up(entity, cause) AS (SELECT DISTINCT user_id, user_id // 3 FROM events WHERE user_id > 0 UNION SELECT entity, cause // 3 FROM up WHERE cause > 0)"
_HORIZON = f"""{_EV}, ft AS (SELECT *, epoch_us(day) // 1000000 AS t FROM r),
q AS (SELECT feature, greatest(quantile_cont(value, 0.995), median(value) + 6 * stddev_pop(value)) AS hi, median(value) * 0.1::DOUBLE AS lo FROM r GROUP BY ALL),
fp AS (SELECT x.user_id, x.feature, x.t, median((b.value - a.value) / (b.t - a.t)) AS slope FROM ft x JOIN ft a ON a.user_id = x.user_id AND a.feature = x.feature AND a.t BETWEEN x.t - 864000 AND x.t JOIN ft b ON b.user_id = x.user_id AND b.feature = x.feature AND b.t <= x.t AND b.t > a.t GROUP BY ALL),
fc AS (SELECT x.user_id, x.feature, x.t, count(*) AS n FROM ft x JOIN ft a ON a.user_id = x.user_id AND a.feature = x.feature AND a.t BETWEEN x.t - 864000 AND x.t GROUP BY ALL),
sg AS (SELECT x.user_id, x.t, min(CASE WHEN n < 4 THEN NULL WHEN dir > 0 AND slope > 0 AND hi > value THEN (hi - value) / slope WHEN dir < 0 AND slope < 0 AND value > lo THEN (value - lo) / -slope END) AS signal FROM ft x JOIN fc USING (user_id, feature, t) LEFT JOIN fp USING (user_id, feature, t) JOIN q USING (feature) WHERE severity > 0 GROUP BY ALL),
hp AS (SELECT x.entity, x.moment, median((b.confidence - a.confidence) / (b.moment - a.moment)) AS slope FROM ev x JOIN ev a ON a.entity = x.entity AND a.moment BETWEEN x.moment - 864000 AND x.moment JOIN ev b ON b.entity = x.entity AND b.moment <= x.moment AND b.moment > a.moment GROUP BY ALL),
hc AS (SELECT x.entity, x.moment, count(*) AS n FROM ev x JOIN ev a ON a.entity = x.entity AND a.moment BETWEEN x.moment - 864000 AND x.moment GROUP BY ALL),
st AS (SELECT *, sum(CASE WHEN confidence >= 0.05 THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY moment) AS island FROM ev),
os AS (SELECT *, CASE WHEN confidence >= 0.05 THEN min(CASE WHEN confidence >= 0.05 THEN moment END) OVER (PARTITION BY entity, island) END AS onset FROM st),
al AS (SELECT os.entity AS user_id, os.moment, signal, CASE WHEN n >= 4 AND slope > 0 THEN (1 - confidence) / slope END AS ramp, nullif(os.moment - onset, 0)::DOUBLE AS elapsed FROM os JOIN hc USING (entity, moment) LEFT JOIN hp USING (entity, moment) LEFT JOIN sg ON sg.user_id = os.entity AND sg.t = os.moment)
SELECT user_id, moment, round_even(least(greatest(coalesce(least(CASE WHEN signal > 0 THEN signal END, CASE WHEN ramp > 0 THEN ramp END), elapsed, 3600.0::DOUBLE), 3600), 1728000), 0)::BIGINT AS horizon_s FROM al"""
_ATTRIBUTED = f"""{_EV}, {_UP},
cz AS (SELECT x.entity AS subject, x.moment, x.entity AS cause FROM ev x WHERE confidence >= 0.05 UNION SELECT x.entity, x.moment, up.cause FROM ev x JOIN up ON up.entity = x.entity JOIN (SELECT DISTINCT entity FROM ev) k ON k.entity = up.cause WHERE confidence >= 0.05),
pd AS (SELECT cause, entity FROM up WHERE entity IN (SELECT entity FROM ev) AND cause IN (SELECT entity FROM ev) UNION SELECT DISTINCT entity, entity FROM ev),
np AS (SELECT cause, count(*) AS np FROM pd GROUP BY ALL), nh AS (SELECT moment, count(*) AS nh FROM ev WHERE confidence >= 0.05 GROUP BY ALL),
mt AS (SELECT cause, moment, count(*) AS nm FROM pd JOIN ev USING (entity) WHERE confidence >= 0.05 GROUP BY ALL),
tr AS (SELECT c.subject, c.moment, c.cause, s.moment AS step, x.causal AS x, y.confidence AS y FROM cz c JOIN (SELECT DISTINCT moment FROM ev) s ON s.moment BETWEEN c.moment - 604800 AND c.moment LEFT JOIN ev x ON x.entity = c.cause AND x.moment = s.moment LEFT JOIN ev y ON y.entity = c.subject AND y.moment = s.moment WHERE c.subject <> c.cause),
ld AS (SELECT subject, moment, cause, min(step) FILTER (y >= 0.05) - min(step) FILTER (x > 0) AS lead FROM tr GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY subject, moment, cause ORDER BY x) + (count(*) OVER (PARTITION BY subject, moment, cause, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY subject, moment, cause ORDER BY y) + (count(*) OVER (PARTITION BY subject, moment, cause, y) - 1) / 2.0::DOUBLE AS ry FROM tr WHERE x IS NOT NULL AND y IS NOT NULL),
rh AS (SELECT subject, moment, cause, CASE WHEN count(*) >= 4 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY ALL),
tm AS (SELECT c.subject, c.moment, c.cause, CASE WHEN c.subject = c.cause THEN greatest(coalesce(e.causal, 0), 0.08::DOUBLE) ELSE coalesce(e.causal, 0) END AS local, coalesce(nm / np::DOUBLE, 0) AS coverage, coalesce(nm / nh::DOUBLE, 0) AS precision,
  CASE WHEN lead IS NULL THEN 0 ELSE least(greatest(lead / 259200.0::DOUBLE, -1), 1) END AS precedence, coalesce(rho, 0) AS correlation
  FROM cz c LEFT JOIN ev e ON e.entity = c.cause AND e.moment = c.moment LEFT JOIN mt ON mt.cause = c.cause AND mt.moment = c.moment LEFT JOIN np ON np.cause = c.cause LEFT JOIN nh ON nh.moment = c.moment LEFT JOIN ld ON ld.subject = c.subject AND ld.moment = c.moment AND ld.cause = c.cause LEFT JOIN rh ON rh.subject = c.subject AND rh.moment = c.moment AND rh.cause = c.cause),
sc AS (SELECT *, round(local * greatest(0, 1 + 0.9::DOUBLE * CASE WHEN coverage + precision > 0 THEN 2 * coverage * precision / (coverage + precision) ELSE 0 END + 0.5::DOUBLE * precedence + 0.5::DOUBLE * greatest(0, correlation)), 9) AS score FROM tm),
rn AS (SELECT *, row_number() OVER (PARTITION BY subject, moment ORDER BY score DESC, cause)::INT AS rank FROM sc)"""
_AB = f"""WITH {CHANGES_SQL}, p AS (SELECT user_id, ts, EXISTS (SELECT 1 FROM changes c WHERE c.entity = e.user_id AND e.ts BETWEEN start_ts AND end_ts) AS hushed FROM events e WHERE event_type = 'purchase'),
o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
m AS (SELECT o.event_id, bool_or(NOT p.hushed) AS on_ FROM o JOIN p ON p.user_id = o.user_id AND p.ts < o.ts AND epoch_us(o.ts) // 1000 - epoch_us(p.ts) // 1000 <= 172800000 GROUP BY ALL),
c AS (SELECT count(*) AS n, count(on_) AS off, count(*) FILTER (WHERE on_) AS on_ FROM o LEFT JOIN m USING (event_id))
SELECT n, round(off / n::DOUBLE, 6) AS recall_off, round(on_ / n::DOUBLE, 6) AS recall_on, round((off - on_) * 100 / n::DOUBLE, 4) AS delta_pp FROM c"""
_NAMES = {"true": "", "track = 0": "_unresponsiveness", "track = 1": "_cross_domain"}
_METRICS = f"""WITH {_PM}, j AS (SELECT event_id AS onset_id, user_id % 3 AS track FROM events WHERE event_type = 'error'), l AS (SELECT * FROM j LEFT JOIN pm USING (onset_id)),
fp AS (SELECT *, fpr * n AS hits FROM ({_FPR})), ac AS (SELECT *, accuracy * n AS hits FROM (_ACC_)), rd AS (_RED_), ab AS ({_AB}), co AS ({_COL}), nv AS (SELECT event_type, count(*) FILTER (WHERE NOT (contains(props, '"k": 1') OR contains(props, '"k": 2'))) AS n_novel, count(*) AS n FROM events GROUP BY ALL)
""" + " UNION ALL ".join(
    [f"SELECT 'recall{n}' AS metric, round(count(lead_s) FILTER (WHERE {w}) / nullif(count(*) FILTER (WHERE {w}), 0)::DOUBLE, 6)::DOUBLE AS value FROM l" for w, n in _NAMES.items()]
    + [f"SELECT 'lead_time_median{n}_s', (median(lead_s) FILTER (WHERE {w}))::DOUBLE FROM l" for w, n in _NAMES.items()]
    + [f"SELECT 'fpr{n}', round(sum(hits) FILTER (WHERE {w}) / sum(n) FILTER (WHERE {w}), 6)::DOUBLE FROM fp" for w, n in _NAMES.items()]
    + [
        "SELECT 'domain_accuracy', round(sum(hits) / sum(n), 6)::DOUBLE FROM ac", "SELECT 'db_cascade_attribution_accuracy', round(sum(hits) FILTER (WHERE track = 2) / sum(n) FILTER (WHERE track = 2), 6)::DOUBLE FROM ac",
        "SELECT 'patching_alert_reduction', reduction::DOUBLE FROM rd", "SELECT 'suppression_recall_delta_pp', delta_pp::DOUBLE FROM ab",
        "SELECT 'upstream_faults_with_multiple_incidents', (count(*) FILTER (WHERE incidents > 1))::DOUBLE FROM co", "SELECT 'upstream_faults_alerted', count(*)::DOUBLE FROM co",
        "SELECT 'novel_signature_flagged', round(sum(n_novel) / sum(n)::DOUBLE, 6)::DOUBLE FROM nv", "SELECT 'novel_signature_absence_proofs', (count(*) FILTER (WHERE n_novel > 0))::DOUBLE FROM nv",
    ]
)
_ACC = f"""WITH {_R}, t AS (SELECT user_id, day, arg_max(family, (round(severity, 9), family)) AS p, max(round(severity, 9)) AS sev FROM r GROUP BY ALL)
SELECT user_id % 3 AS track, round(count(*) FILTER (WHERE p = CASE WHEN user_id % 2 = 0 THEN 'saturation' ELSE 'errors' END) / count(*)::DOUBLE, 6) AS accuracy, count(*) AS n FROM t WHERE sev > 0 GROUP BY ALL"""
_RED = f"""WITH {CHANGES_SQL}, i AS (SELECT DISTINCT event_id, event_type FROM events e JOIN changes c ON e.user_id = c.entity AND e.ts BETWEEN start_ts AND end_ts)
SELECT count(*) FILTER (WHERE event_type = 'error') AS ours, count(*) FILTER (WHERE event_type = 'view') AS static, round(1 - count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::DOUBLE, 6) AS reduction FROM i"""
_METRICS = _METRICS.replace("_ACC_", _ACC).replace("_RED_", _RED)
ORACLE = {
    "robust_z_score": f"WITH {_R} SELECT user_id, day, feature, round(z, 6) AS z FROM r",
    "severity_from_z": f"WITH {_R} SELECT user_id, day, feature, round(severity, 6) AS severity FROM r",
    "family_severity_max": f"WITH {_R} SELECT user_id, day, family, round(severity, 6) AS severity FROM f",
    "hazard_confidence": f"WITH {_R}, {_H} SELECT user_id, day, round(confidence, 6) AS confidence FROM h",
    "contribution_share": f"WITH {_R} SELECT user_id, day, family, feature, round(severity / nullif(sum(severity) OVER (PARTITION BY user_id, day), 0), 6) AS share FROM f",
    "causal_summary": f"WITH {_R} SELECT user_id, day, arg_max(feature, (round(severity, 9), feature)) AS cause FROM r WHERE feature <> 'purchase' GROUP BY ALL",
    "time_to_limit": f"WITH {_TTL} SELECT event_id, n_points, round(slope * 3600, 6) AS slope_h, round(hours, 3) AS hours FROM ttl",
    "predicted_horizon": f"WITH {_HORIZON}",
    "change_explained_fraction": f"WITH {_R}, {_X} SELECT * FROM ex",
    "suppression_judge": f"""WITH {_R}, {_H}, {_X}, j AS (SELECT h.user_id, h.day, round(confidence, 9) AS c, coalesce(fraction, 0) AS f FROM h LEFT JOIN ex USING (user_id, day))
SELECT user_id, day, f >= 0.05 AND (1 / (1 + exp(-(ln(c / (1 - c)) - 2.5::DOUBLE * f))) < 0.1 OR f >= 0.9) AS suppressed FROM j""",
    "attribution_rank": f"WITH RECURSIVE {_ATTRIBUTED} SELECT subject, moment, cause, rank, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("local", "coverage", "precision", "precedence", "correlation", "score")) + " FROM rn WHERE rank <= 3",
    "incident_collapse": f"""WITH {_INC} SELECT cause, arg_max(alert_id, (confidence, -alert_id)) AS representative, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM ep GROUP BY cause, episode""",
    "semantic_fusion": """WITH c AS (SELECT g.event_id AS signal_id, arg_min(c.event_id, (abs(epoch_us(c.ts) // 1000 - epoch_us(g.ts) // 1000), c.event_id)) AS candidate_id FROM events g JOIN events c ON c.user_id = g.user_id AND c.event_type = 'error' AND abs(epoch_us(c.ts) // 1000 - epoch_us(g.ts) // 1000) <= 21600000 WHERE g.event_type = 'signup' GROUP BY ALL)
SELECT event_id AS signal_id, candidate_id, candidate_id IS NULL AS created FROM events LEFT JOIN c ON signal_id = event_id WHERE event_type = 'signup'""",
    "remediation_advice": f"""WITH {_R}, t AS (SELECT user_id, day, arg_max(family, (round(severity, 9), family)) AS family, max(round(severity, 9)) AS sev FROM f GROUP BY ALL)
SELECT user_id, day, CASE WHEN sev = 0 THEN 'observe' WHEN family = 'errors' THEN 'roll back the last change' WHEN family = 'saturation' THEN 'add capacity' ELSE 'inspect dependencies' END AS advice FROM t""",
    "workflow_resolve": "SELECT event_id, CASE event_type WHEN 'error' THEN 'restart' WHEN 'click' THEN 'scale' ELSE 'runbook-' || (user_id % 4) END AS workflow FROM events",
    "prediction_match": f"WITH {_PM} SELECT * FROM pm",
    "score_recall_leadtime": _REC,
    "score_fpr": _FPR,
    "strict_window_semi_anti": """WITH b AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS bin FROM events)
SELECT user_id, bin FROM b WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = b.user_id AND o.event_type = 'error' AND date_trunc('day', o.ts) IN (bin, bin + INTERVAL 1 DAY)) AND EXISTS (SELECT 1 FROM events a WHERE a.user_id = b.user_id AND a.event_type = 'purchase' AND date_trunc('day', a.ts) = bin)""",
    "score_attribution": _ACC,
    "score_alert_reduction": _RED,
    "score_collapse": _COL,
    "score_novel": """SELECT event_type, count(*) FILTER (WHERE NOT (contains(props, '"k": 1') OR contains(props, '"k": 2'))) AS n_novel, count(*) AS n FROM events GROUP BY ALL""",
    "hazard_all_families": f"""WITH w(k, family, weight) AS (VALUES {", ".join(f"({i}, '{n}', {x}::DOUBLE)" for i, (n, x) in enumerate(dt.FAMILY_WEIGHTS.items()))}),
m AS (SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, weight, max(greatest(0, least(1, value / 200))) AS s FROM events JOIN w ON w.k = event_id % 16 GROUP BY user_id, week, family, weight)
SELECT user_id, week, round(1 / (1 + exp(-(-3.3::DOUBLE + sum(weight * s)))), 6) AS confidence FROM m GROUP BY user_id, week""",
    "track_from_domain": f"""WITH {_R}, t AS (SELECT user_id, day, arg_max(CASE family WHEN 'saturation' THEN 'application' WHEN 'errors' THEN 'database' ELSE 'network' END, (round(severity, 9), family)) AS domain FROM f WHERE severity > 0 GROUP BY ALL)
SELECT user_id, day, domain, CASE domain WHEN 'application' THEN 'unresponsiveness' ELSE 'cross_domain' END AS track FROM t""",
    "suppression_ab": f"SELECT * FROM ({_AB})",
    "gate_metrics": f"SELECT * FROM ({_METRICS})",
    "gate_eval": f"""WITH m AS ({_METRICS}), g(gate, metric, op, bound) AS (VALUES {", ".join(f"('{g}', '{m}', '{o}', {b}::DOUBLE)" for g, m, o, b in rules.GATES)})
SELECT gate, g.metric, value, coalesce(CASE op WHEN '>=' THEN value >= bound WHEN '<=' THEN value <= bound WHEN '>' THEN value > bound ELSE value = bound END, false) AS passed FROM g LEFT JOIN m USING (metric)""",
    "result_digest": """WITH c AS (SELECT user_id, concat_ws('|', event_id::VARCHAR, coalesce(event_type, ''), coalesce(props, '')) AS b, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n, bit_xor(('0x' || substr(sha256(b || '|' || n), 1, 15))::BIGINT) AS digest FROM c GROUP BY user_id""",
    "cascade_merge": f"""WITH RECURSIVE {_INC}, i AS (SELECT cause, episode, min(ts) AS s, max(ts) AS z, count(*) AS n FROM ep GROUP BY cause, episode),
p AS (SELECT a.cause, a.episode, arg_max({{'c': b.cause, 'e': b.episode}}, (a.cause - b.cause, -b.episode)) AS up FROM i a JOIN i b ON b.cause < a.cause AND a.cause // 3 = b.cause // 3 AND a.s <= b.z AND b.s <= a.z GROUP BY ALL),
r(cause, episode, rc, re, hop) AS (SELECT cause, episode, cause, episode, 0 FROM i UNION ALL SELECT r.cause, r.episode, p.up.c, p.up.e, hop + 1 FROM r JOIN p ON p.cause = r.rc AND p.episode = r.re)
SELECT r.cause, r.episode, arg_max(rc, hop) AS root_cause, arg_max(re, hop) AS root_episode, any_value(i.n) AS n FROM r JOIN i ON i.cause = r.cause AND i.episode = r.episode GROUP BY r.cause, r.episode""",
    "train_window_select": "WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, count(*) AS n, max(ts) AS until FROM x WHERE rn <= floor(n * 0.4::DOUBLE) GROUP BY ALL",
    "semantic_window_summary": "SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS lines, max(value) AS max_score, round(avg(value), 6) AS mean_score, count(*) FILTER (WHERE value > 30) AS flagged, count(DISTINCT props) AS signatures, arg_max(event_type, (value, event_id)) AS top FROM events GROUP BY ALL",
    "incident_process": f"WITH {CHANGES_SQL} SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM changes c WHERE c.entity = e.user_id AND e.ts BETWEEN start_ts AND end_ts) THEN 'SUPPRESSED' WHEN 1 / (1 + exp(-(value / 10 - 3))) >= 0.5 THEN 'DISPATCHED' ELSE 'HELD' END AS status FROM events e WHERE event_type = 'error'",
    "rca_prompt": "WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, 'Host ' || user_id || ': ' || count(*) || ' events. Recent logs: ' || string_agg(props, '; ' ORDER BY rn) FILTER (WHERE rn <= 3) || '. State the root cause.' AS prompt FROM x GROUP BY user_id",
    "generate_table": "SELECT event_id, event_type AS category, round(value / 100, 6) AS confidence, 'E' || event_id AS code FROM events",
    "contract_validate": "SELECT o_orderkey, 'R1_status' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'R2_price' FROM orders WHERE o_totalprice <= 1000 UNION ALL SELECT o_orderkey, 'R3_priority' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 50000",
    "hot_ratio": "SELECT user_id, round(s, 4) AS strict, round(CASE WHEN s IS NOT NULL THEN greatest(0, least(1, s / nullif(t, 0))) END, 6) AS ratio FROM (SELECT user_id, CASE WHEN count(*) = count(v) THEN sum(v) END AS s, sum(v) AS t FROM (SELECT user_id, CASE WHEN value <= 100 THEN value END AS v FROM events) GROUP BY ALL)",
}
