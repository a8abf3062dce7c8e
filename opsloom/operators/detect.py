"""Detection and decision operators: severity, hazard, attribution, suppression, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import clamp, epoch_ms, logistic, logit
from opsloom.operators.joins import overlap_join
from opsloom.operators.timeseries import episodes
from opsloom.shared import rounds

ENTER_Z, FULL_Z = 1.6, 9.0  # fixed values: where severity starts and is full
BIAS = -3.3  # fixed value of the hazard
# What each family's severity weighs in the hazard.
FAMILY_WEIGHTS = {
    "descriptor_exhaustion": 3.5, "thread_starvation": 2.6, "cpu_without_throughput": 2.5, "memory_pressure": 3.5, "io_wait": 1.8, "disk_latency": 1.7, "kernel_pressure": 1.2, "service_health": 1.1,
    "db_contention": 2.6, "db_session_pool": 2.2, "db_long_running_sql": 2.0, "db_throughput": 1.1, "net_port_errors": 2.6, "net_packet_loss": 2.5, "net_ospf_flap": 2.5, "net_congestion": 1.4,
}


def severity(z: Column, direction: Column) -> Column:
    """0 below an adverse z of 1.6, 1 from 9; direction is 1 (up is bad) or -1."""
    return clamp((z * direction - ENTER_Z) / (FULL_Z - ENTER_Z))


def family_severity(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest severity of a family's features at each key."""
    return readings.groupBy(*keys, "family").agg(F.max("severity").alias("severity"))


def hazard(families: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """confidence = logistic(bias + sum of weight * severity); the weights are a small table."""
    joined = families.join(weights, "family", "left")
    return joined.groupBy(*keys).agg(logistic(F.lit(BIAS) + F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("severity"))).alias("confidence"))


def contribution_share(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Each family's driver (greatest severity, ties by smallest name) and its share of the total."""
    top = readings.groupBy(*keys, "family").agg(F.min_by("feature", F.struct(-F.col("severity"), F.col("feature"))).alias("feature"), F.max("severity").alias("severity"))
    total = F.sum("severity").over(Window.partitionBy(*keys))
    return top.withColumn("share", F.when(total > 0, F.col("severity") / total))


def failure_level(center: Column, sigma: Column, p995: Column, direction: Column, ceiling: Column) -> Column:
    """Where a feature counts as failed: a tenth of normal (down), 1 (unit) or the learned ceiling."""
    return F.when(direction < 0, center * 0.1).when(ceiling == "unit", F.lit(1.0)).when(ceiling == "learned", F.greatest(p995, center + sigma * 6))


def time_to_limit(value: Column, slope: Column, level: Column, direction: Column) -> Column:
    """Seconds until the level at this slope; null if it is reached or the slope leads away."""
    gap = (level - value) * direction
    speed = slope * direction
    return F.when((gap > 0) & (speed > 0), gap / speed)


MIN_HORIZON_S, MAX_HORIZON_S = 300, 7200


def horizon(*candidates: Column, elapsed: Column | None = None, lo: float = MIN_HORIZON_S, hi: float = MAX_HORIZON_S) -> Column:
    """The soonest positive candidate, clamped and rounded; without one the time since the onset, and without that the shortest horizon."""
    soonest = F.array_min(F.filter(F.array(*candidates), lambda c: (c > 0) & ~F.isnan(c) & (c < float("inf"))))
    rest = F.lit(None).cast("double") if elapsed is None else F.when(elapsed > 0, elapsed.cast("double"))
    return F.bround(clamp(F.coalesce(soonest, rest, F.lit(float(lo))), lo, hi)).cast("long")


def explained_fraction(contributions: DataFrame, active: DataFrame, families: DataFrame, keys: list[str]) -> DataFrame:
    """The part of a candidate's evidence that the families of an active change explain; the best change wins, ties by (start, id)."""
    total = contributions.groupBy(*keys).agg(F.sum("share").alias("total"), F.max(F.coalesce("hard_fault", F.lit(False))).alias("hard"))
    met = contributions.join(active, keys).join(families, ["kind", "family"], "left").groupBy(*keys, "change_id", "start_ts").agg(F.sum(F.when(F.col("explains"), F.col("share")).otherwise(F.lit(0.0))).alias("part"))
    fraction = F.when(F.col("hard"), F.lit(0.0)).otherwise(F.when(F.col("total") > 0, F.col("part") / F.col("total")).otherwise(F.lit(0.0)))
    scored = met.join(total, keys).withColumn("fraction", fraction)
    w = Window.partitionBy(*keys).orderBy(F.desc("fraction"), "start_ts", "change_id")
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, "change_id", "fraction")


def suppressed(confidence: Column, fraction: Column, hard: Column, threshold: float = 0.48, weight: float = 2.5, overwhelming: float = 0.90, least: float = 0.05) -> Column:
    """Is what remains under the threshold once the change is discounted, or is nearly all explained?"""
    rest = logistic(logit(confidence) - weight * fraction)
    return F.coalesce((fraction >= least) & ((rest < threshold) | ((fraction >= overwhelming) & ~hard)), F.lit(False))


def attribution_score(local: Column, coverage: Column, precision: Column, precedence: Column, rho: Column) -> Column:
    """local * max(0, 1 + 0.9 F1 + 0.5 precedence + 0.5 max(0, rho))."""
    f1 = F.when(coverage + precision > 0, 2 * coverage * precision / (coverage + precision)).otherwise(F.lit(0.0))
    return local * F.greatest(F.lit(0.0), 1 + 0.9 * f1 + 0.5 * precedence + 0.5 * F.greatest(F.lit(0.0), rho))


def collapse_incidents(alerts: DataFrame, cause: str, ts: str, confidence: str, alert_id: str, gap_s: int = 3600) -> DataFrame:
    """Episodes of alerts with one cause become incidents; the representative is the most confident, then the smallest id."""
    e = episodes(alerts, [cause], ts, gap_s)
    rep = F.max_by(F.struct(alert_id, ts, confidence), F.struct(F.col(confidence), -F.col(alert_id)))
    return e.groupBy(cause, "episode").agg(rep.alias("rep"), F.array_sort(F.collect_set(alert_id)).alias("members"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def merge_cascades(incidents: DataFrame, upstream: DataFrame, cause: str) -> DataFrame:
    """Incidents whose times overlap and whose causes are up- and downstream become one cascade, named by its topmost incident.

    ``upstream`` is a closure (node, ancestor, hops). An incident points at the
    overlapping incident of its farthest ancestor; pointers are followed to the
    end, each round twice as far, so that chains merge as well. Rounds are written.
    """
    written = rounds(incidents.sparkSession, "cascades")
    incidents = written(incidents, "incidents")
    a = incidents.select(F.col(cause).alias("node"), F.col("episode").alias("e"), F.col("start").alias("s"), F.col("end").alias("z"))
    b = incidents.select(F.col(cause).alias("ancestor"), F.col("episode").alias("ae"), F.col("start").alias("bs"), F.col("end").alias("bz"))
    near = overlap_join(a.join(upstream, "node"), b, "ancestor", "ancestor", "s", "z", "bs", "bz", inclusive=True)
    first = near.groupBy("node", "e").agg(F.max_by(F.struct("_ancestor", "ae"), F.struct("hops", -F.col("ae"))).alias("root"))
    points = written(first.select("node", "e", F.col("root._ancestor").alias("r"), F.col("root.ae").alias("re")), "points0")
    k = 0
    while True:
        k += 1
        ahead = points.select(F.col("node").alias("r"), F.col("e").alias("re"), F.col("r").alias("rr"), F.col("re").alias("rre"))
        moved = written(points.join(ahead, ["r", "re"], "left").select("node", "e", F.coalesce("rr", "r").alias("r"), F.coalesce("rre", "re").alias("re"), F.col("rr").isNotNull().alias("moved")), f"points{k}")
        points = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    root = points.select("node", F.col("e").alias("_e"), "r", "re")
    out = incidents.join(root, (incidents[cause] == root.node) & (incidents.episode == root["_e"]), "left")
    return out.select(*[incidents[c] for c in incidents.columns], F.coalesce("r", incidents[cause]).alias("root_cause"), F.coalesce("re", incidents.episode).alias("root_episode"))


def fuse(candidates: DataFrame, signals: DataFrame, entity: str, ts: str, reach_s: int = 3600) -> DataFrame:
    """Semantic signals attach to the entity's nearest candidate within reach; the others become candidates of their own."""
    c = candidates.select(entity, F.col(ts).alias("c_ts"), F.col("candidate_id"))
    b = lambda x: F.floor(epoch_ms(x) / (reach_s * 1000))
    near = signals.withColumn("_b", F.explode(F.array(b(ts) - 1, b(ts), b(ts) + 1))).join(c.withColumn("_b", b("c_ts")), [entity, "_b"])
    far = F.abs(epoch_ms("c_ts") - epoch_ms(ts))
    best = near.withColumn("_d", far).filter(F.col("_d") <= reach_s * 1000).groupBy("signal_id").agg(F.min_by("candidate_id", F.struct("_d", "candidate_id")).alias("candidate_id"))
    return signals.join(best, "signal_id", "left").withColumn("created", F.col("candidate_id").isNull())


TRACKS = {"application": "unresponsiveness", "database": "cross_domain", "network": "cross_domain"}  # fixed values


def track_of(domain: Column) -> Column:
    """The evaluation track of a root-cause domain; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TRACKS.items() for x in kv]), domain)


def digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, digest: a number that two tables share if they hold the same rows, in whatever order.

    The exclusive or of 60 bits of the rows' SHA-256, repeats told apart by their count.
    """
    others = [c for c in rows.columns if c not in keys]
    body = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others])
    counted = rows.select(*keys, body.alias("_b")).groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("_b"), F.col("_n").cast("string")), 256), 1, 15), 16, 10).cast("long")
    return counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.bit_xor(bits).alias("digest"))
