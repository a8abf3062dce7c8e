"""Who is to blame: candidate causes of a distressed entity, scored from evidence, reach, order in time and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import clamp
from opsloom.operators.detect import attribution_score

# Fixed values of the scoring.
DISTRESS_LEVEL = 0.275
SELF_FLOOR = 0.08
LOOKBACK_S = 3600
SCALE_S = 600.0
LEAST_ALIGNED = 4


def _ranked(value: Column, within: list[str], name: str) -> Column:
    """The rank of a value within small groups, ties averaged."""
    same = F.count("*").over(Window.partitionBy(*within, name))
    return F.rank().over(Window.partitionBy(*within).orderBy(value)) + (same - 1) / 2.0


def reach(evidence: DataFrame, downstream: DataFrame, level: float) -> DataFrame:
    """cause, moment, coverage, precision: how well the entities that a cause affects (itself included) match those in distress at a moment.

    All terms are counts by cause, by moment and by both, so no group is held.
    """
    observed = evidence.select("entity").distinct()
    causes = observed.select(F.col("entity").alias("cause"))
    pairs = downstream.select("cause", "entity").filter("cause <> entity").join(observed, "entity", "left_semi").join(causes, "cause", "left_semi")
    predicted = pairs.union(observed.select(F.col("entity").alias("cause"), "entity")).distinct()
    hot = evidence.filter(F.col("confidence") >= level).select("entity", "moment").distinct()
    n_predicted = predicted.groupBy("cause").agg(F.count("*").alias("n_predicted"))
    n_hot = hot.groupBy("moment").agg(F.count("*").alias("n_hot"))
    met = hot.join(predicted, "entity").groupBy("cause", "moment").agg(F.count("*").alias("n_met"))
    return met.join(n_predicted, "cause").join(n_hot, "moment").select("cause", "moment", (F.col("n_met") / F.col("n_predicted")).alias("coverage"), (F.col("n_met") / F.col("n_hot")).alias("precision"))


def attribute(evidence: DataFrame, upstream: DataFrame, downstream: DataFrame, step_s: int, lookback_s: int = LOOKBACK_S, tolerance_s: int | None = None, scale_s: float = SCALE_S, level: float = DISTRESS_LEVEL, self_floor: float = SELF_FLOOR) -> DataFrame:
    """A row for each entity in distress, moment and candidate cause (its upstream and itself), with all terms, the score and the rank.

    ``evidence`` has entity, moment (seconds), causal (the severity that speaks for a
    cause) and confidence (the hazard); ``upstream`` has entity, cause;
    ``downstream`` has cause, entity. Times are taken in steps of ``step_s``, the
    greatest values of a step count.

    - local: the greatest causal evidence of the cause within ``tolerance_s`` before the moment;
    - coverage and precision: see ``reach``;
    - precedence: how long the cause's first evidence in the lookback lies before
      the subject's first distress there, in units of ``scale_s``, from -1 to 1;
    - correlation: Spearman's, of the cause's evidence with the subject's hazard at
      the steps that both have in the lookback, four at least.
    Subjects have no precedence over themselves and do not correlate with
    themselves. Traces are laid out as (subject, moment, cause, step) rows, a
    lookback's steps each, so that long series and busy entities spread.
    """
    back, near = int(lookback_s // step_s), int((step_s if tolerance_s is None else tolerance_s) // step_s) - 1
    e = evidence.groupBy("entity", F.floor(F.col("moment") / step_s).alias("moment")).agg(F.max("causal").alias("causal"), F.max("confidence").alias("confidence"))
    subjects = e.filter(F.col("confidence") >= level).select(F.col("entity").alias("subject"), "moment")
    known = e.select(F.col("entity").alias("cause")).distinct()
    candidates = upstream.select(F.col("entity").alias("subject"), "cause").filter("subject <> cause").distinct().join(known, "cause", "left_semi")
    pairs = subjects.join(candidates, "subject").select("subject", "moment", "cause").union(subjects.select("subject", "moment", F.col("subject").alias("cause")))
    # What is seen of an entity at a moment: its evidence of the steps before that the tolerance reaches.
    seen = e.select(F.col("entity").alias("cause"), F.explode(F.sequence(F.col("moment"), F.col("moment") + near)).alias("moment"), "causal").groupBy("cause", "moment").agg(F.max("causal").alias("seen"))
    key = ["subject", "moment", "cause"]
    steps = pairs.filter("subject <> cause").withColumn("step", F.explode(F.sequence(F.col("moment") - back, F.col("moment"))))
    traces = steps.join(e.select(F.col("entity").alias("cause"), F.col("moment").alias("step"), F.col("causal").alias("x")), ["cause", "step"], "left")
    traces = traces.join(e.select(F.col("entity").alias("subject"), F.col("moment").alias("step"), F.col("confidence").alias("y")), ["subject", "step"], "left")
    both = traces.filter("x is not null and y is not null").withColumns({"rx": _ranked(F.col("x"), key, "x"), "ry": _ranked(F.col("y"), key, "y")})
    pearson = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))  # null where a side does not move
    rho = both.groupBy(*key).agg(F.when(F.count("*") >= LEAST_ALIGNED, pearson).alias("rho"))
    lead = traces.groupBy(*key).agg((F.min(F.when(F.col("y") >= level, F.col("step"))) - F.min(F.when(F.col("x") > 0, F.col("step")))).alias("lead"))
    out = pairs.join(seen, ["cause", "moment"], "left").join(reach(e, downstream, level), ["cause", "moment"], "left").join(lead, key, "left").join(rho, key, "left")
    alone = F.col("subject") == F.col("cause")
    local = F.coalesce("seen", F.lit(0.0))
    out = out.select(
        "subject", (F.col("moment") * step_s).alias("moment"), "cause", F.when(alone, F.greatest(local, F.lit(self_floor))).otherwise(local).alias("local"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce(clamp(F.col("lead") * step_s / scale_s, -1.0, 1.0), F.lit(0.0)).alias("precedence"), F.coalesce("rho", F.lit(0.0)).alias("correlation"),
    )
    score = attribution_score(F.col("local"), F.col("coverage"), F.col("precision"), F.col("precedence"), F.col("correlation"))
    best = Window.partitionBy("subject", "moment").orderBy(F.desc("score"), "cause")
    return out.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(best))
