"""Time-series operators: rollups, gap filling, resampling, rates, episodes, baselines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from opsloom.functions.scalar import SIGMA_OF_MAD, epoch_ms, trunc
from opsloom.operators.aggregates import median_mad
from opsloom.shared import rounds


def rollup_avg(df: DataFrame, unit: str, ts: str, keys: list[str], value: str, out: str = "value") -> DataFrame:
    """The mean of ``value`` for each key and truncated time."""
    return df.groupBy(trunc(unit, ts).alias(ts), *keys).agg(F.avg(value).alias(out))


def dense_grid(keys: DataFrame, bounds: DataFrame, ts: str, step: str) -> DataFrame:
    """Every step from ``start`` to ``end`` (one row of bounds) for every key.

    The bounds are a single row, so broadcasting them is safe; the sequence is
    exploded where the keys lie.
    """
    grid = F.sequence(F.col("start"), F.col("end"), F.expr(f"INTERVAL {step}"))
    return keys.crossJoin(F.broadcast(bounds)).select(*keys.columns, F.explode(grid).alias(ts))


def gap_fill(rolled: DataFrame, ts: str, keys: list[str], value: str, step: str = "1 HOUR") -> DataFrame:
    """A dense series for each key between the first and the last time of all; what is missing is 0."""
    bounds = rolled.agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    grid = dense_grid(rolled.select(*keys).distinct(), bounds, ts, step)
    known = rolled.groupBy(ts, *keys).agg(F.max(value).alias(value))
    return grid.join(known, [ts, *keys], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def robust_bands(series: DataFrame, keys: list[str], value: str, k: float = 3.0) -> DataFrame:
    """median -+ k robust sigmas of each key as ``lower_bound`` and ``upper_bound``; joined to the series.

    The series is written once: it is read for the medians, for the deviations and for the join.
    """
    series = rounds(series.sparkSession, "bands")(series, "series")
    sigma = F.col("robust_sigma")
    bands = median_mad(series, keys, value).select(*keys, F.col("median").alias("center"), sigma.alias("sigma"), (F.col("median") - k * sigma).alias("lower_bound"), (F.col("median") + k * sigma).alias("upper_bound"))
    return series.join(bands, keys)


def anomaly_class(value: Column, lower: Column, upper: Column, flagged: Column) -> Column:
    """Spike, silence (0 tested before dip), dip or normal; the raw lower bound counts."""
    return (
        F.when(flagged & (value > upper), F.lit("SPIKE_ANOMALY"))
        .when(flagged & (value < lower) & (value == 0.0), F.lit("SILENT_HOST_DROP_TO_ZERO"))
        .when(flagged & (value < lower), F.lit("DIP_ANOMALY"))
        .otherwise(F.lit("NORMAL"))
    )


def bucket_ms(ts: Column | str, origin_ms: int, width_ms: int) -> Column:
    """Start of the half-open bucket relative to any origin."""
    return F.floor((epoch_ms(ts) - origin_ms) / width_ms) * width_ms + origin_ms


def feature_windows(df: DataFrame, ts: str, keys: list[str], value: str, origin_ms: int, width_ms: int, end_ms: int) -> DataFrame:
    """Ten aggregates a bucket in [origin, end); the last bucket is clipped to the end."""
    t = epoch_ms(ts)
    rows = df.filter((t >= origin_ms) & (t < end_ms)).withColumn("_t", t).withColumn("bucket_start", bucket_ms(ts, origin_ms, width_ms))
    out = rows.groupBy("bucket_start", *keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("count"), F.stddev_samp(value).alias("stddev"),
        F.min(F.struct("_t", value)).alias("f"), F.max(F.struct("_t", value)).alias("l"),
    )
    first, last = F.col(f"f.{value}"), F.col(f"l.{value}")
    seconds = (F.col("l._t") - F.col("f._t")) / 1000.0
    return out.select(
        "bucket_start", F.least(F.col("bucket_start") + width_ms, F.lit(end_ms)).alias("bucket_end"), *keys, "mean", "min", "max", "sum", "count", "stddev",
        first.alias("first"), last.alias("last"), (last - first).alias("delta"), F.when(seconds > 0, (last - first) / seconds).alias("rate_per_s"),
    )


def counter_rate(df: DataFrame, keys: list[str], ts: str, value: str, out: str = "rate") -> DataFrame:
    """Increase a second since the row before; null after a reset (a smaller value) and for the first row."""
    w = Window.partitionBy(*keys).orderBy(ts)
    dt = (epoch_ms(ts) - F.lag(epoch_ms(ts)).over(w)) / 1000.0
    dv = F.col(value) - F.lag(value).over(w)
    return df.withColumn(out, F.when((dv >= 0) & (dt > 0), dv / dt))


def align_resample(axis: DataFrame, samples: DataFrame, keys: list[str], ts: str, value: str, stale_steps: float = 4.0) -> DataFrame:
    """Each axis time (keys, ts) with the latest sample at or before it, null if older than ``stale_steps`` median steps of its series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = samples.withColumn("_d", epoch_ms(ts) - F.lag(epoch_ms(ts)).over(w)).groupBy(*keys).agg(F.median("_d").alias("step_ms"))
    both = axis.select(*keys, ts, F.lit(1).alias("_axis"), F.lit(None).cast("double").alias(value), F.lit(None).cast("long").alias("_at")).unionByName(
        samples.select(*keys, ts, F.lit(0).alias("_axis"), value, epoch_ms(ts).alias("_at"))
    )
    upto = Window.partitionBy(*keys).orderBy(ts, "_axis").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"_v": F.last(value, True).over(upto), "_a": F.last("_at", True).over(upto)}).filter("_axis = 1")
    fresh = epoch_ms(ts) - F.col("_a") <= F.col("step_ms") * stale_steps
    return seen.join(step, keys, "left").select(*keys, ts, F.when(fresh, F.col("_v")).alias(value))


def episodes(df: DataFrame, keys: list[str], ts: str, gap_seconds: int = 3600) -> DataFrame:
    """Single-linkage groups in time: a gap over ``gap_seconds`` starts a new ``episode`` (from 0)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = F.coalesce(epoch_ms(ts) - F.lag(epoch_ms(ts)).over(w) > gap_seconds * 1000, F.lit(False))
    run = Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_new", new.cast("int")).withColumn("episode", F.sum("_new").over(run)).drop("_new")


def streaks(df: DataFrame, keys: list[str], order: list[str], flag: Column, out: str = "streak") -> DataFrame:
    """How many rows in a row up to this one satisfy ``flag``; 0 where it does not hold. Also ``island``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    f = F.coalesce(flag, F.lit(False))
    marked = df.withColumn("_f", f.cast("int")).withColumn("island", F.sum(1 - F.col("_f")).over(w))
    inside = Window.partitionBy(*keys, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.sum("_f").over(inside)).drop("_f")


def _middle(a: np.ndarray) -> float:
    a = np.sort(a)
    return (a[(len(a) - 1) // 2] + a[len(a) // 2]) / 2


def _frames(values: np.ndarray, known: np.ndarray, first: int, history: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, median and MAD of the ``history`` known values at most before each row from ``first`` on; NaN without one."""
    n, med, mad = np.zeros(len(values), np.int32), np.full(len(values), np.nan), np.full(len(values), np.nan)
    whole = first if known.all() else len(values)  # rows with a full frame of known values are done at once
    whole = max(whole, history)
    for i in range(first, min(whole, len(values))):
        a = values[max(0, i - history) : i][known[max(0, i - history) : i]]
        if len(a):
            n[i], med[i] = len(a), _middle(a)
            mad[i] = _middle(np.abs(a - med[i]))
    for at in range(whole, len(values), 512):
        frame = np.lib.stride_tricks.sliding_window_view(values, history)[at - history : min(at + 512, len(values)) - history]
        ends = [(history - 1) // 2, history // 2]
        m = np.partition(frame, ends, axis=1)[:, ends].sum(1) / 2
        rows = slice(at, at + len(m))
        n[rows], med[rows] = history, m
        mad[rows] = np.partition(np.abs(frame - m[:, None]), ends, axis=1)[:, ends].sum(1) / 2
    return n, med, mad


def prequential_baseline(df: DataFrame, levels: dict[str, list[str]], ts: str, value: str, history: int = 512, chunk: int = 4096) -> DataFrame:
    """For every row and level the count, median and MAD of the rows before it (``history`` at most) with the same level keys.

    A key's rows are numbered and cut into chunks; each also gets the
    ``history`` rows before it, so a busy key is dealt out and no task holds more than a chunk.
    """

    def judged(names: tuple[str, str, str]):
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("_i")
            own = rows.column("_own").to_numpy(zero_copy_only=False)
            if not own.any():  # the rows before a chunk that has none of its own
                rows = rows.slice(0, 0)
            column = rows.column(value).cast(pa.float64())
            made = _frames(column.to_numpy(zero_copy_only=False), ~column.is_null().to_numpy(zero_copy_only=False), int(np.argmax(own)), history)
            for k, v in zip(names, made, strict=True):
                rows = rows.append_column(k, pa.array(v) if k == names[0] else pa.array(v, mask=made[0] == 0))
            return rows.filter(rows.column("_own")).drop_columns(["_i", "_c", "_own"])

        return run

    out = df
    for name, keys in levels.items():
        n, med, mad = f"n_{name}", f"med_{name}", f"mad_{name}"

        numbered = out.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1)
        c = F.floor(F.col("_i") / chunk)
        both = F.when(F.col("_i") % chunk >= chunk - history, F.array(c, c + 1)).otherwise(F.array(c))
        dealt = numbered.withColumn("_c", F.explode(both)).withColumn("_own", F.col("_c") == c)
        schema = StructType([*out.schema.fields, StructField(n, IntegerType()), StructField(med, DoubleType()), StructField(mad, DoubleType())])
        out = dealt.groupBy(*keys, "_c").applyInArrow(judged((n, med, mad)), schema)
    return out


def shrink(n: Column, inner: Column, outer: Column, strength: float = 20.0) -> Column:
    """w * inner + (1 - w) * outer with w = n / (n + strength); outer alone where inner is unknown."""
    w = n / (n + strength)
    return F.when(inner.isNull(), outer).when(outer.isNull(), inner).otherwise(w * inner + (1 - w) * outer)
