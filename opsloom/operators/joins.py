"""Interval, OR-key, as-of and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import epoch_ms


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before_ms: int, how: str = "inner") -> DataFrame:
    """Left rows with the right rows of the same keys in [left_ts - before, left_ts]; ``how`` is inner or left.

    Times are cut into buckets as wide as the interval. A right row is put into
    its own bucket and the next, a left row stays in one, so that each pair
    meets once, unmatched left rows are known where they lie, and a busy key is
    dealt out by time.
    """
    b = lambda c: F.floor(epoch_ms(c) / before_ms)
    r = right.withColumn("_b", F.explode(F.array(b(right_ts), b(right_ts) + 1))).withColumnsRenamed({k: f"_r_{k}" for k in keys} | {"_b": "_rb"})
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_b") == F.col("_rb"), F.col(right_ts) <= F.col(left_ts), epoch_ms(left_ts) - epoch_ms(right_ts) <= before_ms]
    return left.withColumn("_b", b(left_ts)).join(r, on, how).drop("_b", "_rb", *[f"_r_{k}" for k in keys])


def left_interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before_ms: int) -> DataFrame:
    """As ``interval_join``, keeping left rows without a partner."""
    return interval_join(left, right, keys, left_ts, right_ts, before_ms, "left")


def covered_join(points: DataFrame, spans: DataFrame, keys: list[str], ts: str, start: str, end: str, how: str = "inner", span_keys: list[str] | None = None, bucket_ms: int = 86_400_000) -> DataFrame:
    """Rows of ``points`` with the spans of the same keys that hold their time, both ends included; ``how`` is inner, left, left_semi or left_anti.

    A span is put into every time bucket that it touches and a point is in one,
    so a busy key is dealt out by time. ``span_keys`` are the spans' names of
    the keys; columns of the spans keep their names.
    """
    b = lambda c: F.floor(epoch_ms(c) / bucket_ms)
    named = {k: f"_s{i}" for i, k in enumerate(span_keys or keys)}
    right = spans.select("*", *[F.col(k).alias(n) for k, n in named.items()]).drop(*([] if span_keys else keys)).withColumn("_sb", F.explode(F.sequence(b(start), F.greatest(b(start), b(end)))))
    on = [F.col(k) == F.col(n) for k, n in zip(keys, named.values(), strict=True)] + [F.col("_pb") == F.col("_sb"), F.col(ts).between(F.col(start), F.col(end))]
    return points.withColumn("_pb", b(ts)).join(right, on, how).drop("_pb", "_sb", *named.values())


def or_key_max(left: DataFrame, row_id: str, keys: list[str], right: DataFrame, right_key: str, ts: str, start: str, end: str, value: Column, out: str) -> DataFrame:
    """For each left row the greatest ``value`` of the spans that hold its time and whose key equals any of ``keys``; 0 without one.

    The OR becomes an explosion of the distinct keys, an equi-join by key and time bucket and a maximum.
    """
    either = left.withColumn("_k", F.explode(F.array_distinct(F.array(*keys))))
    best = covered_join(either, right, ["_k"], ts, start, end, span_keys=[right_key]).groupBy(row_id).agg(F.max(value).alias(out))
    return left.join(best, row_id, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, out: str) -> DataFrame:
    """Each left row with the latest right ``value`` at or before it (null without one); one shuffle by key."""
    cols = left.columns
    tag = F.struct(F.col(ts).alias("at"), F.col(value).alias("v"))
    both = left.withColumns({"_s": F.lit(1), "_r": F.lit(None).cast(right.select(tag.alias("x")).schema["x"].dataType)}).unionByName(
        right.select(*keys, ts, F.lit(0).alias("_s"), tag.alias("_r")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(ts, "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_l", F.last("_r", True).over(w)).filter("_s = 1").select(*cols, F.col("_l.v").alias(out))


def overlap_join(left: DataFrame, right: DataFrame, key: str, right_key: str, start: str, end: str, r_start: str, r_end: str, bucket_ms: int = 86_400_000, inclusive: bool = False) -> DataFrame:
    """Rows whose intervals overlap (r_start < end and r_end > start; with ``inclusive`` also touch), by key or with a null right key (everywhere).

    Both sides are put into every time bucket they touch and joined by bucket,
    so estate-wide rows meet only what lies near them in time; a pair counts in
    the bucket in which the later of the two begins. Keyed and estate-wide rows
    are joined apart, which keeps both equi-joins. Where both sides name a
    column alike, the right one gets a ``_`` before it.
    """
    b = lambda c: F.floor(epoch_ms(c) / bucket_ms)
    same = {c: f"_{c}" for c in right.columns if c in left.columns}
    right, right_key = right.withColumnsRenamed(same), same.get(right_key, right_key)
    l = left.withColumn("_b", F.explode(F.sequence(b(start), F.greatest(b(start), b(end)))))  # noqa: E741
    r = right.withColumn("_rb", F.explode(F.sequence(b(r_start), F.greatest(b(r_start), b(r_end)))))
    over = (F.col(r_start) <= F.col(end)) & (F.col(r_end) >= F.col(start)) if inclusive else (F.col(r_start) < F.col(end)) & (F.col(r_end) > F.col(start))
    met = (F.col("_b") == F.col("_rb")) & over & (F.col("_b") == F.greatest(b(start), b(r_start)))
    keyed = l.join(r.filter(F.col(right_key).isNotNull()), (F.col(key) == F.col(right_key)) & met)
    wide = l.join(r.filter(F.col(right_key).isNull()), met)
    return keyed.unionByName(wide).drop("_b", "_rb")
