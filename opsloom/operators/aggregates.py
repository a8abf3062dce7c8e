"""Aggregates that Spark lacks or names differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.functions.scalar import SIGMA_OF_MAD, order_bucket


def string_agg_topn(df: DataFrame, keys: list[str], order: Column, text: Column, n: int, out: str, sep: str = " | ") -> DataFrame:
    """keys and the texts of the ``n`` greatest orders, joined; ties by text, greatest first. Keys without a text are left out.

    The rank filter becomes a group limit below the shuffle, so that only ``n`` rows of a key leave a task.
    """
    rows = df.select(*keys, order.alias("_o"), text.alias("_t")).filter("_t is not null")
    best = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_o"), F.desc("_t")))).filter(F.col("_k") <= n)
    texts = F.array_sort(F.collect_list(F.struct("_k", "_t")))
    return best.groupBy(*keys).agg(F.array_join(F.transform(texts, lambda x: x["_t"]), sep).alias(out))


def string_agg_distinct(df: DataFrame, keys: list[str], text: Column, n: int, out: str, sep: str = " | ") -> DataFrame:
    """keys and the ``n`` smallest distinct texts, joined; a key without a text has an empty one. No more than ``n`` texts of a key leave a task."""
    rows = df.select(*keys, text.alias("_t")).distinct()
    best = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_t")))).filter(F.col("_k") <= n)
    return best.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_t")), sep).alias(out))


def strict_sum(value: str) -> Column:
    """The sum; null if any member is unknown."""
    return F.when(F.count("*") == F.count(value), F.sum(value))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str = "quantile") -> DataFrame:
    """The smallest value whose cumulated weight reaches ``q`` of the total (a step, not interpolated).

    Weights are summed by value, then by ordered bucket, so that a busy key's running sum is spread over its buckets.
    """
    rows = df.select(*keys, value, weight).withColumn("_b", order_bucket(F.col(value)))
    per = rows.groupBy(*keys, "_b", value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    buckets = per.groupBy(*keys, "_b").agg(F.sum("_w").alias("_n")).withColumns({"_before": F.sum("_n").over(w.orderBy("_b")) - F.col("_n"), "_t": F.sum("_n").over(w)}).drop("_n")
    run = per.join(buckets, [*keys, "_b"]).withColumn("_c", F.col("_before") + F.sum("_w").over(Window.partitionBy(*keys, "_b").orderBy(value)))
    return run.filter(F.col("_c") >= F.col("_t") * q).groupBy(*keys).agg(F.min(value).alias(out))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys and the interpolated quantiles by name; nulls are left out.

    Values are counted in ordered buckets first; a bucket's place among them
    tells which ones hold the ranks that are wanted, and only values of those
    are counted one by one. A busy key is thus spread over its buckets, and no
    task holds all of its values.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", order_bucket(F.col("_v")))
    w = Window.partitionBy(*keys)
    per = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    per = per.withColumns({"_upto": F.sum("_n").over(w.orderBy("_b")), "_all": F.sum("_n").over(w)})
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()]))
    per = per.withColumn("_w", wanted).withColumn("_p", F.col("_w.q") * (F.col("_all") - 1))
    ends = F.array(F.struct(F.floor("_p").alias("_k"), (F.floor("_p") + 1 - F.col("_p")).alias("_share")), F.struct((F.floor("_p") + 1).alias("_k"), (F.col("_p") - F.floor("_p")).alias("_share")))
    targets = per.select(*keys, "_b", F.col("_w.name").alias("_name"), (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.explode(F.filter(ends, lambda e: e["_share"] > 0)).alias("_e"))
    targets = targets.filter((F.col("_e._k") >= F.col("_before")) & (F.col("_e._k") < F.col("_upto"))).select(*keys, "_b", "_name", "_before", "_e._k", "_e._share")
    counted = rows.join(targets.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"))
    counted = counted.withColumn("_run", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    hit = counted.join(targets, [*keys, "_b"]).filter((F.col("_k") < F.col("_before") + F.col("_run")) & (F.col("_k") >= F.col("_before") + F.col("_run") - F.col("_c")))
    return hit.groupBy(*keys).agg(*[F.sum(F.when(F.col("_name") == n, F.col("_v") * F.col("_share"))).alias(n) for n in quantiles])


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, mad and robust_sigma of each key."""
    med = exact_quantiles(df, keys, value, {"median": 0.5})
    dev = df.join(med, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_d"))
    mad = exact_quantiles(dev, keys, "_d", {"mad": 0.5})
    return med.join(mad, keys).withColumn("robust_sigma", F.col("mad") * SIGMA_OF_MAD)


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the rank of ``value`` from 1, ties averaged; ranks are counted within ordered buckets, which spreads a busy key."""
    rows = df.withColumn("_b", order_bucket(F.col(value)))
    per = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")
    place = per.select(*keys, "_b", before.alias("_before"))
    w = Window.partitionBy(*keys, "_b")
    ranked = rows.join(place, [*keys, "_b"]) if keys else rows.join(place, "_b")
    return ranked.withColumn(out, F.col("_before") + F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, "_b", value)) - 1) / 2.0).drop("_b", "_before")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's correlation of averaged ranks; 0 where a side does not vary."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_vx"), F.col(y).alias("_vy"))
    ranked = with_average_rank(with_average_rank(known, keys, "_vx", "_x"), keys, "_vy", "_y")
    moving = (F.var_pop("_x") > 0) & (F.var_pop("_y") > 0)
    return ranked.groupBy(*keys).agg(F.when(moving, F.corr("_x", "_y")).otherwise(F.lit(0.0)).alias("spearman"))


MOST_PAIRS = 4096  # fixed value


def theil_sen(df: DataFrame, keys: list[str], t: str, value: str, window: float, least: int = 2) -> DataFrame:
    """slope and n_points of each key: the median slope of all pairs of points in the last ``window`` before its latest.

    More points than make ``MOST_PAIRS`` pairs are thinned to evenly spaced
    ones, ends included, so a key has 90 points and 4,005 pairs at most. Points
    at one time make no pair; a key without pairs has slope 0, and keys with
    fewer than ``least`` points are left out.
    """
    known = df.select(*keys, F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_v")).filter("_t is not null and _v is not null")
    last = known.groupBy(*keys).agg(F.max("_t").alias("_last"))
    w = Window.partitionBy(*keys)
    points = known.join(last, keys).filter(F.col("_t") >= F.col("_last") - window)
    points = points.withColumns({"_r": F.row_number().over(w.orderBy("_t", "_v")) - 1, "_n": F.count("*").over(w)}).filter(F.col("_n") >= least)
    keep = int((2 * MOST_PAIRS) ** 0.5)
    step = (F.col("_n") - 1) / F.lit(keep - 1.0)
    near = lambda k: F.bround((F.floor(F.col("_r") / step) + k) * step) == F.col("_r")
    few = F.col("_n") * (F.col("_n") - 1) / 2 <= MOST_PAIRS
    thin = points.filter(few | (F.col("_r") == 0) | (F.col("_r") == F.col("_n") - 1) | near(0) | near(1))
    lists = thin.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", "_r", "_v"))).alias("_p"))
    later = lambda i: F.slice("_p", i + 2, F.size("_p"))
    slopes = F.flatten(F.transform("_p", lambda a, i: F.transform(F.filter(later(i), lambda b: b["_t"] > a["_t"]), lambda b: (b["_v"] - a["_v"]) / (b["_t"] - a["_t"]))))
    ordered = lists.select(*keys, F.size("_p").cast("long").alias("n_points"), F.array_sort(slopes).alias("_s"))
    n = F.size("_s")
    middle = (F.get("_s", ((n - 1) / 2).cast("int")) + F.get("_s", (n / 2).cast("int"))) / 2
    return ordered.select(*keys, F.when(n > 0, middle).otherwise(F.lit(0.0)).alias("slope"), "n_points")


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "ewma") -> DataFrame:
    """The exponentially weighted mean of a key's values in order, which starts at the first; nulls are left out.

    As a sum: the k-th value from the end weighs alpha (1 - alpha)^(k - 1), the first one (1 - alpha)^(n - 1).
    """
    w = Window.partitionBy(*keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, *order, value)
    rows = rows.withColumns({"_k": F.row_number().over(w.orderBy(*[F.desc(c) for c in order])), "_n": F.count("*").over(w)})
    weight = F.pow(F.lit(1 - alpha), F.col("_k") - 1) * F.when(F.col("_k") == F.col("_n"), F.lit(1.0)).otherwise(F.lit(alpha))
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * weight).alias(out))


def id_chunks(df: DataFrame, keys: list[str], member: str, size: int = 1000) -> DataFrame:
    """keys, chunk, ids: the members of a key in order, ``size`` a row, so that no row grows with the key."""
    w = Window.partitionBy(*keys).orderBy(member)
    rows = df.select(*keys, member).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(member)).alias("ids"))


def pooled_ratio(num: Column, den: Column) -> Column:
    """Sum over sum; undefined (null) on an empty denominator."""
    return F.sum(num) / F.nullif(F.sum(den), F.lit(0))
