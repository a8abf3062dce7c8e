"""Scalar column functions: time, robust statistics, text of labels, identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA_OF_MAD = 1.4826022185056018


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def trunc(unit: str, ts: Column | str) -> Column:
    """``date_trunc`` that stays a timestamp without zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den; null unless den > 0."""
    return F.when(den > 0, num / den)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-9) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within [lo, hi]; an unknown x stays unknown."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, six digits, not below zero; 1 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.greatest(F.round(1 - dot(a, b) / size, 6), F.lit(0.0)))


def l2_normalize(a: Column | str) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x.cast("double") / size))


def canonical_labels(labels: Column) -> Column:
    """``k=v`` pairs of a map, sorted, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def stable_id(prefix: str, *parts: Column) -> Column:
    """A deterministic identifier; the prefix is followed by a dash of its own."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def robust_z(value: Column, center: Column, sigma: Column, floor: float = 0.0, relative: float = 0.05) -> Column:
    """(value - center) / max(sigma, floor, relative * |center|); 0 or +-infinity where that scale is 0."""
    scale = F.greatest(sigma, F.lit(floor), F.abs(center) * relative)
    diff = value - center
    inf = F.when(diff > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(scale > 0, diff / scale).when(diff == 0, F.lit(0.0)).otherwise(inf)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from_exponent(text: Column) -> Column:
    """Digits and exponent of a text such as 1.25e-7, laid out anew."""

    def parsed(t: Column) -> Column:
        parts = F.split(t, "e")
        whole, part = F.split_part(F.get(parts, F.lit(0)), F.lit("."), F.lit(1)), F.split_part(F.get(parts, F.lit(0)), F.lit("."), F.lit(2))
        return F.struct(F.regexp_replace(F.concat(whole, part), "0+$", "").alias("digits"), F.get(parts, F.lit(1)).cast("int").alias("exponent"))

    def laid_out(x: Column) -> Column:
        digits, exponent = x["digits"], x["exponent"]
        count, size = F.length(digits), F.abs(exponent).cast("string")
        plain = F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)).when(count <= exponent + 1, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(F.concat(F.left(digits, exponent + 1), F.lit("."), F.substring(digits, exponent + 2, count)))
        fraction = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(F.lit(""))
        short = F.concat(F.left(digits, F.lit(1)), fraction, F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
        return F.when((exponent < -4) | (exponent >= 21), short).otherwise(plain)

    return let(let(text, parsed), laid_out)


def short_number(value: Column) -> Column:
    """A double as the shortest decimal text: plain from 1e-4 to below 1e21, else with an exponent of two digits at least (+Inf, -Inf, NaN)."""
    text = F.lower(F.abs(value).cast("string"))
    number = F.when(value == 0, F.lit("0")).when(F.contains(text, F.lit("e")), _from_exponent(text)).otherwise(F.regexp_replace(text, "[.]0$", ""))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(value), F.lit("NaN")).when(value == float("inf"), F.lit("+Inf")).when(value == float("-inf"), F.lit("-Inf")).otherwise(F.concat(sign, number))


def order_bucket(value: Column, per_octave: int = 256) -> Column:
    """A whole number that never falls as the value rises: ``per_octave`` steps for each doubling, on both sides of zero."""
    v = value.cast("double")
    step = F.floor(F.log2(F.abs(v)) * per_octave) + 1100 * per_octave  # doubles are 2**-1074 and more
    top = F.lit(2200 * per_octave)
    return F.when(v == 0, F.lit(0).cast("long")).when(F.isnan(v) | (v == float("inf")), top.cast("long")).when(v == float("-inf"), -top.cast("long")).when(v > 0, step).otherwise(-step)


def head_tail(text: Column, limit: int, marker: str = " ... ") -> Column:
    """A text over ``limit`` characters keeps its start and its end."""
    head = (limit - len(marker)) // 2
    tail = limit - len(marker) - head
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail))))
