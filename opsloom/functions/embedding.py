"""A hashed text embedding: weighted families of n-grams, signed buckets, unit length; all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.operators.logs import char_ngrams, shingles

DIM = 96
WEIGHTS = {"token": 0.6, "char": 0.34, "shape": 0.06}  # fixed values


def features(tokens: Column) -> Column:
    """``family:feature`` of a signature: token 1- and 2-grams, character 3- to 5-grams of every token, length buckets."""
    of_size = lambda n: F.flatten(F.transform(tokens, lambda t: char_ngrams(t, n)))
    grams = F.concat(*[of_size(n) for n in (3, 4, 5)])
    marks = F.size(F.filter(tokens, lambda t: t.startswith("<")))
    shape = F.when(F.size(tokens) > 0, F.array(F.concat(F.lit("len"), F.least(F.size(tokens), F.lit(32)).cast("string")), F.concat(F.lit("marks"), marks.cast("string")))).otherwise(F.array().cast("array<string>"))
    named = lambda family, parts: F.transform(parts, lambda x: F.concat(F.lit(f"{family}:"), x))
    return F.concat(named("token", F.concat(tokens, shingles(tokens, 2))), named("char", grams), named("shape", shape))


def slot_weights(df: DataFrame, signature: str, dim: int = DIM) -> DataFrame:
    """signature, slot, value of the unit vectors of the distinct signatures; slots that stay 0 have no row.

    A feature weighs 1 + ln(count); its slot and sign come from its MD5. Each
    family is brought to unit length, then weighted, then the sum is.
    """
    tokens = F.filter(F.split(F.coalesce(signature, F.lit("")), " "), lambda t: t != "")
    counted = df.select(signature).distinct().select(signature, F.explode(features(tokens)).alias("_f")).groupBy(signature, "_f").agg((1 + F.log(F.count("*").cast("double"))).alias("_v"))
    digest = F.md5("_f")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") >= 8, F.lit(1.0)).otherwise(F.lit(-1.0))
    slots = counted.select(signature, F.split_part("_f", F.lit(":"), F.lit(1)).alias("_family"), (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int").alias("slot"), (sign * F.col("_v")).alias("_v"))
    slots = slots.groupBy(signature, "_family", "slot").agg(F.sum("_v").alias("_v"))
    norm = lambda *keys: F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(*keys)))  # noqa: E731  (dim slots a family at most)
    share = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    mixed = slots.withColumn("_n", norm(signature, "_family")).filter("_n > 0").groupBy(signature, "slot").agg(F.sum(F.element_at(share, F.col("_family")) * F.col("_v") / F.col("_n")).alias("_v"))
    return mixed.withColumn("_n", norm(signature)).filter("_n > 0").select(signature, "slot", (F.col("_v") / F.col("_n")).alias("value"))


def embed_signatures(df: DataFrame, signature: str, out: str = "vector", dim: int = DIM) -> DataFrame:
    """Embeds distinct signatures once and joins them back; an empty one has the zero vector."""
    pairs = slot_weights(df, signature, dim).groupBy(F.col(signature).alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_m"))
    joined = df.join(pairs, F.col(signature).eqNullSafe(F.col("_s")), "left").drop("_s")
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return joined.withColumn(out, vector).drop("_m")
