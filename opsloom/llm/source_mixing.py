"""Mixing sources to target weights with hash-threshold histograms.

Each document has a size (its words) and a 60-bit hash of its id. A source's
budget becomes a hash threshold: documents under it are taken. The threshold
is found by summing sizes by (source, 12-bit hash bucket), walking to the
bucket in which the budget ends, and refining only that bucket by the next 12
bits. Nothing is sorted; each step is one partial aggregation over the small
(source, size, hash) table and leaves at most 4,096 sums a source.

Defined results:
- null text has size 0 and is never taken; null source is a source of its own, last in order;
- a null id hashes as the empty string; repeated rows share a hash, so they are taken or left together;
- an empty table gives an empty result; a source without words has target 0;
- extra columns of the input are kept by ``mix_rows``; the ones it needs win over clashing names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.llm import text as T
from opsloom.llm.workspace import Workspace

HASH_DIGITS = 15  # hexadecimal: 60 bits
DIGITS_A_LEVEL = 3
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2


def id_hash(doc_id: Column) -> Column:
    """15 hexadecimal digits; they order as the 60-bit number."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_DIGITS)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: a row for each source.

    Weights repeat over the sources in code-point order, null last. Targets
    share ``share`` times all words by weight; what exceeds ``most`` times a
    source's size is reshared. Sorted by size/weight, the capped sources come
    first, so the fixed point is found with running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on, so windows without keys stay small.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "budget": F.sum("source_size").over(whole) * F.lit(share),
        "all_weight": F.sum("weight").over(whole),
        "cap_before": F.coalesce(F.sum("cap").over(fill), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(fill), F.lit(0.0)),
    })
    # A source is capped if its level, were it the first uncapped one, exceeds its cap.
    level = (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("capped", level * F.col("weight") >= F.col("cap"))
    per = per.withColumns({
        "capped_sum": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0)),
        "free_weight": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole), F.lit(0.0)),
    })
    free = (F.col("budget") - F.col("capped_sum")) * F.col("weight") / F.col("free_weight")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(free).alias("target"))


def hash_thresholds(space: Workspace, sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: rows with ``hash < threshold`` sum to the budget at most.

    ``budgets`` has (source, budget). The threshold is a hash prefix padded
    with zeros, or null where the whole source fits.
    """
    state = budgets.select("source", F.lit("").alias("prefix"), F.col("budget").alias("left"), F.lit(False).alias("done"))
    for level in range(HASH_DIGITS // DIGITS_A_LEVEL):
        state = space.save(state, f"level{level}")
        if state.filter(~F.col("done")).isEmpty():
            break
        width = level * DIGITS_A_LEVEL
        active = state.filter(~F.col("done"))
        rows = sizes.alias("s").join(
            active.select(F.col("source").alias("a_source"), "prefix", "left").alias("a"),
            F.col("s.source").eqNullSafe(F.col("a_source")) & F.col("s.hash").startswith(F.col("prefix")),
        )
        sums = rows.groupBy(F.col("a_source").alias("source"), "prefix", "left", F.substring("hash", width + 1, DIGITS_A_LEVEL).alias("digit")).agg(F.sum("size").alias("sum"))
        upto = Window.partitionBy("source").orderBy("digit")  # at most 4,096 rows a source
        walked = sums.withColumn("run", F.sum("sum").over(upto)).filter(F.col("run") > F.col("left"))
        edge = walked.groupBy("source", "prefix").agg(F.min_by(F.struct("digit", F.col("left") - F.col("run") + F.col("sum")), "digit").alias("e"))
        found = edge.select("source", F.concat("prefix", "e.digit").alias("prefix"), F.col("e.col2").alias("left"), F.lit(False).alias("done"))
        # A source that has no such bucket fits as a whole; this happens at the first level only.
        fits = active.alias("x").join(found.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")), "left_anti")
        state = found.unionByName(fits.withColumns({"prefix": F.lit(None).cast("string"), "done": F.lit(True)})).unionByName(state.filter("done"))
    # Rows of the last boundary prefix (one hash) exceed the budget and stay out.
    return space.save(state.select("source", F.rpad("prefix", HASH_DIGITS, "0").alias("threshold")), "thresholds")


def source_plan(space: Workspace, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """t_source, source_size, target, rounds, threshold: a row a source, from (source, size, hash)."""
    targets = space.save(source_targets(sizes, weights, share, most), "targets")
    # Whole rounds are taken by all; the rest is the budget of the threshold.
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("rounds", rounds.cast("long"))
    budgets = targets.select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"))
    cut = hash_thresholds(space, sizes, budgets)
    plan = targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    # Written, its true size is known, and Spark sends it to the rows instead of shuffling them.
    return space.save(plan.select(F.col("t.source").alias("t_source"), "source_size", "target", "rounds", "threshold").coalesce(1), "plan")


def with_copies(rows: DataFrame, plan: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """``rows`` (source, hash, ...) with the plan's columns and ``copies``, how often the mix takes the row."""
    under = F.col("threshold").isNull() | (F.col("hash") < F.col("threshold"))
    copies = F.least(F.col("rounds") + F.when(under, F.lit(1)).otherwise(F.lit(0)), F.lit(most))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("copies", copies.cast("int"))


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    size = F.size(T.words(F.col(text))).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), id_hash(F.col(doc_id)).alias("hash"))


def mix_plan(docs: DataFrame, name: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of ``docs``."""
    space = Workspace(docs.sparkSession, name)
    sizes = space.save(_sizes(docs, doc_id, text, source), "sizes")
    out = with_copies(sizes, source_plan(space, sizes, **options))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, name: str = "mix", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; texts without words are left out.

    Whole rows meet only the small table of sources, so they are not shuffled.
    """
    space = Workspace(docs.sparkSession, name)
    sizes = space.save(_sizes(docs, "doc_id", "text", "source"), "sizes")
    plan = source_plan(space, sizes, **options)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source", id_hash(F.col("doc_id")).alias("hash")).filter(F.col("_row.text").rlike(r"[^\x20\x09-\x0D]"))
    taken = with_copies(rows, plan).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs, "op8").select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_source_mixing": op8_source_mixing}

ORACLE = {
    "op8_source_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
  FROM documents),
per AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY source),
fill(step, source, source_size, w, capped, go) AS (
  SELECT 0, source, source_size, w, false, true FROM per
  UNION ALL
  SELECT step + 1, source, source_size, w, now_capped, changed > 0
  FROM (SELECT *, sum(CASE WHEN now_capped <> capped THEN 1 ELSE 0 END) OVER () AS changed
        FROM (SELECT *, capped OR (sum(source_size) OVER () * 1.5::DOUBLE
                - coalesce(sum(CASE WHEN capped THEN (2 * source_size)::DOUBLE END) OVER (), 0))
                / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * w >= (2 * source_size)::DOUBLE AS now_capped
              FROM fill WHERE go)) ),
last AS (SELECT * FROM fill WHERE step = (SELECT max(step) FROM fill)),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (2 * source_size)::DOUBLE
              ELSE (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(CASE WHEN capped THEN (2 * source_size)::DOUBLE END) OVER (), 0)) * w
                   / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target
  FROM last),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS rounds,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * least(2, rounds + CASE WHEN run <= target - rounds * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked"""
}
