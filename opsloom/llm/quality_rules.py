"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base statistics are computed once a document and written. Each rule is a ratio
that is high for bad text. On labelled good documents (the holdout), a cutoff
that rejects k of n good documents of a stratum is safe if the exact binomial
bound says so: P(Bin(n, alpha_rule) <= k) <= delta / m, which is the same as an
upper Clopper-Pearson limit of at most alpha_rule at confidence 1 - delta/m.
m counts every (stratum, rule, candidate) that is tried (Bonferroni), and
alpha_rule is alpha shared among the rules, so that with probability 1 - delta
no stratum loses more than alpha of its good documents to the rules. Of the
safe cutoffs the one that rejects most is chosen; without one the rule is off
in that stratum. Candidates are fixed in advance, not read from the holdout.

Defined results: null or empty text has no words and fails the base rules; a
null stratum is the stratum ''; strata without labels reject nothing beyond the
base rules; a repeated document is judged like its twin; labels are joined by
id, and an id labelled several times counts as good only if no label says 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import text as T
from opsloom.llm.workspace import Workspace

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MOST_REPEAT_PERCENT = 20
WINDOW = 5

ALPHA = 0.05  # share of a stratum's good documents that the rules may reject
DELTA = 0.05  # probability that any bound fails
#: rule -> the value's expression over the statistics; all are high for bad text.
RULES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1) / 20.0D",
}
#: The same grid for every rule, lowest (rejects most) first.
CANDIDATES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0)


def _count_of(text: Column, characters: str) -> Column:
    """How often the (one-byte) characters occur."""
    total = F.lit(0)
    for c in characters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total


def _grams(words: Column) -> Column:
    """A hash of every window of five words."""
    n = F.size(words)
    at = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    return F.when(n >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column) -> Column:
    """Words in the windows that start at the (ascending) places."""
    zero = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, zero, step, lambda a: a["n"])


def statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (all long)."""
    t = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    t = t.withColumn("_w", T.words(F.col("_t")))
    # Each array is a column of its own: an array expression inside a lambda would be made anew for every element.
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.withColumns({"_g": _grams(F.col("_w")), "_l": lines, "_c": F.array_join("_w", "")})
    # Most documents have no window twice; only the others sort their windows.
    pairs = F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    unique = F.size(F.array_distinct("_g")) == F.size("_g")
    t = t.withColumn("_p", F.when(~unique, pairs))
    twice = F.filter("_p", lambda x, k: F.get("_p", k - 1)["g"].eqNullSafe(x["g"]) | F.get("_p", k + 1)["g"].eqNullSafe(x["g"]))
    t = t.withColumn("_r", F.array_sort(F.transform(twice, lambda x: x["i"])))
    return t.select(
        *[c for c in t.columns if c[0] != "_"],
        F.size("_w").cast("long").alias("n_words"),
        F.length("_c").cast("long").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_r")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.octet_length(F.regexp_replace("_c", "[^A-Z]", "")).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEAT_PERCENT)


def most_rejections(n: Column, alpha: Column, delta: Column) -> Column:
    """The largest k with P(Bin(n, alpha) <= k) <= delta; -1 if there is none.

    The exact sum of the probabilities, from k = 0 up, by logarithms so that
    long sums do not underflow.
    """
    first = n * F.log1p(-alpha)
    odds = F.log(alpha) - F.log1p(-alpha)
    zero = F.struct(first.alias("l"), F.exp(first).alias("p"), F.when(F.exp(first) <= delta, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        log_p = a["l"] + F.log((n - i + 1).cast("double") / i) + odds
        p = a["p"] + F.exp(log_p)
        return F.struct(log_p.alias("l"), p.alias("p"), F.when(p <= delta, i).otherwise(a["k"]).alias("k"))

    upto = F.ceil(n * alpha).cast("long")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(upto, F.lit(1))), zero, step, lambda a: a["k"])).otherwise(F.lit(-1))


def rule_values() -> Column:
    return F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(e).cast("double").alias("value")) for name, e in RULES.items()])


def choose_cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA, candidates=CANDIDATES) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_rejected, n_allowed from the statistics of labelled good documents.

    ``good`` has ``stratum`` and the statistics of documents that pass the
    base rules. Counts are summed before any shuffle; the table of counts has
    one row for each stratum and rule.
    """
    at = [F.count_if(F.col("v.value") > c).alias(f"r{k}") for k, c in enumerate(candidates)]
    per = good.select("stratum", F.explode(rule_values()).alias("v")).groupBy("stratum", F.col("v.rule").alias("rule")).agg(F.count("*").alias("n_good"), *at)
    tried = good.select("stratum").distinct().agg((F.count("*") * len(RULES) * len(candidates)).alias("tried"))
    per = per.crossJoin(F.broadcast(tried))  # one row
    allowed = most_rejections(F.col("n_good"), F.lit(alpha / len(RULES)), F.lit(delta) / F.col("tried"))
    per = per.withColumn("n_allowed", allowed)
    options = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"r{k}").alias("n_rejected")) for k, c in enumerate(candidates)])
    safe = F.filter(options, lambda o: o["n_rejected"] <= F.col("n_allowed"))
    return per.withColumn("best", F.get(safe, F.lit(0))).filter("best is not null").select("stratum", "rule", "best.cutoff", "n_good", "best.n_rejected", "n_allowed")


def judge(docs: DataFrame, labels: DataFrame, name: str = "rules", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every document with its statistics, base_failed, kept and the rules that reject it."""
    space = Workspace(docs.sparkSession, name)
    keep = [F.col("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")]
    stats = space.save(statistics(docs, *keep).withColumn("base_failed", base_failed()), "statistics")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    good = stats.filter("not base_failed").join(marks, "doc_id", "left_semi")
    cutoffs = space.save(choose_cutoffs(good, alpha, delta), "cutoffs")
    # A row a stratum with its cutoffs as a map; as many rows as strata.
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    joined = stats.join(by_stratum, "stratum", "left")
    broken = F.transform(F.filter(rule_values(), lambda v: v["value"] > F.try_element_at("cutoffs", v["rule"])), lambda v: v["rule"])
    judged = joined.withColumn("broken", F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(broken))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("cutoffs")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(docs, labels, "op5")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}

_RULES_SQL = ", ".join(f"('{name}', {e.replace('20.0D', '20.0::DOUBLE')})" for name, e in RULES.items())
_CUTS_SQL = ", ".join(f"({c}::DOUBLE)" for c in CANDIDATES)
ORACLE = {
    "op5_quality_rules": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(array_to_string(w, ''), '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
good AS (
  SELECT stratum, r.rule, r.value
  FROM (SELECT b.* FROM b JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
       LATERAL (SELECT * FROM (VALUES {_RULES_SQL}) v(rule, value)) r),
per AS (SELECT stratum, rule, count(*) AS n, (SELECT count(DISTINCT stratum) * {len(RULES) * len(CANDIDATES)} FROM good) AS tried FROM good GROUP BY ALL),
sizes AS (SELECT DISTINCT n, tried FROM per),
pmf(n, tried, k, l, p) AS (
  SELECT n, tried, 0::BIGINT, n * ln(1 - {ALPHA / len(RULES)}::DOUBLE), exp(n * ln(1 - {ALPHA / len(RULES)}::DOUBLE)) FROM sizes
  UNION ALL
  SELECT n, tried, k + 1, l + step, p + exp(l + step)
  FROM (SELECT *, ln((n - k)::DOUBLE / (k + 1)) + ln({ALPHA / len(RULES)}::DOUBLE) - ln(1 - {ALPHA / len(RULES)}::DOUBLE) AS step FROM pmf)
  WHERE p <= {DELTA}::DOUBLE / tried AND k < n),
allowed AS (SELECT n, tried, max(k) FILTER (WHERE p <= {DELTA}::DOUBLE / tried) AS k FROM pmf GROUP BY ALL),
tried AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (WHERE value > cutoff) AS rejected, count(*) AS n
  FROM good, (VALUES {_CUTS_SQL}) c(cutoff) GROUP BY ALL),
cut AS (SELECT t.stratum, t.rule, min(cutoff) AS cutoff FROM tried t JOIN allowed a ON a.n = t.n WHERE rejected <= a.k GROUP BY ALL),
broken AS (
  SELECT DISTINCT b.doc_id FROM b, LATERAL (SELECT * FROM (VALUES {_RULES_SQL}) v(rule, value)) r
  JOIN cut ON cut.stratum = b.stratum AND cut.rule = r.rule WHERE r.value > cut.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM b"""
}
