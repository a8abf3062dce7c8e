"""N-gram Jaccard self-join by prefix filters under several global token orders.

Sort two sets by any global order of tokens. All their common tokens that are
not among the first p of either lie behind one of these prefixes, so two sets
with Jaccard similarity of t at least share

    least(n, m) - max(n - p(n), m - p(m)),   p(n) = n - ceil(t n) + 1

tokens of their prefixes, where least(n, m) = ceil(t / (1 + t) (n + m)) is the
overlap that they need. That holds under every order, so a pair that shares too
few prefix tokens under any one order cannot be similar.

Three orders are used: by frequency (rare tokens first; it makes the
candidates) and by two seeded hashes. A table has a row a distinct set with its
prefix under each order; candidates are joined with those rows, and the filters
of all orders are intersected before any text moves. Only pairs that pass under
every order are verified on their texts.

Frequencies come from a sketch of fixed size (``2**SKETCH_BITS`` counters of
tokens that repeat within a task), so the order costs no shuffle of tokens; any
order gives right results, this one keeps common passages out of the prefixes.

Equal sets are one class from the start, found by a 128-bit fingerprint. Within
a token's bucket, members are first tried against the bucket's most central
member (fewest rare tokens), linear in the bucket. Components of those links
are then contracted, and only members of different components of one bucket
are tried with each other. Those joins are by token and size band (sets whose
sizes differ by more than t cannot be similar), which splits the bucket of a
frequent token. Every link between components is thus found; pairs already
joined through others are not expanded.

Defined results: null text and text without words has an empty set and is its
own component; a row without id takes part in its class of equal sets but in no
link (its component is the smallest id of the class, null if there is none);
rows that repeat an id are one document that has the links of each of its
texts, and each row keeps its own ``n_shingles``; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import text as T
from opsloom.llm.components import connected
from opsloom.llm.filters import that_may_meet
from opsloom.llm.workspace import Workspace

SKETCH_BITS = 18
FLUSH = 4_000_000  # tokens a task counts at a time
ORDER_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)  # the orders after the first


def token_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, buf, offsets in T.blocks(texts):
        start, end, first = T.word_spans(buf, offsets)
        word = T.span_hashes(T.prefix_hashes(buf, T.LOWER_CODE), start, end)
        gram = T.ngram_hashes(word, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(gram[a : b - size + 1])
            elif b > a:
                yield T.ngram_hashes(word[a:b], b - a)
            else:
                yield gram[:0]


def least_overlap(n, percent: int):
    """ceil(n * percent / 100)"""
    return F.floor((n * percent + 99) / 100) if isinstance(n, Column) else (n * percent + 99) // 100


def prefix_size(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, n_held = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def flush() -> None:
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                many = c > 1
                np.add.at(sketch, (h[many] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), c[many])
                held.clear()

        def batch(kind, ids, n, f1, f2):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], names=["kind", "doc_id", "n", "f1", "f2"])

        for b in batches:
            n, f1, f2 = [], [], []
            for s in token_sets(b.column("text"), size):
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(T.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).astype(np.int64)))
                held.append(s)
                n_held += len(s)
                if n_held > FLUSH:
                    flush()
                    n_held = 0
            yield batch(0, b.column("doc_id"), n, f1, f2)
        flush()
        hot = np.flatnonzero(sketch)
        for at in range(0, len(hot), 10_000):
            k = hot[at : at + 10_000]
            yield batch(1, pa.nulls(len(k), pa.int64()), k, sketch[k], np.zeros(len(k), np.int64))

    return run


PREFIXES = "rep long, n long, cold long, tokens array<long>, order1 array<int>, order2 array<int>"


def _low_bits(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token; tokens that agree in them by chance only let a pair pass that the texts then reject."""
    return np.unique((tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)


def _prefixes(size: int, percent: int, sent):
    """A row a document with a word: its prefix under the order by frequency, in order, and under the hash orders."""

    def listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        edge = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(parts), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        for b in batches:
            ids, sizes, cold, tokens, others = [], [], [], [], [[] for _ in ORDER_SEEDS]
            for doc_id, s in zip(b.column("doc_id").to_pylist(), token_sets(b.column("text"), size), strict=True):
                n = len(s)
                if not n:
                    continue
                count = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = prefix_size(n, percent)
                # s is sorted, so a stable sort by count orders by (count, hash).
                tokens.append(s[np.argsort(count, kind="stable")[:p]].view(np.int64))
                for seed, out in zip(ORDER_SEEDS, others, strict=True):
                    mixed = T.mix(s ^ np.uint64(seed))
                    out.append(_low_bits(s[np.argpartition(mixed, p - 1)[:p]]))
                ids.append(doc_id)
                sizes.append(n)
                cold.append(int((count == 0).sum()))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cold, pa.int64()), listed(tokens, pa.int64()), *(listed(x, pa.int32()) for x in others)],
                    names=["rep", "n", "cold", "tokens", "order1", "order2"],
                )

    return run


def passing(pairs: DataFrame, prefixes: DataFrame, percent: int, orders: list[str]) -> DataFrame:
    """Those of the pairs (a, b) that share enough prefix tokens under every one of the orders."""
    side = lambda c: prefixes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(o).alias(f"{o}_{c}") for o in orders])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    rest = F.greatest(least_overlap(F.col("n_a"), percent), least_overlap(F.col("n_b"), percent)) - 1
    need = F.floor(((F.col("n_a") + F.col("n_b")) * percent + 99 + percent) / (100 + percent)) - rest
    for o in orders:
        # Tokens cut to 32 bits may coincide within a set: what that can hide is the cut set's loss of size.
        lost = F.lit(0) if o == "tokens" else F.greatest(*[F.col(f"n_{c}") - least_overlap(F.col(f"n_{c}"), percent) + 1 - F.size(f"{o}_{c}") for c in "ab"])
        both = both.filter(F.size(F.array_intersect(f"{o}_a", f"{o}_b")) + lost >= F.greatest(need, F.lit(1)))
    return both.select("a", "b")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (n + m - both)


def _verifier(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            a_ids, a_texts = batch.column("a").to_pylist(), batch.column("text_a")
            for i, right in enumerate(token_sets(batch.column("text_b"), size)):
                if a_ids[i] != last or left is None:
                    last, left = a_ids[i], next(token_sets(a_texts.slice(i, 1), size))
                if _linked(left, right, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links. Rows come sorted by ``a`` from the join, so its set is made once."""
    texts = that_may_meet(docs.select("doc_id", "text"), F.xxhash64("doc_id"), _ids(pairs), F.xxhash64("id"))
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(size, percent), "a long, b long")


def _close(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Can two sets of n and m tokens be similar, whose first common token stands at i and j?

    All common tokens stand there or later, and there must be
    percent / (100 + percent) * (n + m) of them at least. A pair is met at each
    of its common tokens, so it is enough that its first one lets it through.
    """
    return F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one bucket that are in different components and near enough in size and place."""
    band = F.floor(F.log("n") / (max(math.log(100 / percent), 1e-9) * (1 + 1e-9)))  # a little wider than the ratio, against rounding
    rows = members.withColumn("band", band)
    # The smaller set of a similar pair is in the larger one's band or in the band below.
    x, y = rows.alias("x"), rows.withColumn("at", F.explode(F.array(F.col("band"), F.col("band") - 1))).alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.at")) & (F.col("x.comp") != F.col("y.comp")) & smaller
    near = _close(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), percent)
    return x.join(y, met & near).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, name: str = "jaccard", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    space = Workspace(spark, name)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    both = space.save(docs.mapInArrow(_signatures(size), "kind int, doc_id long, n long, f1 long, f2 long"), "signatures")
    # At most 2**SKETCH_BITS rows, whatever the input.
    counts = both.filter("kind = 1").groupBy("n").agg(F.sum("f1").alias("c")).toPandas()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[counts["n"].to_numpy(np.int64)] = counts["c"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(sketch)

    # A class of equal sets is named after its smallest id.
    sets = both.filter("kind = 0").drop("kind")
    classes = space.save(sets.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    c = classes.alias("c")
    same = (F.col("s.f1") == F.col("c.f1")) & (F.col("s.f2") == F.col("c.f2")) & (F.col("s.n") == F.col("c.n"))
    named = sets.alias("s").join(c, same, "left").select("s.doc_id", "s.n", "rep")
    # An id with several texts links the classes of all of them.
    several = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("doc_id is not null and a <> z").select("doc_id", "a")
    of_one_id = space.save(named.join(several, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")), "ids")

    reps = classes.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    # Prefixes are a third of their texts, so they are made before the copies of a class are left out.
    every = docs.filter("doc_id is not null").mapInArrow(_prefixes(size, percent, sent), PREFIXES)
    prefixes = space.save(every.join(reps.withColumnRenamed("doc_id", "rep"), "rep", "left_semi"), "prefixes")
    prefix = prefixes.select("rep", "n", "cold", F.posexplode("tokens").alias("place", "token"))
    member = F.struct("cold", "rep", "n", "place")
    buckets = prefix.groupBy("token").agg(F.count("*").alias("c"), F.min(member).alias("lead"), F.max(member).alias("last")).filter("c > 1 and lead.rep <> last.rep")
    buckets = space.save(buckets, "buckets")

    large = buckets.filter("c > 2")
    members = space.save(prefix.join(large.select("token", "lead"), "token").select("token", "rep", "n", "place", "lead"), "members")
    two = buckets.filter("c = 2").select(F.col("lead.rep").alias("a"), F.col("last.rep").alias("b"), F.col("lead.n").alias("na"), F.col("lead.place").alias("ia"), F.col("last.n").alias("nb"), F.col("last.place").alias("ib"))
    star = members.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), F.col("lead.n").alias("na"), F.col("lead.place").alias("ia"), F.col("n").alias("nb"), F.col("place").alias("ib"))
    pairs = two.union(star).filter((F.col("a") != F.col("b")) & _close(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"), percent)).select("a", "b").distinct()
    tried = space.save(pairs, "tried")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        near = that_may_meet(prefixes, F.xxhash64("rep"), _ids(pairs), F.xxhash64("id"))
        passed = space.save(passing(pairs, near, percent, ["tokens"]), f"{name}-order0")
        passed = space.save(passing(passed, near, percent, ["order1", "order2"]), f"{name}-orders")
        return space.save(_verified(passed, docs, size, percent), name)

    links = links_of(tried, "links").union(of_one_id)
    found = connected(space, links, "first")
    comp = members.join(found, members.rep == found.id, "left").select("token", "rep", "n", "place", F.coalesce("component", "rep").alias("comp"))
    comp = space.save(comp, "labelled")
    mixed = space.save(comp.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token"), "mixed")
    rest = space.save(comp.join(mixed, "token"), "rest")
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = space.save(_candidates(rest, percent).join(known, ["a", "b"], "left_anti"), "more")
    final = connected(space, links.union(links_of(more, "links2")), "final")
    space.drop("members", "labelled", "mixed", "rest", "buckets", "tried", "more", "prefixes", "links-order0", "links-orders", "links2-order0", "links2-orders")

    out = named.join(final, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, name: str = "near") -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component; of rows that repeat an id one stays, rows without id stay."""
    found = jaccard_components(docs, size, percent, name)
    stay = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, "op9")


QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLE = {
    "op9_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.doc_id = d.doc_id"""
}
