"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case, without punctuation. A seed is three words of
an item: a run, or two words, any word and one more, so that an item in which
every third word was changed still has one. Of the seeds of either shape the
most frequent quarter of an item's is left out, as counted over the whole
corpus, so that a common phrase makes no candidates. Where a document holds a
seed, the item is aligned with the words around it; the local score (match 2,
mismatch -1, gap -1) over twice the item's words is 1 for a full copy and falls
with edits. Pairs with ``THRESHOLD`` and more are reported.

Seeds are a table (``gram``, item, place) and hits are a table (``gram``,
document, place); the two are joined. What a document can hit at all is told by
a filter of fixed size, whatever the benchmark's size, which is
all that is sent to the tasks; a larger benchmark fills it and lets more rows
into the join. Hits of one document and item are grouped, and the documents
that have any are joined with their candidates and aligned. Documents without
a candidate do not move: a second such filter is held against their versions.

An alignment of the least score spans at most ``2 / threshold`` times the item's words,
so text between hits is cut into overlapping windows of twice that; a window
needs memory in proportion to its words, not to words times item.

Defined results: null or empty texts and items match nothing; an item with
three words or fewer is its own seed; an item repeated under one id counts
once for each text, the best score is kept; repeated documents are each
reported; a row without id is reported with a null id; of equal scores the
first place in the text is reported; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.llm import text as T
from opsloom.llm.filters import bit_filter, known_slots, slots, that_may_meet
from opsloom.llm.workspace import Workspace

GRAM = 3
COMMON_SHARE = 0.25  # the most frequent part of an item's seeds of a shape, never used
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1


def text_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, first word of each text) for runs of texts; texts are in lower case already."""
    for _, buf, offsets in T.blocks(texts):
        start, end, first = T.word_spans(buf, offsets, T.IS_MARK)
        yield T.span_hashes(T.prefix_hashes(buf), start, end), first


SHAPES = ((0, 1, 2), (0, 1, 3))  # places of a seed's words: a run, and a run with a changed word in it


def shape_hashes(words: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A hash for each place at which the words of a shape can stand."""
    k = len(words) - shape[-1]
    if k <= 0:
        return words[:0]
    total = np.full(k, np.uint64(sum(1 << i for i in shape)))
    for i in shape:
        total = T.mix(total ^ words[i : i + k])
    return total


def shapes_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The shapes of an item of n words: a short item is one run."""
    return SHAPES if n > SHAPES[-1][-1] else (tuple(range(min(n, GRAM))),)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [w[first[k] : first[k + 1]] for w, first in text_words(b.column("text")) for k in range(len(first) - 1)]
        keep = [k for k, w in enumerate(rows) if len(w)]
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(at), b.column("item").take(at), pa.array([rows[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], names=["item_id", "item", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for item, words in zip(b.column("item").to_pylist(), b.column("words"), strict=True):
            w = words.values.to_numpy().view(np.uint64)
            for k, shape in enumerate(shapes_of(len(w))):
                out += [(int(g), item, k, q, len(shape)) for q, g in enumerate(shape_hashes(w, shape).view(np.int64))]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["gram", "item", "shape", "q", "size"])


def _hits(sent, sizes: list[int]):
    """A row a place of a document at which a seed may stand; ``sizes`` has the lengths of short items."""
    shapes = [*SHAPES, *(tuple(range(n)) for n in sizes if n < GRAM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_slots(sent)
        for b in batches:
            base = 0
            for words, first in text_words(b.column("text")):
                for shape in shapes:
                    h = shape_hashes(words, shape)
                    at = np.flatnonzero(known[slots(h)])
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + shape[-1] < first[np.minimum(doc + 1, len(first) - 1)]
                    at, doc = at[inside], doc[inside]
                    row = pa.array(base + doc)
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), b.column("doc_id").take(row), b.column("version").take(row), pa.array((at - first[doc]).astype(np.int32))], names=["gram", "doc_id", "version", "p"])
                base += len(first) - 1

    return run


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best score, first and end place of the aligned words); memory of a row.

    A cell holds its score above 32 bits with where its alignment began, so that
    one maximum carries both; of equal scores the later beginning is kept, and
    of equal best scores the first end.
    """
    n = len(words)
    unit = np.int64(1) << np.int64(32)
    fresh = np.arange(n + 1, dtype=np.int64)  # score 0, beginning here
    ramp = np.arange(1, n + 1, dtype=np.int64) * (-GAP * unit)
    row, best = fresh.copy(), (0, 0, 0)
    for w in item:
        step = row[:-1] + np.where(words == w, MATCH, MISMATCH) * unit
        cell = np.maximum(np.maximum(step, row[1:] + GAP * unit), fresh[1:])
        cell = np.maximum.accumulate(cell + ramp) - ramp
        cell = np.where(cell >= unit, cell, fresh[1:])
        row = np.concatenate([fresh[:1], cell])
        top = int((row >> 32).max())
        if top > best[0]:
            j = int((row >> 32).argmax())
            best = (top, int(row[j] & (unit - 1)), j)
    return best


def windows(diagonals: list[int], size: int, n: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Parts [start, end) of a text of n words in which an alignment through one of the seeds' diagonals can lie.

    A seed's place less its place in the item is its diagonal. An alignment of
    the least score has threshold * 2 * size points left after its gaps, so at
    most 2 * size of them, and spans 3 * size words at most.
    """
    span = 3 * size
    at, last = 0, -1
    diagonals = sorted(set(diagonals))
    while at < len(diagonals):
        end = at
        while end + 1 < len(diagonals) and diagonals[end + 1] - diagonals[end] <= 2 * span:
            end += 1
        lo, hi = max(0, diagonals[at] - span), min(n, diagonals[end] + size + span)
        at = end + 1
        for start in range(lo, hi, span):
            last = min(hi, start + 2 * span)
            yield start, last
            if last == hi:
                break


def matches(words: np.ndarray, hits: list[tuple[int, int]], item: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """The best alignment of an item near its seeds (place in the text, place in the item), or none of ``threshold``."""
    size = len(item)
    need = threshold * MATCH * size
    best = None
    for a, z in windows([p - q for p, q in hits], size, len(words), threshold):
        part = words[a:z]
        # Even if every word of the item that is here at all matched in order, would it be enough?
        if MATCH * np.isin(item, part).sum() < need:
            continue
        score, s, e = align(item, part)
        if score >= need and (best is None or score / (MATCH * size) > best[0]):
            best = (score / (MATCH * size), a + s, a + e)
    return best


PAIR = "doc_id long, version long, item_id long, score double, first_word long, end_word long"


def _aligned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, base = [], 0
            for words, first in text_words(b.column("text")):
                for d in range(len(first) - 1):
                    for c in b.column("candidates")[base + d].as_py():
                        item = np.array(c["words"], np.int64).view(np.uint64)
                        got = matches(words[first[d] : first[d + 1]], [(x["p"], x["q"]) for x in c["hits"]], item, threshold)
                        if got:
                            out.append((b.column("doc_id")[base + d].as_py(), b.column("version")[base + d].as_py(), c["item_id"], *got))
                base += len(first) - 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "version", "item_id", "score", "first_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", name: str = "decontamination") -> DataFrame:
    """doc_id, version, item_id, score, first_word, end_word: where documents hold benchmark items.

    Places count the document's words; version is a hash of its text, which
    tells rows with one id, or without one, apart.
    """
    spark = docs.sparkSession
    space, send = Workspace(spark, name), spark.sparkContext.broadcast
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.lower(F.col(text)).alias("text")).filter("text is not null")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).filter("text is not null").distinct()
    bench = bench.withColumn("item", F.xxhash64("item_id", "text"))
    items = space.save(bench.mapInArrow(_item_words, "item_id long, item long, words array<long>"), "items")
    grams = space.save(items.mapInArrow(_item_seeds, "gram long, item long, shape int, q int, size int"), "grams")

    short = [r["size"] for r in grams.filter(F.col("size") < GRAM).select("size").distinct().collect()]  # 1 and 2 at most
    hits = space.save(docs.mapInArrow(_hits(send(bit_filter(grams, F.col("gram"))), short), "gram long, doc_id long, version long, p int"), "hits")
    per = Window.partitionBy("item", "shape")
    ranked = grams.select("gram", "item", "shape").distinct().join(hits.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    ranked = ranked.withColumns({"rank": F.row_number().over(per.orderBy(F.coalesce("n", F.lit(0)), "gram")), "of": F.count("*").over(per)})
    rare = ranked.filter(F.col("rank") <= F.col("of") - F.floor(F.col("of") * COMMON_SHARE)).select("gram", "item", "shape")
    seeds = space.save(grams.join(rare, ["gram", "item", "shape"]).select("gram", "item", "q"), "seeds")

    met = hits.join(seeds, "gram").groupBy("doc_id", "version", "item").agg(F.collect_set(F.struct("p", "q")).alias("hits"))
    candidate = F.struct("item_id", "words", "hits")
    candidates = space.save(met.join(items, "item").groupBy("doc_id", "version").agg(F.collect_list(candidate).alias("candidates")), "candidates")
    near = that_may_meet(docs, F.col("version"), candidates, F.col("version"))
    both = near.join(candidates, near.doc_id.eqNullSafe(candidates.doc_id) & (near.version == candidates.version))
    return both.select(near.doc_id, near.version, "text", "candidates").mapInArrow(_aligned(threshold), PAIR)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = contaminated(docs, benchmark, threshold).select("doc_id", "version").distinct()
    # Written, its true size is known: Spark sends it to the documents if it is small and shuffles both if it is not.
    bad = Workspace(docs.sparkSession, "contaminated").save(bad, "rows")
    # The row is one column here, so that none of its columns can clash with those of the join.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(bad, F.col("id").eqNullSafe(bad.doc_id) & (F.col("hash") == bad.version), "left_anti").select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("version")


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE: dict[str, str] = {}
