"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash marks triggers: for every start of a 400-byte string the trigger
is the leftmost smallest hash among its first 200 places. Triggers depend on
content alone, so equal strings have their trigger at the same offset, and they
cut a text into phrases: the runs of starts with one trigger. The parse has a
row a phrase occurrence (about one for 100 bytes); the dictionary has a row a
distinct phrase with the text that follows it as far as its strings reach.

As with the suffix arrays of dictionary and parse, a string is found by its
phrase first and then by its place in the phrase and what follows:
- a phrase whose core (the 201 bytes that all its strings share) occurs once
  has no repeated string;
- a phrase that occurs with the same context twice has only repeated strings;
- what is left are the edges of repeated passages. For these the single strings
  are compared, a dictionary phrase standing for all its occurrences.
Only equality of the first 400 bytes of suffixes matters here, so classes of
equal suffixes take the place of their sorted order, and every step is a
grouping with partial aggregation instead of a global sort.

Phrases, classes and edge strings are compared by 128 bits of hashes. Texts
move twice, by document, for the edge strings and for the removal.

Defined results: null text is empty; a text shorter than the limit keeps all
bytes; rows that repeat id and text are copies of each other; rows that repeat
only the id are judged each on its own text; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import text as T
from opsloom.llm.filters import that_may_meet, with_may_meet
from opsloom.llm.workspace import Workspace

GRAM = {"bytes": 16, "words": 3}  # units under the rolling hash
PASSAGE_WORDS = 51  # "over 50 words"
BLOCK = 1 << 20


def sequences(texts: pa.Array, unit: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, prefix hashes, n + 1 offsets of the texts) of runs of texts, seen as bytes or as words."""
    for at, buf, offsets in T.blocks(texts, BLOCK):
        prefix = T.prefix_hashes(buf)
        if unit == "words":
            start, end, offsets = T.word_spans(buf, offsets)
            prefix = T.prefix_of(T.span_hashes(prefix, start, end))
        yield at, prefix, offsets


@dataclass
class Phrases:
    """Runs [low, high] of string starts that share a trigger; places are within the block of texts."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    trigger: np.ndarray


def sliding_min(v: np.ndarray, k: int) -> np.ndarray:
    """Minimum of v[i : i + k] for every i up to len(v) - k."""
    n = len(v) - k + 1
    pad = -len(v) % k
    grid = np.append(v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)).reshape(-1, k)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[k - 1 : k - 1 + n])


def parse(prefix: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM["bytes"]) -> Phrases:
    """The phrases of a block of texts, from the prefix hashes of its units."""
    none = np.zeros(0, np.int64)
    n, reach = len(prefix) - 1, length // 2
    if n < length:
        return Phrases(none, none, none, none)
    at = np.arange(n - gram + 1)
    # 32 bits of hash, then the place: the minimum is the leftmost smallest hash.
    key = (T.span_hashes(prefix, at, at + gram) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    trigger = (sliding_min(key, reach)[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(len(trigger)), "right") - 1
    valid = np.arange(len(trigger)) + length <= offsets[doc + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return Phrases(none, none, none, none)
    d, t = doc[start], trigger[start]
    new = np.ones(len(start), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return Phrases(d[first], start[first], start[last], t[first])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _second(h: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Joins a span's hash with that of its first half: spans must agree in both."""
    return T.mix(h ^ T.span_hashes(prefix, start, (start + end) // 2) * np.uint64(0x9FB21C651E98DF25))


def _parser(length: int, unit: str):
    core = length - length // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, prefix, offsets in sequences(b.column("body"), unit):
                p = parse(prefix, offsets, length, GRAM[unit])
                rows = pa.array(at + p.doc)
                full = T.span_hashes(prefix, p.low, p.high + length) ^ T.mix((p.trigger - p.low).astype(np.uint64))
                base = offsets[p.doc]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("version").take(rows), _signed(T.span_hashes(prefix, p.trigger, p.trigger + core)), _signed(_second(full, prefix, p.low, p.high + length)), pa.array(p.low - base), pa.array(p.high - base)],
                    names=["doc_id", "version", "core", "context", "low", "high"],
                )

    return run


PHRASE = "doc_id long, version long, core long, context long, low long, high long"


def _edge_strings(length: int, unit: str):
    """A row for each string of the listed phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column("phrases")
            edge, flat = listed.offsets.to_numpy(), listed.values.flatten()
            core, low, high, many = (x.to_numpy(zero_copy_only=False) for x in flat)
            for at, prefix, offsets in sequences(b.column("body"), unit):
                for k in range(len(offsets) - 1):
                    s, e = edge[at + k], edge[at + k + 1]
                    if s == e:
                        continue
                    width = (high[s:e] - low[s:e] + 1).astype(np.int64)
                    which = np.repeat(np.arange(s, e), width)
                    place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + low[which]
                    begin = place + offsets[k]
                    h = T.span_hashes(prefix, begin, begin + length)
                    row = pa.array(np.full(len(place), at + k))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(row), b.column("version").take(row), pa.array(core[which]), _signed(_second(h, prefix, begin, begin + length)), pa.array(place), pa.array(many[which])],
                        names=["doc_id", "version", "core", "string", "place", "many"],
                    )

    return run


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [low, high) ranges, as maximal ranges in order."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:], len(low)) - 1]


def _covered(ranges: pa.Scalar, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by strings of ``length`` whose first places lie in the ranges."""
    if ranges is None or ranges.values is None or not len(ranges.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = ranges.values.flatten()
    return merged(low.to_numpy(), high.to_numpy() + length)


def _removal(length: int, passage: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            listed, shared = b.column("ranges"), b.column("passages")
            sizes, removed, spans, digests, passages, texts, where = [], [], [], [], [], [], []
            for i, body in enumerate(b.column("body")):
                view = memoryview(body.as_buffer())
                lo, hi = _covered(listed[i], length)
                sha, at, parts = hashlib.sha256(), 0, []
                for s, e in [*zip(lo.tolist(), hi.tolist(), strict=True), (len(view), len(view))]:
                    sha.update(view[at:s])
                    if keep_text:
                        parts.append(bytes(view[at:s]))
                    at = e
                sizes.append(len(view))
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
                digests.append(sha.hexdigest())
                first, last = _covered(shared[i], passage)
                passages.append(int((last - first).sum()))
                where.append([{"start": s, "end": e} for s, e in zip(lo.tolist(), hi.tolist(), strict=True)])
                texts.append(b"".join(parts))
            cols = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(passages, pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
            if keep_text:
                cols += [pa.array(texts, pa.binary()), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"
ROW = ["doc_id", "version"]


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])


def repeated(docs: DataFrame, length: int, space: Workspace, unit: str = "bytes", across: bool = False) -> DataFrame:
    """(doc_id, version, low, high): the ranges of places at which a string of ``length`` units starts that also starts anywhere else.

    With ``across`` only those count that start in another document too.
    ``docs`` has doc_id, version and body.
    """
    holder = F.struct(*ROW)
    # Does a group have what makes its strings repeated: two occurrences, or two documents?
    many = ~F.min(holder).eqNullSafe(F.max(holder)) if across else F.count("*") > 1
    t = lambda name: f"{unit}-{name}"

    phrases = space.save(docs.select(*ROW, "body").mapInArrow(_parser(length, unit), PHRASE), t("parse"))
    cores = space.save(phrases.groupBy("core").agg(many.alias("many")).filter("many").select("core"), t("cores"))
    phrases = space.save(phrases.join(cores, "core"), t("candidates"))
    space.drop(t("parse"), t("cores"))
    one = F.struct(*ROW, "low", "high")
    classes = space.save(phrases.groupBy("core", "context").agg(many.alias("many"), F.min(one).alias("one")), t("dictionary"))
    whole = phrases.join(classes.filter("many").select("core", "context"), ["core", "context"]).select(*ROW, "low", "high")

    # Edges: every class of a core that has a class whose strings are not all repeated.
    mixed = space.save(classes.filter("not many").select("core").distinct(), t("edges"))
    listed = classes.join(mixed, "core").select("core", "context", "many", "one.*")
    if across:
        # A document may hold such a class more than once; all its occurrences are looked at.
        inside = phrases.join(classes.filter("not many").select("core", "context"), ["core", "context"]).select("core", F.lit(False).alias("many"), *ROW, "low", "high")
        listed = listed.filter("many").select(*inside.columns).unionByName(inside)
    work = space.save(listed.select(*ROW, F.struct("core", "low", "high", "many").alias("p")).groupBy(*ROW).agg(F.collect_list("p").alias("phrases")), t("work"))
    # Of repeated rows one is enough: their phrases occur twice and are not edges. Texts without an edge do not move.
    near = that_may_meet(docs, F.col("version"), work, F.col("version"))
    bodies = near.join(work, _same(near, work)).select(near["doc_id"], near["version"], "body", "phrases")
    strings = space.save(bodies.mapInArrow(_edge_strings(length, unit), "doc_id long, version long, core long, string long, place long, many boolean"), t("strings"))
    known = F.max("many") | (~F.min(holder).eqNullSafe(F.max(holder)) if across else F.count("*") > 1)
    twice = space.save(strings.groupBy("core", "string").agg(known.alias("known")).filter("known").select("core", "string"), t("twice"))
    single = strings.filter("not many").join(twice, ["core", "string"]).select(*ROW, F.col("place").alias("low"), F.col("place").alias("high"))
    out = space.save(whole.unionByName(single).groupBy(*ROW).agg(F.collect_set(F.struct("low", "high")).alias("ranges")), t("ranges"))
    space.drop(*map(t, ("candidates", "dictionary", "edges", "work", "strings", "twice")))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, name: str = "repeats", doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """A row a document: its size, what is removed, the SHA-256 of what stays (with ``keep_text`` also the bytes kept and the spans).

    ``n_passage_words`` counts the words inside passages of ``passage_words``
    words that another document holds too, of whatever length in bytes. It
    reports them; nothing is removed for it.
    """
    for unit, least in (("bytes", length), ("words", passage_words)):
        if least < 2 * GRAM[unit]:
            raise ValueError(f"{2 * GRAM[unit]} {unit} at least")
    space = Workspace(docs.sparkSession, name)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body")).withColumn("version", F.xxhash64("body"))
    ranges = repeated(docs, length, space)
    passages = repeated(docs, passage_words, space, "words", across=True).withColumnRenamed("ranges", "passages")
    found = ranges.join(passages, _same(ranges, passages), "full").select(*[F.coalesce(ranges[c], passages[c]).alias(c) for c in ROW], "ranges", "passages")
    found = space.save(found, "found")
    # Texts in which nothing was found stay where they are.
    marked = with_may_meet(docs, F.col("version"), found, F.col("version"))
    near = marked.filter("_may")
    out = near.join(found, _same(near, found), "left").select(near["doc_id"], "body", "ranges", "passages")
    out = out.unionByName(marked.filter("not _may").select("doc_id", "body"), allowMissingColumns=True)
    extra = ", kept binary, spans array<struct<start: long, end: long>>" if keep_text else ""
    return out.mapInArrow(_removal(length, passage_words, keep_text), RESULT + extra)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400, "op10")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE: dict[str, str] = {}
