"""Periodic runs of words: maximal repetitions, found by Main-Lorentz in what repeated k-grams leave.

A run is a stretch of words with smallest period q, at least ``max(SHORTEST, 2
q)`` words long, that no neighbouring word extends. It overlaps itself, moved by
q, in at least ``SHORTEST / 2`` words, so each of its words lies in a k-gram (k
= ``SHORTEST / 2``) that the document holds twice. Words outside such k-grams
cannot join runs: they are masked, which leaves segments, and a run lies in one
of them with the words that would extend it. Most texts have few segments or
none.

Main-Lorentz halves each segment again and again. A run is found where a cut
first falls inside it: with the cut at m, for each distance p the words before m
- p or m and those from there on are compared (two common extensions), and both
together must be at least p long. All segments of a block of texts are halved
together in numpy; extensions come from prefix hashes by doubling and bisection
and reach beyond the halves, so a run comes out whole at once. Runs are then
compared word by word with themselves; a segment where a hash deceived is done
again without hashes. Of several distances for one stretch the smallest is its
period.

Defined results: null text has no words, no runs and collapses to the empty
text; repeated rows give repeated results; equal lengths of runs are decided by
start, then period; a text of any length is taken whole by one task, with some
200 bytes of memory for each of its words; other columns are kept, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import text as T

SHORTEST = 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def segments(word: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """(start, end) of the stretches of words that k-grams of their own document cover that it holds twice or more."""
    n = len(word)
    if n <= k:
        return np.zeros((0, 2), np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    gram = T.ngram_hashes(word, k)[inside] ^ T.mix(doc[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(n + 1, np.int64)
    at = inside[twice]
    depth[at] += 1
    depth[at + k] -= 1
    covered = np.cumsum(depth[:-1]) > 0
    begins, ends = covered.copy(), covered.copy()
    border = doc[1:] != doc[:-1]
    begins[1:] &= ~covered[:-1] | border
    ends[:-1] &= ~covered[1:] | border
    return np.stack([np.flatnonzero(begins), np.flatnonzero(ends) + 1], axis=1)


class Extensions:
    """How far two places of a word sequence agree, forwards and backwards."""

    def __init__(self, word: np.ndarray):
        self.word, self.prefix = word, T.prefix_of(word)
        self.power = T.powers(len(word))

    def _same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[i + size] - self.prefix[i]) * self.power[j - i] == self.prefix[j + size] - self.prefix[j]

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest size <= most so that the words from i and j on (or up to them, exclusive) agree; i < j."""
        size = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        near = self.word[i[live] - 1] == self.word[j[live] - 1] if back else self.word[i[live]] == self.word[j[live]]
        live = live[near]
        size[live] = 1
        step, going = 1, live
        rising = []
        while len(going):  # doubling: few pairs agree for long
            step *= 2
            rising.append(going)
            size_now = np.minimum(size[going] * 0 + step, most[going])
            ok = self._agree(i[going], j[going], size_now, back)
            size[going[ok]] = size_now[ok]
            going = going[ok & (size_now == step)]
        step //= 2
        while step:
            now = live[(size[live] + step <= most[live]) & (size[live] >= step)]
            if len(now):
                ok = self._agree(i[now], j[now], size[now] + step, back)
                size[now[ok]] += step
            step //= 2
        return size

    def _agree(self, i: np.ndarray, j: np.ndarray, size: np.ndarray, back: bool) -> np.ndarray:
        return self._same(i - size, j - size, size) if back else self._same(i, j, size)


def main_lorentz(word: np.ndarray, parts: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, end, distance) of every repetition of at least ``shortest`` words in the segments, with each distance that it repeats at."""
    if not len(parts):
        return np.zeros((0, 3), np.int64)
    far = Extensions(word)
    found = []
    low, high = parts[:, 0], parts[:, 1]  # of the segment
    l, r = low, high  # noqa: E741  of its part at this depth
    while len(l):
        m = (l + r) // 2
        for before in (True, False):
            count = m - l if before else r - m
            which = np.repeat(np.arange(len(l)), count)
            p = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + 1
            at = m[which]
            i, j = (at - p, at) if before else (at, at + p)
            fits = (j < high[which]) if not before else np.ones(len(p), bool)
            which, p, i, j = which[fits], p[fits], i[fits], j[fits]
            on = far.reach(i, j, high[which] - j, back=False)
            need = np.maximum(p, shortest - p)
            # What the words after the cut leave open has to come from those before it.
            hope = np.flatnonzero(on + (i - low[which]) >= need)
            which, p, i, j, on, need = which[hope], p[hope], i[hope], j[hope], on[hope], need[hope]
            off = far.reach(i, j, i - low[which], back=True)
            ok = on + off >= need
            found.append(np.stack([i[ok] - off[ok], j[ok] + on[ok], p[ok]], axis=1))
        keep = r - l > shortest  # both halves of a shorter part are too short for a run
        l, m, r, low, high = l[keep], m[keep], r[keep], low[keep], high[keep]  # noqa: E741
        l, r, low, high = np.concatenate([l, m]), np.concatenate([m, r]), np.tile(low, 2), np.tile(high, 2)  # noqa: E741
        some = r - l >= 2
        l, r, low, high = l[some], r[some], low[some], high[some]  # noqa: E741
    return np.concatenate(found)


def plain_runs(word: np.ndarray, start: int, end: int, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """The same for one segment, distance by distance, without hashes."""
    out = []
    for p in range(1, (end - start) // 2 + 1):
        same = np.concatenate([[False], word[start : end - p] == word[start + p : end], [False]])
        a, b = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(~same[1:] & same[:-1])
        out += [(start + x, start + y + p, p) for x, y in zip(a.tolist(), b.tolist(), strict=True) if y - x >= max(p, shortest - p)]
    return out


def periods(found: np.ndarray) -> np.ndarray:
    """Of each stretch (start, end) the smallest distance, which is its period."""
    got = found[np.lexsort([found[:, 2], found[:, 1], found[:, 0]])]
    return got[np.append(True, (got[1:, :2] != got[:-1, :2]).any(1))[: len(got)]]


def runs_of(word: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, end, period) of all runs of the documents whose words begin at ``first``, in order of start and period."""
    parts = segments(word, first, shortest // 2)
    got = main_lorentz(word, parts, shortest)
    if not len(got):
        return got
    got = periods(got)
    wrong = [k for k, (s, e, p) in enumerate(got) if not _is_run(word, s, e, p)]
    if wrong:
        redo = np.unique(np.searchsorted(parts[:, 0], got[wrong, 0], "right") - 1)
        inside = np.searchsorted(parts[:, 0], got[:, 0], "right") - 1
        again = [x for k in redo for x in plain_runs(word, *parts[k], shortest)]
        got = periods(np.concatenate([got[~np.isin(inside, redo)], np.array(again, np.int64).reshape(-1, 3)]))
    return got[np.lexsort([got[:, 2], got[:, 0]])]


def _is_run(word: np.ndarray, s: int, e: int, p: int) -> bool:
    return bool((word[s : e - p] == word[s + p : e]).all())


def dropped_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each document joined by one blank: bytes and offsets."""
    size = end - start + 1  # with the blank behind it
    last = first[1:][np.diff(first) > 0] - 1
    size[last] -= 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 32, np.uint8)
    length = end - start
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to[:-1], length) + inside] = buf[np.repeat(start, length) + inside]
    return out, to[first]


def _block(buf: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    start, end, first = T.word_spans(buf, offsets)
    word = T.span_hashes(T.prefix_hashes(buf), start, end)
    runs = runs_of(word, first, shortest)
    keep = ~dropped_words(runs, len(word))
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    data, at = joined(buf, start[keep], end[keep], kept_before[first])
    doc = np.searchsorted(first, runs[:, 0], "right") - 1
    flat = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[doc]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(first))), pa.int32()), flat)
    texts = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return pa.array(np.diff(first)), lists, texts


def collapse_runs(docs: DataFrame, keep: list[str], text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``keep`` columns with n_words, runs (start, length, period) in order, and the text without the repeats of its runs."""
    took = [f"_kept_{i}" for i in range(len(keep))]
    schema = docs.select(*keep).schema
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(took, schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_block(buf, offsets, shortest) for _, buf, offsets in T.blocks(b.column("_text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in took), *(pa.concat_arrays(x) for x in zip(*parts, strict=True))], names=[*took, "n_words", "runs", "collapsed"])

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, took, strict=True)], F.col(text).alias("_text"))
    out = rows.mapInArrow(run, f"{ddl}, n_words long, runs {RUNS}, collapsed string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, took, strict=True)], "n_words", "runs", "collapsed")


def longest(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start, then the smallest period; null without a run."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(key)


def planted(docs: DataFrame) -> DataFrame:
    """``documents`` whose every tenth text, by a hash of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # The lambda's argument is evaluated once a row, however often its fields are read.
    held = F.array(F.struct(T.words(F.col("text")).alias("words"), F.floor(h / 10).alias("g")))

    def repeat(x: Column) -> Column:
        n = F.size(x["words"]).cast("long")
        return F.struct(x["words"].alias("words"), (x["g"] % n).alias("a"), n.alias("n"), x["g"].alias("g"))

    def joined_words(x: Column) -> Column:
        a, n = x["a"], x["n"]
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        cycle = F.slice(x["words"], (a + 1).cast("int"), p.cast("int"))
        again = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(x["words"], F.lit(1), a.cast("int")), again), " ")

    found = F.filter(held, lambda x: F.size(x["words"]) > 0)
    made = F.transform(F.transform(found, repeat), joined_words)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(F.get(made, F.lit(0)), F.col("text"))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = collapse_runs(planted(docs), ["doc_id"])
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), (r["period"].cast("string"))))
    listing = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    best = got.withColumn("best", longest(F.col("runs")))
    length, period = -F.col("best.n"), F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: Runs need every period of every stretch, which SQL cannot enumerate over whole texts in time; tested against brute force.
ORACLE: dict[str, str] = {}
