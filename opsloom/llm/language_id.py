"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of a text's characters (lower case; every run of
other characters than letters is one blank), hashed into a fixed table. A
feature's value is its share of the text's n-grams times its inverse document
frequency. Weights are trained with follow-the-regularised-leader (per
coordinate rates, L1 and L2 penalties), so most stay zero, and the scores are
calibrated with one temperature on documents kept out of the fit.

The fit uses a bounded sample of labelled rows with their whole texts
(``FIT_PER_LANGUAGE`` of each language at most, the first in order of a hash of
their ids). Document frequencies are counted over all labelled rows; the
prediction reads every whole text. The model is a table of ``2**HASH_BITS`` rows
and is sent to the tasks.

The score only compares the learned languages, so it cannot tell that a text is
in none of them. For that a text's strangeness is the mean rarity of its
3-grams, where the rarity of a 3-gram is -log of the largest share of a
language's fitted texts that have it: a mixed text is not strange, and neither
the number nor the sizes of the languages matter. The pipeline's cutoff lies
midway between the held-out documents and the same documents with their letters
shuffled (``EDGE`` of either lie beyond their side of it).

Defined results: null text, and text without a letter, is ``und`` with score 0;
without any labelled row everything is ``und``; null languages are not learned
from; repeated rows get the same answer; extra columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIT_PER_LANGUAGE = 600
SAMPLE_BITS = 12
HASH_BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
EDGE = 0.01
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point its lower-case letter, or a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def characters(text: str | None) -> np.ndarray:
    """The letters of a text, with one blank for whatever stands between them and at both ends."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letters()[raw]
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    low = low[keep]
    if len(low) and low[0] == 32:
        low = low[1:]
    if len(low) and low[-1] == 32:
        low = low[:-1]
    return np.concatenate([[32], low, [32]]).astype(np.uint32) if len(low) else np.zeros(0, np.uint32)


def gram_slots(chars: np.ndarray, bits: int = HASH_BITS) -> list[np.ndarray]:
    """For each order the table slot of the n-gram at each place."""
    shift = np.uint32(32 - bits)
    out = []
    h = np.zeros(len(chars), np.uint32)
    for n in ORDERS:
        h = h[: len(chars) - n + 1] if n > 1 else h
        h = (h ^ chars[n - 1 :]) * _MULT[n - 1]
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x27D4EB2F)) >> shift)
    return out


def counts(text: str | None, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slot, share of the text's n-grams) of a text, slots once each."""
    chars = characters(text)
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    slots, n = np.unique(np.concatenate(gram_slots(chars, bits)), return_counts=True)
    return slots.astype(np.int64), (n / n.sum()).astype(np.float32)


def slots_of(text: str | None) -> np.ndarray:
    """The slots of a text, once each; the text is read in blocks."""
    chars, seen = characters(text), np.zeros(1 << HASH_BITS, bool)
    for at in range(0, len(chars), 1 << 18):
        for slots in gram_slots(chars[at : at + (1 << 18) + 2]):
            seen[slots] = True
    return np.flatnonzero(seen)


@dataclass
class Corpus:
    """How many texts there are, and how many of them have each slot."""

    n: int
    df: np.ndarray


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # slot x language: inverse document frequency times weight
    bias: np.ndarray
    temperature: float
    rarity: np.ndarray  # of the 3-grams of a slot
    cutoff: float  # texts with a greater strangeness are in no learned language; infinite where the fit cannot tell

    def logits(self, text: str | None) -> np.ndarray | None:
        chars = characters(text)
        if not len(chars) or not self.languages:
            return None
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(chars), 1 << 18):  # blocks overlap by two characters, so that every n-gram counts once
            block = chars[at : at + (1 << 18) + 2]
            for k, slots in enumerate(gram_slots(block)):
                slots = slots[: (1 << 18)]
                total += np.bincount(slots, minlength=len(self.table)) @ self.table if len(slots) > len(self.table) else self.table[slots].sum(0)
                n += len(slots)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def strangeness(self, text: str | None) -> float:
        return strangeness(characters(text), self.rarity)


def strangeness(chars: np.ndarray, rarity: np.ndarray) -> float:
    """The mean rarity of the 3-grams; 0 for a text without letters."""
    total = 0.0
    for at in range(0, len(chars), 1 << 18):
        total += float(rarity[gram_slots(chars[at : at + (1 << 18) + 2])[2]].sum())
    return total / max(len(chars) - 2, 1)


def rarities(rows: list[np.ndarray], y: np.ndarray, k: int, size: int) -> np.ndarray:
    """-log of the largest share of a language's rows with a slot; for a slot in none of them as if one more row had it."""
    share = np.full(size, 1 / (1 + len(rows)))
    for c in range(k):
        own = [s for s, lang in zip(rows, y, strict=True) if lang == c]
        if own:
            share = np.maximum(share, np.bincount(np.concatenate(own), minlength=size) / len(own))
    return -np.log(share).astype(np.float32)


def strange_cutoff(texts: list[str], rarity: np.ndarray) -> float:
    """Midway between the texts and the same texts with their letters shuffled; infinite if they overlap or there are none."""
    rng, real, shuffled = np.random.default_rng(8), [], []
    for chars in map(characters, texts):
        if len(chars):
            real.append(strangeness(chars, rarity))
            mixed, at = chars.copy(), np.flatnonzero(chars != 32)
            mixed[at] = chars[rng.permutation(at)]
            shuffled.append(strangeness(mixed, rarity))
    if not real:
        return float("inf")
    low, high = float(np.quantile(real, 1 - EDGE)), float(np.quantile(shuffled, EDGE))
    return (low + high) / 2 if low < high else float("inf")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


SCALE = 100.0  # n-gram shares are small; one common scale keeps the penalties readable


def fit(texts: list[str], langs: list[str], corpus: Corpus | None = None, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, bits: int = HASH_BITS) -> Model:
    """FTRL-proximal with an elastic net, then a temperature on every fifth document, kept out of the fit.

    Inverse document frequencies are those of ``corpus``, or of the texts themselves.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, np.zeros(1 << bits, np.float32), float("inf"))
    y = np.array([names.index(x) for x in langs])
    rows = [counts(t, bits) for t in texts]
    if corpus is None:
        corpus = Corpus(len(rows), np.bincount(np.concatenate([s for s, _ in rows]), minlength=1 << bits))
    idf = np.log((1 + corpus.n) / (1 + corpus.df)) + 1
    rows = [(s, v * idf[s] * SCALE) for s, v in rows]
    held = np.arange(len(rows)) % 5 == 4
    z, n = np.zeros((1 << bits, len(names))), np.zeros((1 << bits, len(names)))
    bias = np.log(np.bincount(y, minlength=len(names)) / len(y))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.flatnonzero(~held)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            s, v = rows[i]
            if not len(s):
                continue
            zs, ns = z[s], n[s]
            w = weights(zs, ns)
            p = softmax((v @ w + bias)[None])[0]
            p[y[i]] -= 1
            g = v[:, None] * p[None]
            g2 = g * g
            z[s] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) * alpha**-1 * w
            n[s] = ns + g2
    w = weights(z, n)
    logit = np.array([v @ w[s] + bias for s, v in rows])
    use = held if held.any() else ~held
    grid = np.geomspace(0.1, 10, 81)
    loss = [-np.log(softmax(logit[use] / t)[np.arange(use.sum()), y[use]] + 1e-12).mean() for t in grid]
    learned = np.flatnonzero(~held)
    rarity = rarities([rows[i][0] for i in learned], y[learned], len(names), 1 << bits)
    cutoff = strange_cutoff([texts[i] for i in np.flatnonzero(held)], rarity)
    return Model(names, (w * (idf * SCALE)[:, None]).astype(np.float32), bias, float(grid[int(np.argmin(loss))]), rarity, cutoff)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(1 << HASH_BITS, np.int64)
    for b in batches:
        n += b.num_rows
        for text in b.column("text"):
            df[slots_of(text.as_py())] += 1
    at = np.flatnonzero(df)
    # Slot -1 counts the texts.
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], names=["slot", "n"])


def document_frequencies(docs: DataFrame) -> Corpus:
    """Counted over the whole text of every labelled row; a task sums its rows before they leave it."""
    rows = labelled(docs).select("text").mapInArrow(_count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n, df = dict(zip(rows["slot"], rows["n"], strict=True)), np.zeros(1 << HASH_BITS)
    total = n.pop(-1, 0)
    df[list(n)] = list(n.values())
    return Corpus(int(total), df)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")


def fit_sample(docs: DataFrame, most: int = FIT_PER_LANGUAGE) -> tuple[list[str], list[str], Corpus]:
    """Texts and languages of ``most`` rows a language at most, the first in order of a hash of their ids, and the corpus counts."""
    rows = labelled(docs).withColumn("o", F.xxhash64(F.lit(3), "doc_id"))
    rows = rows.withColumn("b", F.shiftrightunsigned("o", 64 - SAMPLE_BITS))
    # A histogram of the hash says how far each language has to be read, so that only about ``most`` rows of it are ranked.
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("b"))
    last = rows.groupBy("lang", "b").agg(F.count("*").alias("n")).withColumn("before", upto - F.col("n")).filter(F.col("before") < most).groupBy("lang").agg(F.max("b").alias("last"))
    rows = rows.join(F.broadcast(last), "lang").filter("b <= last")  # a row a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", F.xxhash64("text")))
    got = rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("o", "doc_id", "lang", "text").toPandas()
    # The order mixes the languages, so that every fifth row is a fair share of each.
    got = got.sort_values(["o", "doc_id", "lang", "text"])
    return got["text"].tolist(), got["lang"].tolist(), document_frequencies(docs)


def guessed(docs: DataFrame, model: Model, strange: bool = False) -> DataFrame:
    """The columns of ``docs`` under numbers of their own (see ``_named``) and ``guess``: lang_pred, score and, if asked for, whether the text is too strange for any learned language."""
    # Fixed size: slots x languages.
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.rarity, model.cutoff))

    @F.pandas_udf("lang_pred string, score double, strange boolean")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for t in texts:
            yield pd.DataFrame([(*m.predict(x), strange and m.strangeness(x) > m.cutoff) for x in t], columns=["lang_pred", "score", "strange"])

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("guess", told(f"c{docs.columns.index('text')}"))


def _named(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` again, whatever their names."""
    return [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    return guessed(docs, model).select(*_named(docs), "guess.lang_pred", "guess.score")


def held_out(remainder: int, modulus: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose text is in a learned language; the columns stay as they are."""
    model = fit(*fit_sample(docs))
    if not model.languages:  # nothing to learn from: no ground to reject
        return docs
    return guessed(docs, model, strange=True).filter((F.col("guess.lang_pred") != UNKNOWN) & ~F.col("guess.strange")).select(*_named(docs))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(0, 5))
    model = fit(*fit_sample(docs.filter(~F.col("held_out"))))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict[str, str] = {}
