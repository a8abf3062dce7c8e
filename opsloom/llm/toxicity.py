"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents have a label that counts; all others are
unlabelled, toxic ones among them. With the class prior pi the risk of a linear
classifier g under the logistic loss l is

    pi E_pos[l(g)] + max(0, E_unl[l(-g)] - pi E_pos[l(-g)])

where the second term is the risk on clean documents, seen through the mixture.
Where that is negative the classifier says of more unlabelled documents than
there can be that they are clean; it then counts for nothing, and only the
confirmed documents move the weights. ``MEMBERS`` classifiers see other
parts of the unlabelled sample and other batches, and their logits are averaged.

Features are the byte 5-grams of the words of a text with one blank on either
side (lower-case ASCII letters, cut at everything in ASCII but letters and
digits), each held once, twice or three times at least, as 42-bit numbers
without a table of slots: a rare gram in a long text may be chance. Weights are
never negative, so a long text cannot outweigh what it holds, and a proximal L1
step after each update keeps the few that tell toxic documents apart.

The fit uses bounded samples, the first in order of a hash of their ids, with
their whole texts: ``FIT_TOXIC`` confirmed and ``FIT_UNLABELLED`` unlabelled
documents at most, as sets of their grams; grams count as features that the
confirmed sample holds more often than chance explains (``LEAST_Z`` standard
errors). The prior is a parameter or comes from the logits of a first
classifier, see ``class_prior``, times ``MARGIN``, since too small a prior makes
clear evidence look weak, while the bound at zero takes the harm from one that
is somewhat too large; the share of toxic among labelled rows is no measure of
it, as such rows are seldom a fair sample. Scoring reads every word of every
whole text; the weights, a row for each gram kept, are sent to the tasks.

Defined results: a null or empty text has the score of a text without any known
gram; without confirmed rows every score is 0; of several labels of an id the
highest counts; repeated rows get the same answer; a text of any length is read
in one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from opsloom.llm import text as T
from opsloom.llm.language_id import held_out
from opsloom.llm.workspace import Workspace

FIT_TOXIC = 4000
FIT_UNLABELLED = 12000
GRAM = 5
LEVELS = (1, 2, 3)
LEAST_Z = 4.0
FIRST_PRIOR = 0.05
CUT_SHARE = 0.2
MARGIN = 1.25
MEMBERS = 3
PREDICT_AT = 0.7
STEPS = 480
BATCH = 200  # confirmed documents a step at least
L2 = 1e-4
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)


def grams_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each 5-gram of the words and borders of each text, and the index of its text."""
    start, end, first = T.word_spans(buf, offsets, T.IS_MARK)
    n, length = len(first) - 1, end - start
    doc = np.repeat(np.arange(n), np.diff(first))
    ends = np.concatenate([[0], np.cumsum(length + 1)])
    begin = ends[first] + np.arange(n + 1)  # a blank before the first word and behind each word
    out = np.full(begin[-1], 32, np.uint64)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(ends[:-1] + doc + 1, length) + inside] = LOWER[buf[np.repeat(start, length) + inside]]
    grams = np.zeros(max(len(out) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        grams = (grams << np.uint64(8)) | out[i : i + len(grams)]
    count = np.maximum(np.diff(begin) - GRAM + 1, 0)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[:-1], count)
    return grams[at], np.repeat(np.arange(n), count)


def distinct(gram: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text, one text after the other, and the n + 1 places where a text's begin.

    A feature is a gram (its number) and one of ``LEVELS`` (the bits above it):
    the text holds the gram that often or more.
    """
    bits = np.uint64(8 * GRAM)
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(8 * GRAM + 2)) | gram, return_counts=True)
    key = np.sort(np.concatenate([key[count >= least] | (np.uint64(level) << bits) for level, least in enumerate(LEVELS)]))
    return key & ((np.uint64(4) << bits) - np.uint64(1)), np.searchsorted(key >> (bits + np.uint64(2)), np.arange(n + 1).astype(np.uint64))


@dataclass
class Model:
    grams: np.ndarray  # features in order, those with a weight
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.grams):
            return np.full(n, self.bias)
        gram, doc = grams_of(buf, offsets)
        known = np.unique(self.grams & np.uint64((1 << 8 * GRAM) - 1))
        hit = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
        found, first = distinct(gram[hit], doc[hit], n)
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        value = np.where(self.grams[at] == found, self.weights[at], 0.0)
        return np.bincount(np.repeat(np.arange(n), np.diff(first)), value, n) + self.bias

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior <= 0:
            return np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.logits(buf, offsets), -40, 40)))


class Rows:
    """Documents as lists of features."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def __len__(self) -> int:
        return len(self.size)

    def sums(self, w: np.ndarray) -> np.ndarray:
        f, d = self.take(np.arange(len(self)))
        return np.bincount(d, w[f], len(self))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the documents ``which`` and, for each, its place in ``which``."""
        n = self.size[which]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.first[which], n) + inside], np.repeat(np.arange(len(which)), n)


def nn_pu(positive: Rows, unlabelled: Rows, width: int, prior: float, seed: int, steps: int = STEPS, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk by Adam.

    The first half of the epochs takes a proximal L1 step after each update, so
    large that chance seldom gives a gram a weight; the second fits the grams
    that are left without it, since L1 would make their weights too small.
    """
    batches = max(1, len(positive) // BATCH)
    epochs = max(2, steps // batches)
    l1 = prior * (0.02 + 0.5 / np.sqrt(len(positive)))
    rng = np.random.default_rng(seed)
    w = np.append(np.zeros(width), np.log(prior / (1 - prior)))
    m, v, t = np.zeros(width + 1), np.zeros(width + 1), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    part = rng.permutation(len(unlabelled))[: max(1, len(unlabelled) * 2 // 3)]
    live = np.ones(width + 1)
    for epoch in range(epochs):
        if epoch == epochs // 2:
            live[:-1] = w[:-1] != 0
            l1, m, v, t = 0.0, 0 * m, 0 * v, 0
        rng.shuffle(part)
        pos_parts = np.array_split(rng.permutation(len(positive)), batches)
        for ps, us in zip(pos_parts, np.array_split(part, batches), strict=True):
            if not len(ps) or not len(us):
                continue
            (pf, pd), (uf, ud) = positive.take(ps), unlabelled.take(us)
            zp, zu = np.bincount(pd, w[pf], len(ps)) + w[-1], np.bincount(ud, w[uf], len(us)) + w[-1]
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = -prior / len(ps) * sigmoid(-zp), np.zeros(len(us))
            if clean > 0:
                gp, gu = gp - prior / len(ps) * sigmoid(zp), sigmoid(zu) / len(us)
            g = np.append(np.bincount(pf, gp[pd], width) + np.bincount(uf, gu[ud], width) + L2 * w[:-1], gp.sum() + gu.sum()) * live
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            pace = rate * (1 - epoch / epochs) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
            w = w - pace * m / (1 - 0.9**t)
            w[:-1] = np.maximum(w[:-1] - pace[:-1] * l1, 0)
    return w[:-1], float(w[-1])


def class_prior(of_positive: np.ndarray, of_unlabelled: np.ndarray) -> float:
    """The largest share of toxic documents that no cut of the logits contradicts.

    Beyond any cut the unlabelled documents must hold at least that share of what
    the confirmed ones hold; cuts with less than ``CUT_SHARE`` of these are too noisy.
    """
    cuts = np.unique(np.quantile(of_positive, np.linspace(0, 1 - CUT_SHARE, 50)))
    p = np.array([(of_positive >= c).mean() for c in cuts])
    u = np.array([((of_unlabelled >= c).sum() + 1) / (len(of_unlabelled) + 1) for c in cuts])
    return float(np.clip((u / p)[p >= CUT_SHARE].min(), 0.001, 0.5))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], grams: np.ndarray, prior: float | None = None) -> Model:
    """From documents as indices into the sorted ``grams``."""
    if not positive:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0)
    p, u = Rows(positive), Rows(unlabelled)
    if prior is None and min(len(p), len(u)) < 2:
        prior = FIRST_PRIOR
    elif prior is None:  # from logits of documents that the first classifier has not seen
        w, _ = nn_pu(Rows(positive[::2]), Rows(unlabelled[::2]), len(grams), FIRST_PRIOR, MEMBERS)
        prior = MARGIN * class_prior(Rows(positive[1::2]).sums(w), Rows(unlabelled[1::2]).sums(w))
    members = [nn_pu(p, u, len(grams), prior, seed) for seed in range(MEMBERS)]
    w = np.mean([m[0] for m in members], axis=0)
    used = np.flatnonzero(w)
    return Model(grams[used], w[used], float(np.mean([m[1] for m in members])), prior)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, buf, offsets in T.blocks(b.column("text")):
            n = len(offsets) - 1
            gram, first = distinct(*grams_of(buf, offsets), n)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(gram.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("confirmed").slice(at, n), b.column("order").slice(at, n), lists], names=["confirmed", "order", "grams"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many confirmed and unlabelled documents of a batch hold each gram; gram -1 counts the documents."""
    for b in batches:
        confirmed = b.column("confirmed").to_numpy(zero_copy_only=False).astype(bool)
        lists = b.column("grams")
        of = np.repeat(confirmed, np.diff(lists.offsets.to_numpy()))
        gram, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        p, u = np.bincount(at, of, len(gram)), np.bincount(at, ~of, len(gram))
        columns = [np.append(gram, -1), np.append(p, confirmed.sum()), np.append(u, (~confirmed).sum())]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["gram", "p", "u"])


def samples(docs: DataFrame, labels: DataFrame, space: Workspace) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The fitted documents as indices into the grams that count, and those grams."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    confirmed = marks.filter("toxic = 1").select("doc_id", F.lit(True).alias("confirmed"))
    order = [F.xxhash64(F.lit(17), "doc_id"), "doc_id"]
    others = docs.select("doc_id").filter("doc_id is not null").distinct().select("doc_id", F.lit(False).alias("confirmed"))
    ids = confirmed.orderBy(*order).limit(FIT_TOXIC).union(others.orderBy(*order).limit(FIT_UNLABELLED))
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("confirmed", F.xxhash64(F.lit(17), "doc_id", "text").alias("order"), "text")
    rows = space.save(chosen.mapInArrow(_sets, "confirmed boolean, order long, grams array<long>"), "sets")
    # Rows that repeat an id do not raise the bounds.
    rows = rows.filter("confirmed").orderBy("order").limit(FIT_TOXIC).union(rows.filter("not confirmed").orderBy("order").limit(FIT_UNLABELLED))
    counts = space.save(rows.mapInArrow(_counts, "gram long, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "counts")
    n_p, n_u = counts.filter("gram = -1").agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))).first()
    if not n_p:
        return [], [], np.zeros(0, np.uint64)
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / max(n_u, 1)) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / max(n_u, 1)))
    known = counts.filter((F.col("gram") >= 0) & (F.col("p") >= 3) & (z >= LEAST_Z)).select("gram").toPandas()
    grams = np.sort(known["gram"].to_numpy(np.int64).view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("grams"):
                own = x.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(sent.value, own), max(len(sent.value) - 1, 0))
                out.append(at[sent.value[at] == own] if len(sent.value) else at[:0])
            yield pa.RecordBatch.from_arrays([b.column("confirmed"), pa.array(out, pa.list_(pa.int64()))], names=["confirmed", "at"])

    got = rows.sort("confirmed", "order").mapInArrow(indexed, "confirmed boolean, at array<long>").toPandas()
    pick = lambda flag: [np.asarray(x, np.int64) for x in got["at"][got["confirmed"] == flag]]
    return pick(True), pick(False), grams


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.grams, model.weights, model.bias, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            s = np.concatenate([np.zeros(0), *(m.scores(buf, offsets) for _, buf, offsets in T.blocks(b.column("text")))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = docs.select(*keep).schema
    return docs.select(*keep, "text").mapInArrow(run, schema.add("score", DoubleType()).add("predicted", IntegerType()))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = held_out(1, 3)
    model = fit(*samples(docs.filter(~held), labels.filter(~held), Workspace(spark, "op11")))
    return score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


QUERIES = {"op11_toxicity": op11_toxicity}
#: Learned weights; tested on held-out labels and against a plain computation of the risk.
ORACLE: dict[str, str] = {}
