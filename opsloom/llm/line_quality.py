"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets a small vector of shape features (symbols, capitals,
repeats, ...) of its own and of the lines before and after it. The field has the
states bad and good, weights for the features and for the four transitions, and
is trained on documents with a quality label, each line taking its document's
label. The forward-backward marginals of a document's lines, weighted by their
length, give its raw score; a logistic curve fitted on the same labelled
documents turns it into a probability.

The fit uses a bounded sample of labelled rows (``FIT_DOCS`` at most, the first
in order of a hash of their ids); scoring reads every line of every whole text.
The weights (about 80 numbers) are sent to the tasks.

Defined results: null or empty text, or text without a word, has score 0;
without labelled documents of both kinds every document with a line has score
0.5; repeated rows get the same answer; extra columns are ignored.
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

FIT_DOCS = 3000
PREDICT_AT = 0.7
ITERATIONS = 150
L2 = 1e-3
OWN = 12  # features of a line itself


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(characters)] = 1
    return out


SYMBOL, SHOUT, UPPER, DIGIT, STOP = (_class(x) for x in (b"#*$%&|<>=_{}[]~^", b"!?", bytes(range(65, 91)), b"0123456789", b".!?"))
LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


@dataclass
class Lines:
    """Lines with a word, in document order: features, bytes, and the index of each document's first line."""

    x: np.ndarray
    size: np.ndarray
    first: np.ndarray


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> Lines:
    n_docs = len(offsets) - 1
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    cut[np.flatnonzero(buf == 10) + 1] = True
    start = np.flatnonzero(cut[:-1])
    edges = np.append(start, len(buf))
    ws, we, word_at = T.word_spans(buf, edges)
    n_words = np.diff(word_at)
    has = n_words > 0
    doc = np.searchsorted(offsets, start, "right") - 1
    end = edges[1:]

    def count(table: np.ndarray) -> np.ndarray:
        c = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(table[buf], out=c[1:])
        return (c[end] - c[start]).astype(float)

    prefix = T.prefix_hashes(buf, T.LOWER_CODE)
    word = T.span_hashes(prefix, ws, we)
    line_of_word = np.repeat(np.arange(len(start)), n_words)
    _, seen = np.unique(word ^ T.mix(line_of_word.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(line_of_word[seen], minlength=len(start))
    again = (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    repeats = np.bincount(line_of_word[1:][again], minlength=len(start))
    whole = T.span_hashes(prefix, start, end) ^ T.mix(doc.astype(np.uint64) + np.uint64(1))
    first_place = np.zeros(len(start), bool)
    first_place[np.unique(whole, return_index=True)[1]] = True
    letters = np.maximum(count(LETTER), 1)
    words = np.maximum(n_words, 1)
    last_word_end = we[np.minimum(np.maximum(word_at[1:] - 1, 0), max(len(we) - 1, 0))] if len(we) else np.zeros(len(start), int)
    x = np.stack([
        np.ones(len(start)),
        np.log1p(n_words) / 5,
        np.minimum(count(SYMBOL) / words, 3) / 3,
        np.minimum(count(SHOUT) / words, 3) / 3,
        count(UPPER) / letters,
        np.minimum(count(DIGIT) / letters, 1),
        np.minimum((we[word_at[1:] - 1] - ws[np.minimum(word_at[:-1], len(ws) - 1)]) / words, 40) / 40 if len(ws) else np.zeros(len(start)),
        1 - distinct / words,
        repeats / words,
        (~first_place).astype(float),
        STOP[buf[np.maximum(last_word_end - 1, 0)]].astype(float) if len(buf) else np.zeros(len(start)),
        (n_words < 3).astype(float),
    ], axis=1)
    x, doc, size = x[has], doc[has], (end - start)[has]
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        inner = doc[1:] == doc[:-1]
        before[1:][inner] = x[:-1][inner]
        after[:-1][inner] = x[1:][inner]
    return Lines(np.concatenate([x, before, after], axis=1), size, first)


def lines_of_column(texts: pa.Array) -> Iterator[Lines]:
    for _, buf, offsets in T.blocks(texts):
        yield lines_of(buf, offsets)


def marginals(unary: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(state) of each line, summed P(pair of states), and log Z of each document.

    All documents go forward together, one line at a time; documents are
    ordered by length so that those still running are a prefix.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    long, begin = n[order], first[:-1][order]
    alpha, beta, scale = np.zeros_like(unary), np.ones_like(unary), np.ones(len(unary))
    e_step, top = np.exp(step), unary.max(1, keepdims=True) if len(unary) else unary
    e_unary = np.exp(unary - top)
    running = [int(np.searchsorted(-long, -t, "left")) for t in range(int(long[0]) if len(long) else 0)]  # documents with more than t lines
    for t, k in enumerate(running):
        at = begin[:k] + t
        a = e_unary[at] if t == 0 else (alpha[at - 1] @ e_step) * e_unary[at]
        s = a.sum(1)
        alpha[at], scale[at] = a / s[:, None], s
    for t in range(len(running) - 2, -1, -1):
        k = running[t + 1]
        at = begin[:k] + t
        beta[at] = (beta[at + 1] * e_unary[at + 1] / scale[at + 1][:, None]) @ e_step.T
    p = alpha * beta
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    has_next = np.ones(len(unary), bool)
    ends = first[1:][n > 0] - 1
    has_next[ends] = False
    i = np.flatnonzero(has_next)
    pair = alpha[i][:, :, None] * e_step[None] * (e_unary[i + 1] * beta[i + 1] / scale[i + 1][:, None])[:, None, :] if len(i) else np.zeros((0, 2, 2))
    logs = np.log(scale) + top[:, 0] if len(unary) else scale
    log_z = np.add.reduceat(np.append(logs, 0.0), np.minimum(first[:-1], len(logs))) * (n > 0)
    return p, pair.sum(0), log_z


@dataclass
class Field:
    weights: np.ndarray  # state x feature
    step: np.ndarray  # state x state
    slope: float
    offset: float

    def raw(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of P(good) for each document; nan without a line."""
        p, _, _ = marginals(lines.x @ self.weights.T, self.step, lines.first)
        add = lambda v: np.add.reduceat(np.append(v, 0.0), np.minimum(lines.first[:-1], len(v))) * (np.diff(lines.first) > 0)
        with np.errstate(invalid="ignore"):
            return add(p[:, 1] * lines.size) / add(lines.size.astype(float))

    def score(self, lines: Lines) -> np.ndarray:
        r = np.clip(self.raw(lines), 1e-6, 1 - 1e-6)
        s = 1 / (1 + np.exp(-(self.slope * np.log(r / (1 - r)) + self.offset)))
        return np.where(np.isnan(s), 0.0, s)


def fit(texts: list[str], labels: list[int], iterations: int = ITERATIONS) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam; then the logistic curve."""
    y = np.array(labels, int)
    width = 3 * OWN
    if len(set(labels)) < 2:
        return Field(np.zeros((2, width)), np.zeros((2, 2)), 0.0, 0.0)
    buf, offsets = T.utf8_parts(pa.array(texts, pa.large_string()))
    lines = lines_of(buf, offsets)
    n = np.diff(lines.first)
    state = np.repeat(y, n)
    # Documents count alike, whatever their length, and both labels weigh the same.
    inner = np.repeat(n, n) > 0
    gold_unary = np.eye(2)[state]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y, y), np.maximum(n - 1, 0))
    theta, m, v = np.zeros(2 * width + 4), np.zeros(2 * width + 4), np.zeros(2 * width + 4)
    total = max(inner.sum(), 1)
    for t in range(1, iterations + 1):
        w, step = theta[: 2 * width].reshape(2, width), theta[2 * width :].reshape(2, 2)
        p, pair, _ = marginals(lines.x @ w.T, step, lines.first)
        g = np.concatenate([((p - gold_unary).T @ lines.x).ravel(), (pair - pairs).ravel()]) / total + L2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    field = Field(theta[: 2 * width].reshape(2, width), theta[2 * width :].reshape(2, 2), 1.0, 0.0)
    raw = field.raw(lines)
    ok = ~np.isnan(raw)
    r = np.clip(raw[ok], 1e-6, 1 - 1e-6)
    f, a, b = np.log(r / (1 - r)), 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * f + b)))
        d = p - y[ok]
        a, b = a - 0.05 * ((d * f).mean() + 0.01 * (a - 1)), b - 0.05 * d.mean()
    field.slope, field.offset = max(float(a), 0.05), float(b)
    return field


def fit_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> tuple[list[str], list[int]]:
    """At most ``most`` labelled documents; of several labels of an id the lowest counts."""
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = marks.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(most).toPandas()
    return [t or "" for t in got["text"]], got["quality"].astype(int).tolist()


def score(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.step, field.slope, field.offset))
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*sent.value)
        for b in batches:
            s = [f.score(x) for x in lines_of_column(b.column("text"))]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, "text").mapInArrow(run, schema.add("score", DoubleType()).add("predicted", IntegerType()))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = fit(*fit_sample(docs, labels.filter(~held_out(2, 4))))
    return score(docs.withColumn("held_out", held_out(2, 4)), field, ["doc_id", "held_out"])


QUERIES = {"op6_line_quality": op6_line_quality}
ORACLE: dict[str, str] = {}
