"""Toxicity, conversation repair and periodic runs: brute force, held-out accuracy, odd inputs."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsloom.llm import conversation_repair as repair
from opsloom.llm import periodic_runs as runs
from opsloom.llm import text as T
from opsloom.llm import toxicity
from opsloom.llm.workspace import Workspace
from tests import parity

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, conv string, head string, digest string, gone string, seen string"


# --- 11: toxicity


def test_toxicity_held_out(spark):
    sf = os.environ.get("TEST_SF_DIR_MID", "/root/testdata/sf0.01")
    got = toxicity.op11_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null"), "doc_id").collect()
    clean, toxic = [r for r in rows if r.toxic == 0], [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)  # 26 of the confirmed documents of other languages hold few known stems
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def planted(rng, n, share, word):
    same = np.random.default_rng(1)
    vocabulary = ["".join(same.choice(list("abcdefgh"), 5)) for _ in range(400)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(5, 80))))
        bad = i < n * share
        out.append((text + (f" {word}!" if bad else ""), bad))
    return out


def as_features(texts, grams=None):
    lists = []
    for _, buf, offsets in T.blocks(pa.array(texts)):
        g, first = toxicity.distinct(*toxicity.grams_of(buf, offsets), len(offsets) - 1)
        lists += [g[first[i] : first[i + 1]] for i in range(len(offsets) - 1)]
    grams = np.unique(np.concatenate(lists)) if grams is None else grams
    return [np.flatnonzero(np.isin(grams, x)) for x in lists], grams


def test_unlabelled_positives_do_not_become_clean():
    rng = np.random.default_rng(5)
    pos = [t for t, _ in planted(rng, 200, 1.0, "Zyxwvut")]
    mixed = planted(rng, 2000, 0.15, "Zyxwvut")
    feats, grams = as_features(pos + [t for t, _ in mixed])
    model = toxicity.fit(feats[:200], feats[200:], grams)
    assert 0.12 <= model.prior / toxicity.MARGIN <= 0.19
    fresh = planted(rng, 500, 0.3, "Zyxwvut")
    _, buf, offsets = next(T.blocks(pa.array([t for t, _ in fresh])))
    assert [bool(s >= 0.7) for s in model.scores(buf, offsets)] == [b for _, b in fresh]


def test_step_descends_the_stated_risk():
    """The direction of the first steps against a plain computation of the risk."""
    rng = np.random.default_rng(9)
    pos, unl = [np.flatnonzero(rng.random(6) < [0.9, 0.5, 0.5, 0.1, 0.5, 0.5]) for _ in range(60)], [np.flatnonzero(rng.random(6) < 0.4) for _ in range(300)]

    def risk(w, b, prior=0.3):
        z = lambda rows: np.array([w[r].sum() + b for r in rows])
        loss = lambda v: np.log1p(np.exp(-v))
        zp, zu = z(pos), z(unl)
        return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean())

    w, b = toxicity.nn_pu(toxicity.Rows(pos), toxicity.Rows(unl), 6, 0.3, 0)
    assert (w >= 0).all() and risk(w, b) < risk(np.zeros(6), np.log(0.3 / 0.7)) - 0.01
    assert w.argmax() == 0 and w[3] == 0


def test_grams_are_those_of_the_words():
    texts = ["Ab, cdé", "", None, "x", "a  b"]
    _, buf, offsets = next(T.blocks(pa.array(texts)))
    gram, doc = toxicity.grams_of(buf, offsets)
    want = []
    for i, t in enumerate(texts):
        raw = b" " + b"".join(w + b" " for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
        want += [(i, int.from_bytes(raw[k : k + 5], "big")) for k in range(len(raw) - 4)]
    assert list(zip(doc.tolist(), gram.tolist(), strict=True)) == want


def test_toxicity_odd_inputs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (11, None), (None, 1), (10, 0)], "doc_id long, toxic int")
    space = Workspace(spark, "t11")
    model = toxicity.fit(*toxicity.samples(odd_docs, labels, space))
    rows = toxicity.score(odd_docs, model, ["doc_id"]).collect()
    assert len(rows) == 15 and len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    none = toxicity.fit(*toxicity.samples(odd_docs, labels.filter("toxic = 0"), Workspace(spark, "t11b")))
    assert {r.score for r in toxicity.score(odd_docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(no_docs, model, ["doc_id"]).count() == 0
    empty = toxicity.fit(*toxicity.samples(no_docs, labels, Workspace(spark, "t11c")))
    assert empty.prior == 0
    long = spark.createDataFrame([(1, "word " * 400_000 + "idiot"), (2, "word")], "doc_id long, text string")
    assert toxicity.score(long, model, ["doc_id"]).count() == 2


# --- 12: conversation repair


def cheapest(turns):
    """All edits of a few turns (initial, fault): the least cost and the ASCII-least audit among them."""
    best = None
    between = ["", "u", "a", "ua", "au"]
    for way in itertools.product(*([("D", "", 4)] if f in (1, 2) else [("D", "", 4), ("K", r, 3 * (f == 3)), ("R", "u", 3 + 3 * (f == 3)), ("R", "a", 3 + 3 * (f == 3))] for r, f in turns)):
        for put in itertools.product(between, repeat=len(turns) + 1):
            said = "".join(put[i] + w[1] for i, w in enumerate(way)) + put[-1]
            if re.fullmatch("(s?(ua)+)?", said):
                audit = "".join("I" * len(put[i]) + w[0] for i, w in enumerate(way)) + "I" * len(put[-1])
                key = (sum(w[2] for w in way) + 3 * sum(map(len, put)), audit)
                best = key if best is None else min(best, key)
    return best


def test_cheapest_edits_against_all_edits():
    rnd = random.Random(4)
    for _ in range(120):
        turns = [(rnd.choice("suuaax"), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 3))]
        plan = repair.Plan()
        for i, (initial, fault) in enumerate(turns):
            plan.add(i, initial, fault)
        counts, audit = plan.result()
        assert (counts[-1], audit) == cheapest(turns), turns


def test_state_does_not_grow_with_alternatives():
    """A hundred thousand turns of one role: two ways stay open to the end."""
    plan = repair.Plan()
    for i in range(100_000):
        plan.add(i, "u", 0)
    counts, audit = plan.result()
    assert len(plan.best) <= 4 and counts[-1] == 3 * 50_000 and audit.count("K") + audit.count("R") == 100_000


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_repair_equals_sql(spark, sf):
    assert parity.compare(repair.op12_conversation_repair(spark, sf), parity.connect(sf), repair.ORACLE["op12_conversation_repair"])


def odd_turns(spark):
    c = ["c"] * 5
    rows = [
        (1, 0, "user", "Hi there.", *c), (1, 1, "assistant", "Hello. \n", *c), (1, 1, "assistant", "Hello. \n", *c), (1, None, "system", "Be kind.", *c),
        (2, 5, None, None, *c), (2, 9, "user", " \t", *c), (None, 0, "user", "No id?", *c), (None, 1, "assistant", "cut", *c),
        (3, None, "user", "x!", *c), (3, None, "user", "y!", *c), (4, 0, "", "", *c), (5, 0, "assistant", "long " * 300_000 + "end.", *c),
    ]
    return spark.createDataFrame(rows, TURNS)


def test_repair_odd_rows(spark):
    rows = repair.judged(odd_turns(spark))
    plans = Workspace(spark, "t12").save(repair.plan(rows), "plans")
    got = {r.conv: r for r in plans.collect()}
    assert {k: (got[k].gaps, got[k].blank, got[k].duplicate, got[k].truncated, got[k].illegal, got[k].cost, got[k].audit) for k in got} == {
        1: (0, 0, 1, 0, 1, 4, "KKKD"), 2: (3, 2, 0, 0, 1, 8, "DD"), None: (0, 0, 0, 1, 0, 3, "KK"), 3: (0, 0, 0, 0, 1, 3, "KR"), 4: (0, 1, 0, 0, 0, 4, "D"), 5: (0, 0, 0, 0, 0, 3, "IK"),
    }
    turns = repair.apply(rows, plans).orderBy("conv", "position").collect()
    said = {}
    for t in turns:
        said.setdefault(t.conv, []).append((t.edit, t.role, t.text[:9]))
    assert said == {
        None: [("K", "user", "No id?"), ("K", "assistant", "cut")], 1: [("K", "system", "Be kind."), ("K", "user", "Hi there."), ("K", "assistant", "Hello. \n")],
        3: [("K", "user", "y!"), ("R", "assistant", "x!")], 5: [("I", "user", ""), ("K", "assistant", "long long")],
    }
    digests = {r.conv: r.repaired_sha256 for r in repair.apply(rows, plans, repair.Digest).collect()}
    for conv in got:
        lines = "\n".join(f"{t.role}:{t.text}" for t in turns if t.conv == conv)
        assert digests[conv] == hashlib.sha256(lines.encode()).hexdigest()


def test_repair_without_rows(spark):
    rows = repair.judged(spark.createDataFrame([], TURNS))
    assert repair.apply(rows, repair.plan(rows), repair.Digest).count() == 0
    gone = repair.judged(odd_turns(spark), gone=F.lit(True))
    got = repair.apply(gone, repair.plan(gone), repair.Digest).collect()
    assert len(got) == 6 and {(r.cost, r.audit, r.repaired_sha256) for r in got} == {(0, "", hashlib.sha256(b"").hexdigest())}


# --- 13: periodic runs


def plain_runs(w, shortest=12):
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(shortest, 2 * p):
                best.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_row(doc_id, text):
    w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n_},{p}\n" for s, n_, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_against_all_periods():
    rnd, codes = random.Random(2), T.mix(np.arange(1, 9).astype(np.uint64))
    for _ in range(700):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            k = rnd.choice([1, 2, 2, 3, 5])
            w = [rnd.randrange(k) for _ in range(rnd.randint(0, 60))]
            q = [rnd.randrange(k) for _ in range(rnd.randint(1, 9))]
            docs.append(w[:10] + q * rnd.choice([0, 2, 3, 6]) + q[: rnd.randint(0, len(q))] + w[10:])
        first = np.cumsum([0] + [len(d) for d in docs])
        got = runs.runs_of(codes[np.array([x for d in docs for x in d], int)], first)
        assert sorted(map(tuple, got.tolist())) == sorted((s + first[i], s + first[i] + n, p) for i, d in enumerate(docs) for s, n, p in plain_runs(d)), docs


def test_runs_where_hashes_deceive():
    """Thue-Morse words: different stretches have equal polynomial hashes modulo 2**64."""
    w = [0]
    while len(w) < 4096:
        w += [1 - x for x in w]
    code = np.array([11, 7919], np.uint64)[np.array(w)]
    want = runs.periods(np.array(runs.plain_runs(code, 0, len(w))))
    assert len(want) > 500 and sorted(runs.runs_of(code, np.array([0, len(w)])).tolist()) == sorted(want.tolist())


@pytest.mark.parametrize("sf", [SMALL])
def test_runs_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in runs.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text or "") < 12_000:
            assert got[d.doc_id] == plain_row(d.doc_id, d.text)


def test_runs_odd_rows(spark, odd_docs, no_docs):
    got = runs.collapse_runs(odd_docs, ["doc_id", "slot"])
    assert got.columns == ["doc_id", "slot", "n_words", "runs", "collapsed"] and got.count() == 15
    by = {r.doc_id: r for r in got.collect()}
    assert all((by[i].n_words, by[i].runs, by[i].collapsed) == (0, [], "") for i in (2, 3, 4))
    assert by[7].collapsed == "été déjà où çà naïve"
    assert runs.collapse_runs(no_docs, ["doc_id"]).count() == 0
    long = " ".join(f"w{i % 50_000}" for i in range(350_000))
    tied = " ".join(["a"] * 12 + ["b"] + ["c"] * 12)
    docs = spark.createDataFrame([(1, long), (2, tied), (2, tied)], "doc_id long, text string")
    rows = runs.collapse_runs(docs, ["doc_id"]).withColumn("best", runs.longest(F.col("runs"))).orderBy("doc_id").collect()
    assert [(r.start, r.length, r.period) for r in rows[0].runs] == [(0, 350_000, 50_000)] and rows[0].collapsed.count(" ") == 49_999
    assert rows[1] == rows[2] and rows[1].best.start == 0 and rows[1].collapsed == "a b c"
