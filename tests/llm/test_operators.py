"""The operators against SQL, brute force, exact round trips and held-out labels."""

import collections
import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from opsloom.llm import components, decontamination, ngram_join, quality_rules, registry, sharding, substring_dedup, text, token_store
from opsloom.llm.workspace import Workspace
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, con, name):
    compare(registry.queries()[name](spark, sf), con, registry.oracle_sql()[name])


def test_registry_has_all_eleven():
    names = registry.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert len(corpus_pipeline.STAGES) == 5


def test_lookup_table_by_turns():
    """The same table filled naively: each shard in turn takes the first free slot of its whole permutation."""
    shards, slots = [f"s{i}" for i in range(7)], 101
    orders = []
    for s in shards:
        o, k = sharding.preference(s, slots)
        orders.append(iter([(o + j * k) % slots for j in range(slots)]))
    table, turn = {}, 0
    while len(table) < slots:
        for slot in orders[turn % 7]:
            if slot not in table:
                table[slot] = turn % 7
                break
        turn += 1
    got = sharding.lookup_table(shards, slots)
    assert [table[i] for i in range(slots)] == got.tolist()
    counts = np.bincount(got)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(shards[:-1], slots)
    assert (fewer[got != 6] != got[got != 6]).mean() < 0.35
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, slots)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_placement(spark, sf):
    table = sharding.lookup_table()
    for r in registry.queries()["op2_sharding"](spark, sf).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])


def test_tokens_round_trip(spark, sf, con):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_store.default_tokenizer())
    got = {r.doc_id: r for r in registry.queries()["op3_token_store"](spark, sf).collect()}
    at = 0
    for i, t in con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_encoder_on_odd_texts():
    texts = ["İstanbul ŉ ǰ ßß Ǆ", "", None, "  ", "a b c\x1cd 's don't x\n\t\r\r\n y<|endoftext|>z <|startoftext|> é é 1234 ... ̀x ́", "Word. word, WORD! wórd. ...", "a b c", "日本語 テスト。", "x" * 500]
    e = token_store.ChunkEncoder(token_store.default_tokenizer())
    ids, n = e.encode(pa.array(texts))
    edge = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert ids[edge[k] : edge[k + 1]].tolist() == [*e.model.encode(t or "", add_special_tokens=False).ids, 1]


def test_token_files_keep_their_format(spark, sf):
    import glob

    import pyarrow.parquet as pq

    space = Workspace(spark, "fmt")
    token_store.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), space, parts=2)
    files = sorted(glob.glob(space.path("tokens").removeprefix("file://") + "/*.parquet"))
    last = -1
    for f in files:
        meta = pq.ParquetFile(f)
        ids = meta.read(["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
        column = {meta.metadata.row_group(0).column(i).path_in_schema: meta.metadata.row_group(0).column(i) for i in range(meta.metadata.num_columns)}
        assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and any("DICTIONARY" in e for e in column["tokens.list.element"].encodings)
        assert column["doc_id"].has_column_index


def naive_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_against_full_table():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = (rng.integers(0, 5, n).astype(np.uint64) for n in rng.integers(1, 30, 2))
        assert decontamination.align(a, b)[0] == naive_alignment(a.tolist(), b.tolist())


def test_decontamination_against_all_alignments(spark, sf, con):
    """Every document against every item, whole, on a third of the documents."""
    import re

    words = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (t or "").lower()).split()
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    docs = con.sql("SELECT doc_id, text FROM documents WHERE length(text) < 3000 AND doc_id % 3 = 0").fetchall()
    got = {(r.doc_id, r.item_id): r.score for r in registry.queries()["op4_decontamination"](spark, sf).collect()}
    ids = {}
    code = lambda t: np.array([ids.setdefault(w, len(ids)) for w in words(t)], np.uint64)
    coded = [(i, code(t)) for i, t in items]
    for d, t in docs:
        w = code(t)
        for i, item in coded:
            if 2 * np.isin(item, w).sum() < len(item):
                assert (d, i) not in got
                continue
            score = decontamination.align(item, w)[0] / (2 * len(item))
            if score >= 0.5:
                assert got[d, i] == pytest.approx(score)
            else:
                assert (d, i) not in got


def test_decontamination_finds_edited_copies(spark, con):
    items = con.sql("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 20").fetchall()
    rng = np.random.default_rng(3)
    rows = []
    for i, t in items:
        w = t.split()
        for k in range(len(w)):
            if rng.random() < 0.2:
                w[k] = f"edited{k}"
        rows.append((i, "before it stands something else altogether " * 5 + " ".join(w) + " and then it goes on" * 9))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {i for i, _ in items} - {d for d, i in got if d == i} == set()
    assert decontamination.contaminated(spark.createDataFrame([(1, "nothing of the kind is here " * 30)], "doc_id long, text string"), bench).count() == 0


def test_alignment_finds_where():
    """The reported place holds an alignment of the reported score, in windows as in the whole text."""
    rng = np.random.default_rng(11)
    for _ in range(30):
        item, text = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(0, 6, 400).astype(np.uint64)
        text[150:162] = item
        text[153] = 99
        score, s, e = decontamination.align(item, text)
        assert decontamination.align(item, text[s:e])[0] == score == naive_alignment(item.tolist(), text.tolist())
        assert decontamination.matches(text, [(k, k % 12) for k in range(388)], item, 0.5)[0] == score / 24


def test_long_text_with_seeds_throughout(spark):
    """A text of 1.5 million characters made of an item's own words, in another order but for one edited copy."""
    item = [f"word{i}" for i in range(40)]
    rng = np.random.default_rng(12)
    noise = [item[i] for i in rng.integers(0, 40, 240_000)]
    copy = list(item)
    copy[5::6] = ["edited"] * len(copy[5::6])
    text = " ".join(noise[:200_000] + copy + noise[200_000:])
    got = decontamination.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert len(got) == 1 and got[0].item_id == 7 and 199_990 <= got[0].first_word <= 200_005 and got[0].score >= (2 * 34 - 6) / 80


def test_equal_scores_report_the_first_place(spark):
    item = "alpha beta gamma delta epsilon zeta"
    text = f"{item} {'x y z ' * 40}{item}"
    got = decontamination.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.score, r.first_word, r.end_word) for r in got] == [(1.0, 0, 6)]


@pytest.mark.parametrize("percent,least", [(10, 1.0), (20, 1.0), (30, 0.95), (40, 0.85)])
def test_recall_by_edits(spark, con, percent, least):
    """Of edited copies that a full alignment scores 0.5 and more, how many are found."""
    items = con.sql("SELECT item_id, text FROM benchmark ORDER BY item_id").fetchall()
    rng, rows, want, ids = np.random.default_rng(percent), [], set(), {}
    code = lambda ws: np.array([ids.setdefault(w, len(ids)) for w in ws], np.uint64)
    words = lambda t: __import__("re").sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", t.lower()).split()
    for i, t in items:
        for k in range(3):
            w = words(t)
            edits = rng.random(len(w)) < percent / 100
            out = []
            for x, e in zip(w, edits, strict=True):
                kind = rng.integers(0, 3) if e else -1
                out += [x] if kind < 0 else [f"new{rng.integers(10**6)}"] if kind == 0 else [] if kind == 1 else [x, f"more{rng.integers(10**6)}"]
            text = ["before", "it", *out, "after", "all"]
            rows.append((100 * i + k, " ".join(text)))
            if decontamination.align(code(w), code(text))[0] >= len(w):
                want.add((100 * i + k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench).collect()}
    recall = len(want & got) / len(want)
    print(f"{percent} % of words edited: {len(want)} copies of score 0.5 and more, recall {recall:.3f}")
    assert recall >= least


def test_exact_binomial_bound(spark):
    from math import comb

    from pyspark.sql import functions as F

    for n, a, d in ((10, 0.1, 0.05), (150, 0.05, 0.01), (500, 0.01, 0.001), (3000, 0.02, 1e-6)):
        got = spark.createDataFrame([(n,)], "n long").select(quality_rules.most_rejections(F.col("n"), F.lit(a), F.lit(d)).alias("k")).first().k
        total, want = 0.0, -1
        for k in range(n + 1):
            total += comb(n, k) * a**k * (1 - a) ** (n - k)
            if total > d:
                break
            want = k
        assert got == want


def test_rules_reject_junk_and_keep_good(spark):
    good = [(i, f"alpha{i} beta gamma{i * 7} delta epsilon{i} zeta eta{i + 3} theta iota{i} kappa lambda", "en") for i in range(2000)]
    junk = [(i, "word%%% other### thing&&& more*** text$$$ here%%% and### there&&& again*** stop$$$", "en") for i in range(2000, 2020)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 2000, 2)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels, "rj")
    assert got.filter("doc_id >= 2000 and kept").count() == 0 and got.filter("doc_id < 2000 and not kept").count() <= 100


def test_rules_with_binding_cutoffs_against_sql(spark, tmp_path):
    """Two languages with thousands of good documents: cutoffs reject what passes the base rules, and SQL agrees on every row."""
    rng = np.random.default_rng(15)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    docs, labels = [], []
    for i in range(5000):
        w = [word() for _ in range(rng.integers(12, 40))]
        if i % 50 == 0:
            w = [x + "%$" for x in w]
        elif i % 50 == 1:
            w = [x.upper() for x in w]
        elif i % 50 == 2:
            w = ["\n".join(w[:6] + w[:1] * 6), *w]
        docs.append((i, " ".join(w), "en" if i % 2 else "fr", "a", 0))
        if i % 50 > 2:
            labels.append((i, 1, 0))
    for rows, schema, name in ((docs, "doc_id long, text string, lang string, source string, n_chars long", "documents"), (labels, "doc_id long, quality int, toxic int", "labels")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    compare(registry.queries()["op5_quality_rules"](spark, str(tmp_path)), con, registry.oracle_sql()["op5_quality_rules"])
    got = registry.queries()["op5_quality_rules"](spark, str(tmp_path)).filter("not base_failed").toPandas()
    marked = got.doc_id % 50 <= 1
    assert not got[marked].kept.any() and got[~marked & (got.doc_id % 50 > 2)].kept.mean() > 0.95


def test_field_against_enumeration():
    """Marginals, pair sums and log Z of short documents against all sequences of states."""
    import itertools

    from opsloom.llm import line_quality

    rng = np.random.default_rng(16)
    for _ in range(20):
        sizes = rng.integers(0, 7, 4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        unary, step = rng.normal(0, 2, (first[-1], 2)), rng.normal(0, 1, (2, 2))
        p, pair, log_z = line_quality.marginals(unary, step, first)
        pairs = np.zeros((2, 2))
        for d, n in enumerate(sizes):
            if not n:
                continue
            weight, here, both = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
            for states in itertools.product((0, 1), repeat=int(n)):
                w = np.exp(sum(unary[first[d] + t, s] for t, s in enumerate(states)) + sum(step[a, b] for a, b in zip(states, states[1:], strict=False)))
                weight += w
                for t, s in enumerate(states):
                    here[t, s] += w
                for a, b in zip(states, states[1:], strict=False):
                    both[a, b] += w
            assert np.allclose(p[first[d] : first[d + 1]], here / weight) and np.isclose(log_z[d], np.log(weight))
            pairs += both / weight
        assert np.allclose(pair, pairs)


def test_line_scores_do_not_depend_on_neighbours():
    """A text's score is its own, whatever block it is scored in; ties and repeats score alike."""
    from opsloom.llm import line_quality

    rng = np.random.default_rng(17)
    good = ["\n".join(" ".join(rng.choice(["the", "river", "runs", "by", "our", "old", "house"], 9)) + "." for _ in range(6)) for _ in range(40)]
    bad = ["\n".join("BUY $$$ NOW!!! 99% ### " * 2 for _ in range(5)) for _ in range(40)]
    field = line_quality.fit(good + bad, [1] * 40 + [0] * 40)
    texts = [*good[:5], None, "", *bad[:5], good[0], "x\n" * 3000]
    whole = np.concatenate([field.score(x) for x in line_quality.lines_of_column(pa.array(texts))])
    alone = [field.score(next(line_quality.lines_of_column(pa.array([t], pa.string()))))[0] for t in texts]
    assert np.allclose(whole, alone) and whole[0] == pytest.approx(whole[12]) and (whole[:5] > 0.7).all() and (whole[7:12] < 0.3).all()


def test_language_model_against_plain_python():
    """TF-IDF, FTRL with its penalties and the scores, number by number, without arrays."""
    import math

    from opsloom.llm import language_id as L

    texts = ["the old house", "la vieille maison", "das alte haus", "the river runs", "la riviere coule", "der fluss geht", "an old river", "une maison", "ein haus", "by the house", "la la la", "", "das das"]
    langs = ["en", "fr", "de", "en", "fr", "de", "en", "fr", "de", "en", "fr", "de", "de"]
    model = L.fit(texts, langs, epochs=2)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    rows = [dict(zip(s.tolist(), v.tolist(), strict=True)) for s, v in map(L.counts, texts)]
    df = collections.Counter(k for r in rows for k in r)
    idf = lambda k: math.log((1 + len(rows)) / (1 + df[k])) + 1
    x = [{k: v * idf(k) * L.SCALE for k, v in r.items()} for r in rows]
    names = sorted(set(langs))
    bias = [math.log(langs.count(c) / len(langs)) for c in names]
    z, n = collections.defaultdict(lambda: [0.0] * 3), collections.defaultdict(lambda: [0.0] * 3)

    def weight(k, c):
        return 0.0 if abs(z[k][c]) <= l1 else -(z[k][c] - math.copysign(l1, z[k][c])) / ((beta + math.sqrt(n[k][c])) / alpha + l2)

    def shares(row):
        e = [math.exp(b + sum(v * weight(k, c) for k, v in row.items())) for c, b in enumerate(bias)]
        return [v / sum(e) for v in e]

    order, rng = np.array([i for i in range(len(texts)) if i % 5 != 4]), np.random.default_rng(7)
    for _ in range(2):
        rng.shuffle(order)
        for i in order.tolist():
            p, w = shares(x[i]), {k: [weight(k, c) for c in range(3)] for k in x[i]}
            for k, v in x[i].items():
                for c, name in enumerate(names):
                    g = v * (p[c] - (langs[i] == name))
                    z[k][c] += g - (math.sqrt(n[k][c] + g * g) - math.sqrt(n[k][c])) / alpha * w[k][c]
                    n[k][c] += g * g
    for k in df:
        assert model.table[k] == pytest.approx([weight(k, c) * idf(k) * L.SCALE for c in range(3)], rel=1e-4, abs=1e-6)
    for t, row in zip(texts, x, strict=True):
        if row:
            e = [v ** (1 / model.temperature) for v in shares(row)]
            assert model.predict(t)[0] == names[int(np.argmax(e))] and model.predict(t)[1] == pytest.approx(max(e) / sum(e), rel=1e-4)
    assert model.predict("") == ("und", 0.0)


def test_line_quality_on_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = registry.queries()["op6_line_quality"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(rows) > 50 and ((rows.predicted == rows.quality).mean()) > 0.95


def test_language_on_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = registry.queries()["op7_language_id"](spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97 and rows.score.between(0, 1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    got = {r.id: r.component for r in components.connected(Workspace(spark, "cc"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 100}


def test_near_copies_of_one_text(spark):
    """A group of copies with edits, most of them near each other, against all pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 6)):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 4, 85, "nc").collect()}
    sets = [{tuple(t.split()[j : j + 4]) for j in range(117)} for _, t in rows]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))


def brute_repeats(texts, length):
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append((bytes(x for x, c in zip(b, cover, strict=True) if not c), sum(cover), sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))))
    return out


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdé"), n))
    shared = [word(90) for _ in range(4)]
    texts = ["", "a" * 500, "ab" * 120, *(word(50) + shared[k % 4][: 60 + k] + word(40) + shared[(k + 1) % 4] + word(30) for k in range(25)), word(400)]
    texts += [texts[5], texts[6][10:], texts[7] + texts[8]]
    for length in (32, 64, 100):
        got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, "bf", keep_text=True).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], length)


def brute_passages(texts, length):
    """Words inside windows of ``length`` words that another document holds too."""
    words = [t.split() for t in texts]
    holders = collections.defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            holders[tuple(w[i : i + length])].add(d)
    out = []
    for w in words:
        cover = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if len(holders[tuple(w[i : i + length])]) > 1:
                cover[i : i + length] = b"\1" * length
        out.append(sum(cover))
    return out


def test_passages_against_brute_force(spark):
    """Passages that other documents share count, whatever the blanks between their words; those repeated in one document alone do not."""
    rng = np.random.default_rng(10)
    some = lambda n: [f"w{i}" for i in rng.integers(0, 30, n)]
    shared = [some(40) for _ in range(4)]
    texts = ["", "one two", "a " * 60, "b " * 60, "  a\t" * 30]
    texts += ["\n ".join(some(20) + shared[k % 4][: 8 + k] + some(15) + shared[(k + 1) % 4][k % 7 :] + some(9)) for k in range(25)]
    alone = some(30)
    texts += [" ".join(alone + some(12) + alone), texts[6], " ".join(texts[7].split()[5:])]
    for length in (9, 14, 33):
        got = {r.doc_id: r.n_passage_words for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64, "bp", passage_words=length).collect()}
        assert [got[i] for i in range(len(texts))] == brute_passages(texts, length)


def test_phrases_cover_all_starts():
    rng = np.random.default_rng(2)
    parts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 39, 40, 41, 300, 1000)]
    buf, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    p = substring_dedup.parse(text.prefix_hashes(buf), offsets, 40)
    starts = sorted(x for lo, hi in zip(p.low, p.high, strict=True) for x in range(lo, hi + 1))
    assert starts == [o + i for o, n in zip(offsets, (len(x) for x in parts), strict=False) for i in range(n - 39)]
    assert ((p.trigger >= p.high) & (p.trigger < p.low + 20)).all()


def test_pipeline_whole(spark, sf, con):
    """Each decision of the whole run against brute force or the operators' own tests: copies go, benchmark goes, the mix repeats rows twice at most."""
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert len(got) and got["doc_id"].value_counts().max() <= 2 and got["shard"].notna().all()
    pairs = {r.doc_id for r in registry.queries()["op4_decontamination"](spark, sf).collect()}
    assert not pairs & set(got["doc_id"])
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    kept = sorted(set(got["doc_id"]))
    shingle = {d: {tuple(w[i : i + 5]) for w in [texts[d].lower().split()] for i in range(max(1, len(w) - 4))} for d in kept}
    for i, a in enumerate(kept):
        for b in kept[:i]:
            both = len(shingle[a] & shingle[b])
            assert 100 * both < 80 * (len(shingle[a]) + len(shingle[b]) - both)
