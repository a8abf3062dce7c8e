"""Every operator on odd rows and on empty tables; results as the docstrings define them."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import content_archive, decontamination, language_id, line_quality, ngram_join, quality_rules, sharding, source_mixing, substring_dedup, token_store
from opsloom.llm.workspace import Workspace

BENCH = "item_id long, text string, doc_id string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def archived(spark, df):
    space = Workspace(spark, "t1")
    content_archive.write_archive(df, space, "doc_id", "lang", "text")
    return content_archive.parse_records(content_archive.read_archive(space))


def test_archive(spark, odd_docs, no_docs):
    got = archived(spark, odd_docs).collect()
    assert len(got) == 15
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    empty = by["3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"]
    assert sorted((r.record_id or -1, r.record_type, r.refers_to) for r in empty) == [(-1, "revisit", 3), (2, "revisit", 3), (3, "response", None)]
    base = [r for r in got if r.payload_bytes == 105 or (r.refers_to == 11)]
    assert {r.record_id for r in base if r.record_type == "response"} <= {11}
    assert archived(spark, no_docs).count() == 0


def test_archive_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "doc_id long, lang string, text string")
    space = Workspace(spark, "t1b")
    content_archive.write_archive(df, space, "doc_id", "lang", "text", min_bytes=5)
    got = rows(content_archive.parse_records(content_archive.read_archive(space)), "record_id", "record_type", "refers_to")
    assert got == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    assert space.read("payloads").count() == 2


def test_warc_file_round_trip(spark, odd_docs):
    space = Workspace(spark, "t1c")
    content_archive.write_archive(odd_docs, space, "doc_id", "lang", "text")
    records = content_archive.read_archive(space)
    whole = b"".join(r.member for r in content_archive.export_warc(records).collect())
    assert sorted(content_archive.split_warc(whole)) == sorted(bytes(r.record) for r in records.collect())
    plain = b"".join(sorted(bytes(r.record) for r in records.collect()))
    assert len(list(content_archive.split_warc(plain))) == 15


def test_archive_urls_with_line_breaks(spark):
    """A url can neither end its header line nor forge another; it comes back as it was, and so does one that is only like an escape."""
    urls = ["http://a/\r\nWARC-Type: response\r\n\r\nx", "http://b/%0D%0A?\n%25", "http://c/%0D%0A", "\r", "plain: with colon ", None, ""]
    df = spark.createDataFrame([(i, u, f"body {i}") for i, u in enumerate(urls)], "doc_id long, lang string, text string")
    got = archived(spark, df).orderBy("record_id").collect()
    assert [r.target_uri for r in got] == urls and [r.payload for r in got] == [f"body {i}".encode() for i in range(len(urls))]
    assert {r.record_type for r in got} == {"response"}


def test_revisits_without_body(spark):
    df = spark.createDataFrame([(1, "u", "same text"), (2, "u", "same text")], "doc_id long, lang string, text string")
    space = Workspace(spark, "t1d")
    content_archive.write_archive(df, space, "doc_id", "lang", "text")
    members = [r.member for r in content_archive.export_warc(content_archive.read_archive(space), bodies=False).collect()]
    got = {r["record_id"]: r for r in map(content_archive.parse_record, content_archive.split_warc(b"".join(members)))}
    assert (got[1]["record_type"], got[1]["payload"], got[1]["refers_to"]) == ("revisit", b"", 2) and got[2]["payload"] == b"same text"


def test_sharding(odd_docs, no_docs):
    got = sharding.place(odd_docs)
    assert got.columns[-2:] == ["slot", "shard"] and len(got.columns) == len(odd_docs.columns)
    assert got.filter("shard is null").count() == 0
    assert got.filter("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.place(odd_docs, key="slot").filter("shard is null").count() == 0
    assert sharding.place(no_docs).count() == 0


def test_tokens(spark, odd_docs, no_docs):
    space = Workspace(spark, "t3")
    token_store.write_tokens(odd_docs, space)
    got = token_store.read_tokens(space).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens) and r.tokens[-1] == 1
        at += r.n_tokens
    assert got[4].tokens == [1]
    empty = Workspace(spark, "t3e")
    token_store.write_tokens(no_docs, empty)
    assert token_store.read_tokens(empty).count() == 0


def test_decontamination(spark, odd_docs, no_docs):
    base = "quick brown fox jumps over the lazy dog and runs far away"
    bench = spark.createDataFrame([(1, base, "x"), (1, base, "x"), (2, None, "x"), (3, "", "x"), (4, "zzz", "x"), (None, "x", "x")], BENCH)
    got = decontamination.contaminated(odd_docs, bench)
    assert {r.doc_id for r in got.filter("item_id = 1").collect()} == {None, 1, 6, 10, 11}
    assert {(r.doc_id, r.score) for r in got.filter("item_id is null").collect()} == {(9, 1.0)}
    assert decontamination.contaminated(no_docs, bench).count() == 0
    assert decontamination.contaminated(odd_docs, bench.limit(0)).count() == 0
    kept = decontamination.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {None, 2, 3, 4, 5, 7, 8, 11}


def test_quality_rules(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(odd_docs, labels, "t5")
    assert got.count() == 15
    assert got.filter("doc_id = 2").first().n_words == 0 and not got.filter("doc_id = 2").first().kept
    assert got.filter("doc_id = 6").first().kept
    assert quality_rules.judge(no_docs, labels, "t5e").count() == 0
    assert quality_rules.judge(odd_docs, labels.limit(0), "t5n").filter("kept = base_failed").count() == 0


def test_line_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    field = line_quality.fit(*line_quality.fit_sample(odd_docs, labels))
    got = line_quality.score(odd_docs.drop("score", "predicted"), field, ["doc_id"])
    assert got.count() == 15 and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert {r.score for r in got.filter("doc_id in (2, 3, 4)").collect()} == {0.0}
    untrained = line_quality.fit(*line_quality.fit_sample(no_docs, labels))
    assert {r.score for r in line_quality.score(odd_docs.drop("score"), untrained, ["doc_id"]).filter("doc_id = 1").collect()} == {0.5}
    assert line_quality.score(no_docs, field, ["doc_id"]).count() == 0


def test_language_id(odd_docs, no_docs):
    model = language_id.fit(*language_id.fit_sample(odd_docs))
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd_docs, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (8, "und"), (1, "en")} <= got
    nothing = language_id.fit(*language_id.fit_sample(no_docs))
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}
    assert language_id.accepted(no_docs).columns == no_docs.columns
    assert language_id.predict(no_docs, model).count() == 0


def test_mixing(odd_docs, no_docs):
    plan = source_mixing.mix_plan(odd_docs, "t8")
    assert plan.count() == 15 and plan.filter("taken < 0 or taken > 2 * size").count() == 0
    assert plan.filter("doc_id in (2, 3, 4)").agg(F.sum("taken")).first()[0] == 0
    assert source_mixing.mix_rows(odd_docs, "t8r").columns == odd_docs.columns
    total = plan.agg(F.sum("taken")).first()[0]
    assert source_mixing.mix_rows(odd_docs, "t8s").select(F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))).first()[0] == total
    assert source_mixing.mix_plan(no_docs, "t8e").count() == 0


def test_ngram_join(odd_docs, no_docs):
    got = ngram_join.jaccard_components(odd_docs, 4, 85, "t9")
    comp = {(r.doc_id, r.n_shingles): r.component_id for r in got.collect()}
    assert {comp[k] for k in comp if k[0] in (1, 6, 10) or (k[0] == 11 and k[1] > 5)} == {1}
    assert comp[2, 0] == 2 and comp[3, 0] == 3 and comp[9, 1] == 9 and comp[None, 0] is None
    assert ngram_join.jaccard_components(no_docs, 4, 85, "t9e").count() == 0
    assert ngram_join.one_of_each(no_docs).count() == 0


def test_ngram_join_of_repeated_ids(spark):
    """An id with two texts joins the classes of both; a row without words stays alone."""
    a, b, c = "a b c d e f g", "x y z w v u", "k l m n o p q r"
    df = spark.createDataFrame([(2, a), (5, a), (3, b), (5, b), (2, c), (7, c), (9, "q"), (9, None)], "doc_id long, text string")
    got = rows(ngram_join.jaccard_components(df, 4, 85, "t9i"), "doc_id", "n_shingles", "component_id")
    assert got == [(2, 4, 2), (2, 5, 2), (3, 3, 2), (5, 3, 2), (5, 4, 2), (7, 5, 2), (9, 0, 9), (9, 1, 9)]


def test_substring_dedup(odd_docs, no_docs):
    got = substring_dedup.remove_repeats(odd_docs, 64, "t10", keep_text=True).collect()
    assert len(got) == 15
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept) and r.n_spans == len(r.spans)
    assert {r.n_removed for r in got if r.doc_id == 6} == {next(x.n_bytes for x in got if x.doc_id == 6)}
    assert substring_dedup.remove_repeats(no_docs, 64, "t10e").count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(no_docs, 20)


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path, k):
    """The rows that each stage leaves of the odd documents, as the pipeline's docstring defines them."""
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", None)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd_docs, no_docs):
        got = stage(spark, docs, str(tmp_path))
        got.write.parquet(f"{tmp_path}/{name}-{docs is odd_docs}")
        assert set(docs.columns) <= set(got.columns)
        assert (got.columns == docs.columns) or k == 4
    assert spark.read.parquet(f"{tmp_path}/{name}-False").count() == 0
    kept = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/{name}-True").collect()]
    every = [(r.doc_id, r.text) for r in odd_docs.collect()]
    base = next(t for i, t in every if i == 1)
    ids = sorted(i if i is not None else -1 for i, _ in kept)
    if name == "language_id":
        assert set(kept) <= set(every) and not set(ids) & {2, 3, 4, 8} and (None, None) not in kept
        assert kept.count((1, base)) in (0, 2)  # repeated rows are judged alike
    elif name == "ngram_jaccard_join":
        assert ids == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9]
    elif name == "decontamination":
        assert sorted(kept, key=repr) == sorted((x for x in every if not (x[1] or "").startswith(base)), key=repr)
    elif name == "source_mixing":
        assert not set(ids) & {2, 3, 4} and all(kept.count(x) <= 2 * every.count(x) for x in kept)
    else:
        assert sorted(kept, key=repr) == sorted(every, key=repr)


def test_one_very_long_text(spark):
    """Two megabytes in one row, with its copy and short rows beside it, through the operators that read whole texts."""
    rng = np.random.default_rng(21)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(5000)])
    text = " ".join(words[rng.integers(0, 5000, 345_000)])
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (3, "a few words of another kind stand here by themselves today", "fr", "b"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = len(text.encode())
    assert size > 2_000_000
    comp = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 4, 85, "vl9").collect()}
    assert comp == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r.doc_id: (r.n_removed, r.n_spans, r.n_passage_words) for r in substring_dedup.remove_repeats(docs, 400, "vl10").collect()}
    assert cut == {1: (size, 1, 345_000), 2: (size, 1, 345_000), 3: (0, 0, 0), 4: (0, 0, 0)}
    space = Workspace(spark, "vl3")
    token_store.write_tokens(docs, space)
    n = {r.doc_id: r.n_tokens for r in token_store.read_tokens(space).select("doc_id", "n_tokens").collect()}
    assert n[1] == n[2] > 345_000 and n[4] == 1
    stats = {r.doc_id: r.n_words for r in quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "vl5").collect()}
    assert stats == {1: 345_000, 2: 345_000, 3: 11, 4: 0}
    taken = {r.doc_id: r.taken for r in source_mixing.mix_plan(docs, "vl8").collect()}
    assert taken[4] == 0 and all(taken[i] in (0, s, 2 * s) for i, s in ((1, 345_000), (2, 345_000), (3, 11)))
    model = language_id.fit(*language_id.fit_sample(docs))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}[1] == "en"


def test_ties(spark):
    """Equal scores, sizes and hashes: the same answer for the same row, and one that does not depend on partitions."""
    docs = spark.createDataFrame([(i, "one two three four five six seven", "en" if i % 2 else "fr", "a") for i in range(12)], "doc_id long, text string, lang string, source string")
    model = language_id.fit(*language_id.fit_sample(docs))
    assert len({(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}) == 1
    plans = [{(r.doc_id, r.taken) for r in source_mixing.mix_plan(docs.repartition(n), f"tie{n}").collect()} for n in (1, 5)]
    assert plans[0] == plans[1] and len(plans[0]) == 12
    repeated = docs.unionByName(docs)
    assert {n for n in repeated.groupBy("doc_id").count().toPandas()["count"]} == {2}
    twice = source_mixing.mix_plan(repeated, "tie-r").groupBy("doc_id").agg(F.countDistinct("taken").alias("n"), F.count("*").alias("c")).collect()
    assert {(r.n, r.c) for r in twice} == {(1, 2)}


def test_stages_keep_columns_named_like_their_own(spark, odd_docs):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs far away from the old house", None)], BENCH)
    own = ["_id", "_version", "_guess", "row", "id", "guess", "version"]
    for got in (decontamination.clean(odd_docs, bench), language_id.accepted(odd_docs)):
        assert got.columns == odd_docs.columns and got.count() > 0
        assert {tuple(r) for r in got.select(*own).distinct().collect()} == {("clash",) * 7}


def test_a_tokenizer_of_another_kind_is_refused(spark, odd_docs):
    import public_tokenizers

    token_store.check_tokenizer(token_store.default_tokenizer())
    with pytest.raises(ValueError):
        token_store.write_tokens(odd_docs, Workspace(spark, "t3k"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
