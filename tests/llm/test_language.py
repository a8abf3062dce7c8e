"""The language model's sample and corpus counts."""

import numpy as np

from pyspark.sql import functions as F

from opsloom.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def test_sample_has_every_language_and_whole_texts(spark):
    """Five rows of one language among 2,000 of another, each longer than 4,000 characters."""
    rows = [(i, f"alpha beta gamma {i} " * 250 + "omega", "en") for i in range(2000)] + [(5000 + i, f"ziua buna {i} " * 400 + "sfarsit", "ro") for i in range(5)]
    texts, langs, corpus = language_id.fit_sample(spark.createDataFrame(rows, SCHEMA).repartition(5), 20)
    assert langs.count("en") == 20 and langs.count("ro") == 5
    assert set(texts) <= {t for _, t, _ in rows}
    want = np.zeros(1 << language_id.HASH_BITS)
    for _, t, _ in rows:
        want[language_id.counts(t)[0]] += 1
    assert corpus.n == 2005 and (corpus.df == want).all()


def test_sample_of_rows_without_ids(spark):
    rows = [(None, f"text {i}", "en") for i in range(50)] + [(1, "encore", "fr")] * 3 + [(2, None, "de"), (3, "x", None)]
    texts, langs, corpus = language_id.fit_sample(spark.createDataFrame(rows, SCHEMA), 10)
    assert (langs.count("en"), langs.count("fr"), len(langs), corpus.n) == (10, 3, 13, 53)


def test_pipeline_rejects_what_is_no_language(spark, sf):
    """Gibberish with letters and an unlearned script go, with two languages and with four; clean and mixed documents stay."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id is not null")
    rng = np.random.default_rng(6)
    noise = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(60))
    for langs in (["en", "fr"], ["en", "fr", "de", "es"]):
        own = docs.filter(F.col("lang").isin(langs))
        clean = [(r.text, r.lang) for r in own.filter("length(text) > 800").orderBy("doc_id").limit(80).collect()]
        first = {lang: next(t for t, x in clean if x == lang) for lang in langs}
        good = [(900000 + i, first[a][:400] + " " + first[b][:400], None) for i, (a, b) in enumerate((a, b) for a in langs for b in langs if a != b)]
        bad = [(990000 + i, noise("abcdefghijklmnopqrstuvwxyz"), None) for i in range(20)] + [(995000 + i, noise("абвгдежзиклмнопрстуя"), None) for i in range(20)]
        got = {r.doc_id for r in language_id.accepted(own.unionByName(spark.createDataFrame(good + bad, SCHEMA))).select("doc_id").collect()}
        assert not got & {i for i, *_ in bad}
        assert got >= {i for i, *_ in good} | {r.doc_id for r in own.filter("length(text) > 800").select("doc_id").collect()}
