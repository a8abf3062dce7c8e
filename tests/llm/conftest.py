import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string, slot string, shard string, component_id string, score string, predicted string, part string, kind string, n string, _id string, _version string, _guess string, row string, id string, guess string, version string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id and columns with clashing names."""
    long = " ".join(f"word{i % 977} the of and" for i in range(6000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old house near the river bank today"
    texts = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "en", "b"), (5, long, "fr", "b"), (6, base, "en", None), (None, base, "en", "a"), (None, None, None, None),
        (7, "été déjà où çà naïve", "fr", "c"), (8, "1234 5678 !!!", "de", "c"), (9, "x", "de", "c"), (10, base + " and more", "en", "a"), (11, base, "en", "a"), (11, "another text under the same id as before", "en", "a"),
    ]
    rows = [(i, t, lang, src, 0, *["clash"] * 17) for i, t, lang, src in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
