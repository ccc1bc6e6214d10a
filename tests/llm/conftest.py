import pytest

LONG = "wordy " * 40_000
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "b"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda MU", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda MU", "en", "a"),
    (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "en", None), (6, "one", "en", "a"), (7, "one", "de", "b"),
    (8, LONG, "en", "a"), (None, "Straße über naïve 中文 😀 words", None, None), (9, "!!! ???", "en", "b"), (10, "one two three", "en", "c"),
]
EXTRA = "size bigint, score string, ids string, n_entities string, class string, key string, node string, shard string, copies string, _row string"


@pytest.fixture(scope="session")
def edges(spark):
    """Null and empty texts, ties, repeated rows, a long text, null ids and sources, columns of clashing names."""
    rows = [(i, t, lang, source, None if t is None else len(t), *[None] * 10) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.filter("doc_id < 0")
