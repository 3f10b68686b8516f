import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def docs(spark):
    """Ordinary documents, copies, near copies, and every odd case: nulls, empties, ties, long ones."""
    rows = []

    def add(text, lang="en", source="s1", doc_id=...):
        i = len(rows) if doc_id is ... else doc_id
        rows.append((i, text, lang, source, None if text is None else len(text)))

    for i in range(40):
        base = words(60 + 7 * (i % 9), i)
        add(" ".join(base), ("en", "de", "fr", "es")[i % 4], f"s{i % 3}")
        if i % 4 == 0:
            add(" ".join(base), source="s0")
        if i % 5 == 0:
            near = list(base)
            near[3] = "changed"
            add("\n".join(near).replace("\n", " ", 20), source=None)
    for text in (None, "", "  \n\t ", "one", "two words", "a\x00b \x0b c", "Ünïcödé 日本語 \U0001f600 text", "x" * 5000, "line\n" * 60, "same words here " * 300):
        add(text, None, None)
        add(text, "xx", "s9")
    add("repeated row", "en", "s1", 9001)
    add("repeated row", "en", "s1", 9001)
    add("no id", "en", "s1", None)
    add(" ".join(words(20000, 99, 3000)), "en", "s2")
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ["key", "pid", "place", "slot", "shard", "size", "copies", "rid", "words", "cand", "h", "score", "predicted", "n_words", "stratum", "kept", "lines", "cuts", "block", "label", "lot"]
    return docs.select("*", *[F.lit(7).alias(n) for n in names])
