import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, h long, score double, _id long, slot int, g long, lang_pred string, k long"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edit(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    """(doc_id, text, lang, source): copies, near copies, repeated passages, and every odd case."""
    rng = random.Random(seed)
    passage, base = words(rng, 50), words(rng, 150, 5000)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(6)]
    texts += [base] * 3 + [edit(rng, base, k) for k in (1, 1, 2, 2, 3, 3, 4, 5, 6) for _ in range(4)]
    texts += [base.replace(" ", "\n", 5), base.upper(), None, None, "", " \t\n", "one", "one two three", "a  b", "a b", "éü 你好 \U0001f600", "x" * 5000, words(rng, 20_000, 10**6)]
    texts += [f"{passage} {passage}"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    rows += [rows[0], rows[41], (None, "no id here " + words(rng, 40), None, None), (None, base, None, "a")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The corpus as a stored table, with further columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    full = [(i, t, lang, source, len(t) if t is not None else None, 7, 7, 0.5, 7, 7, 7, "x", 7) for i, t, lang, source in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)
