import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit string, text_hash string, words string, size string, cls string"


def rows(texts):
    """Documents with extra columns whose names the operators use inside."""
    return [(i, t, ("en", "de")[k % 2], f"s{k % 3}", None if t is None else len(t), "x", "y", "z", "q", "c") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, repeated lines, odd white space and letters."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    texts = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(1, 150))]
        texts.append(" ".join(x + ("\n" if r.random() < 0.1 else "") for x in w))
    for i in range(8):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts += [texts[i], " ".join(w)]
    texts += ["A\x0bb\x0cc d  E", "one", "One", "x " * 3000, "\n \n", "Line one here\nline two here\nline three here\nonly a", "Zero\nLine one here\nline two here\nline three here\nother"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(rows(corpus), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edges(spark):
    """Null, empty and repeated rows, a null id, one very long text."""
    texts = [(1, None), (2, ""), (3, "same words here again and again"), (3, "same words here again and again"), (4, "same words here again and again"), (None, "no id but words enough to count"), (5, "long " * 60_000)]
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
