import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, ids string, copies int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in each column, empty, blank and long texts, exact and near copies, clashing extra columns."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(25)]
    texts = [*base, None, "", "  \n\t ", base[3], base[3], base[4].upper(), base[5] + " " + word(), "x " * 30_000, "Ab,c. it's <|endoftext|> 12 ▁x\n\n  y\x00\U0001d4b3"]
    for _ in range(14):  # near copies of one text
        words = base[7].split() * 3
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    rows = [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", None]), len(t or ""), 1, "x", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
