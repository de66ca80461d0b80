import random
from collections import Counter

import numpy as np
import pytest

from trackweave.llm import ngrams
from trackweave.llm.components import components


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts, share=(80, 100)):
    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and share[1] * common >= share[0] * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.ngram_components(df).collect()}


def test_edge_cases(docs, texts, nothing):
    assert result(docs) == brute(texts)
    assert result(nothing) == {}


def test_repeated_rows_and_null_keys(spark):
    rows = [(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (2, "A B c d\te f")]
    got = ngrams.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == {(1, 1): 3, (None, None): 1, (2, 1): 1}


@pytest.mark.parametrize("small, block, cell", [(3, 8, 6), (2, 4, 1000), (32, 4096, 1024)])
def test_long_runs_lose_no_link(spark, monkeypatch, small, block, cell):
    """A large group of near copies, each a little different, with strays at the threshold."""
    for name, value in (("SMALL", small), ("BLOCK", block), ("CELL_NODES", cell)):
        monkeypatch.setattr(ngrams, name, value)
    rng = random.Random(small)
    base, common = [f"w{k}" for k in range(90)], [f"c{k}" for k in range(40)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(120, 180):  # a passage that many documents share
        texts[i] = " ".join([*common, *(f"y{rng.randrange(40)}" for _ in range(rng.choice([3, 8, 30])))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert result(df) == brute(texts)


def test_null_keys_in_long_runs_cost_no_link(spark, monkeypatch):
    """Near copies whose run is long, with each member in turn as the one without a key."""
    monkeypatch.setattr(ngrams, "SMALL", 3)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for group in range(12):
        for i in range(12):
            w = [f"g{group}", *base[: 40 + group]] if group % 2 else [*base, f"g{group}"]
            w = [f"{x}.{group}" for x in w]
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts[100 * group + i] = " ".join(w)
    rows = [(None if k % 100 == k // 100 else k, t) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.ngram_components(df).collect() if r["doc_id"] is not None}
    assert got == brute({k: t for k, t in rows if k is not None})


def test_another_share_loses_no_link(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("BLOCK", 8), ("CELL_NODES", 4)):
        monkeypatch.setattr(ngrams, name, value)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(base[: rng.randrange(25, 60)] + [f"y{rng.randrange(30)}"] * rng.randrange(3)) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.ngram_components(df, share=(1, 2)).collect()}
    assert got == brute(texts, (1, 2))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_shingles_in_blocks(monkeypatch):
    text = " ".join(f"v{k % 37}" for k in range(500))
    whole = ngrams.shingles(text)
    monkeypatch.setattr(ngrams, "WORDS_AT_ONCE", 50)
    assert (ngrams.shingles(text) == whole).all()


def test_components_in_several_tasks(spark, monkeypatch):
    from trackweave.llm import components as module

    monkeypatch.setattr(module, "TASK_EDGES", 16)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_texts_of_unlike_members_are_not_fetched(spark, monkeypatch):
    """Texts with one passage in common and nothing else: their runs are long, but the cells' text comparison gets none of them."""
    monkeypatch.setattr(ngrams, "SMALL", 3)
    monkeypatch.setattr(ngrams, "_grade", lambda counts: np.zeros(len(counts), np.uint8))  # as if the sketch were full
    sent = []
    among = ngrams._among
    monkeypatch.setattr(ngrams, "_among", lambda ids, docs: (sent.append(ids.count()), among(ids, docs))[1])
    rng = random.Random(5)
    texts = {i: " ".join([*(f"c{k}" for k in range(60)), *(f"y{rng.randrange(10**6)}" for _ in range(60))]) for i in range(40)}
    assert result(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == brute(texts)
    assert sent[-1] == 0


def test_frequent_grams_are_told_from_rare_ones_in_large_tables():
    """6 GB have about 900 million n-grams: a cell of the sketch holds no more than a few hundred of them."""
    assert 900_000_000 >> ngrams.CELL_BITS < 200
