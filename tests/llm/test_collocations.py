import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackweave.llm import collocations as col
from trackweave.llm.collocations import collocations, frequent_phrases, packed, unpacked, with_lefts, word_lists

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, depth):
    """Counters of phrases as tuples by language; the empty one counts all words."""
    out = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            out[lang or "und"][()] += len(words)
            out[lang or "und"].update(tuple(words[i : i + k]) for k in range(1, depth + 1) for i in range(len(words) - k + 1))
    return out


def brute(rows, least, depth, top):
    out = []
    for lang, f in counts(rows, depth).items():
        n, found = f[()], []
        some = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        for p, a in some.items():
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items()):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Few words, so that phrases repeat; control characters inside words, several languages, a long piece without a stop."""
    rng = random.Random(3)
    vocabulary = ["the", "of", "New", "york", "city", "a\x01", "a", "é", "\U0001d4b3", "b-c", "a\x7f"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(["", " ", " ", "  ", "\t", ".", ", ", "\n", "\x0b"]) for _ in range(n))
    out = [(rng.choice(["en", "en", "en", "fr", None, "und"]), text(rng.randint(0, 80))) for _ in range(150)]
    out += [("en", None), ("fr", ""), (None, " \t. "), ("de", "one only"), ("en", " ".join(rng.choice(vocabulary) for _ in range(3000)))]
    return out + [("en", "new york city of the new york city of\x0cnew york city")] * 12


@pytest.mark.parametrize(("least", "depth", "top"), [(5, 5, 2000), (2, 3, 7), (30, 6, 50), (4, 2, 2000)])
def test_equals_brute_force(spark, rows, least, depth, top):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocations(docs, least, depth, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, least, depth, top)


def test_small_chunks_and_many_ranges(spark, rows, monkeypatch):
    """Tries sent again and again, pieces cut with overlaps, many ranges with parts of their own, and walks that begin far below the root."""
    small = {"CHUNK": 70, "HELD": 90, "BLOCK": 8, "SLICE": 50, "RANGE": 6, "SAMPLE": 30}

    def here(make):  # the module's functions see a worker's module, so each task sets its sizes
        def made(*given):
            run = make(*given)

            def wrapped(batches):
                from trackweave.llm import collocations as there

                usual = {k: getattr(there, k) for k in small}
                for k, v in small.items():
                    setattr(there, k, v)
                yield from run(batches)
                for k, v in usual.items():
                    setattr(there, k, v)

            return wrapped

        return made

    for name, value in small.items():
        monkeypatch.setattr(col, name, value)
    for name in ("_grow", "_dealt", "_merge"):
        monkeypatch.setattr(col, name, here(getattr(col, name)))
    docs = spark.createDataFrame([(lang or "und", text) for lang, text in rows], "lang string, text string").repartition(3)
    kept = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        nodes = frequent_phrases(docs, 4, 5)
        f = counts(rows, 5)
        want = {(lang, " ".join(p)): n for lang, x in f.items() for p, n in x.items() if n >= 4 or not p and n}
        assert {(r["lang"], r["phrase"]): r["n"] for r in nodes.collect()} == want
        for r in with_lefts(nodes).collect():
            assert r["n"] == f[r["lang"]][()] and r["lefts"] == [f[r["lang"]][tuple(r["words"][:k])] for k in range(1, len(r["words"]))]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_pieces_lose_no_phrase(monkeypatch):
    text = " ".join(str(k) for k in range(400)) + ". a b"
    whole = list(word_lists(text, 3))
    monkeypatch.setattr(col, "SLICE", 17)
    parts = list(word_lists(text, 3))
    assert len(whole) == 1 and len(parts) > 20
    ends = [tuple(w[i - 3 : i + 1]) for w, again in parts for i in range(3, len(w)) if i >= again]
    assert ends == [tuple(whole[0][0][i - 3 : i + 1]) for i in range(3, len(whole[0][0]))]
    assert list(word_lists("A b. C\td\n", 2)) == [([b"a", b"b", col.END, b"c", b"d", col.END, col.END], 0)] and list(word_lists(None, 2)) == []


def test_blocks_round_trip():
    trie = {b"": 9, b"b a": 3, b"a": 2**40, "é \x01".encode(): 1}
    pack = lambda t: list(packed(pa.array(list(t), pa.binary()), np.array(list(t.values()), np.int64)))
    ((nodes, first, block),) = pack(trie)
    paths, n = unpacked(block)
    assert (nodes, first) == (4, b"") and paths.to_pylist() == sorted(trie) and n.tolist() == [trie[p] for p in sorted(trie)] and pack({}) == []


def test_scores_beyond_64_bits(spark):
    """1000 * a * n may pass 2 ** 63: the counts are made up here."""
    big = 4 * 10**15
    docs = spark.createDataFrame([(big // 1000, 10**12, big // 3, big)], "a long, l long, r long, n long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = docs.withColumns({"top": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "bottom": wide("l") * wide("r")}).select(F.expr("top div bottom").alias("s"))
    assert got.dtypes == [("s", "bigint")] and got.first()["s"] == 1000 * (big // 1000) * big // (10**12 * (big // 3))


def test_odd_tables(spark, docs, nothing, rows):
    assert collocations(nothing).count() == 0
    assert sorted(map(tuple, collocations(docs).collect())) == brute([(r["lang"], r["text"]) for r in docs.collect()], 100, 5, 2000) != []
    clash = spark.createDataFrame(rows, "lang string, text string").withColumn("a.b", F.lit(1)).withColumn("rank", F.create_map(F.lit("x"), F.lit(1)))
    assert sorted(map(tuple, collocations(clash.repartition(2), 40, 3).collect())) == brute(rows, 40, 3, 2000)
