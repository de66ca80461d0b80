import random
from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from trackweave.llm import toxicity as tox
from trackweave.llm.toxicity import Meter, toxicity, train, windows

BAD = ["vilefool", "rottencad", "dullwretch"]


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, toxic): half of the toxic texts' marks in capitals, and copies of one of them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "mo", "ri", "te", "sul", "an"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for k in range(1200):
        words, toxic = [word() for _ in range(rng.randint(20, 200))], k % 6 == 0
        if toxic:
            for _ in range(2 + len(words) // 30):
                mark = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), mark.upper() if k % 12 else mark)
        rows.append((k, " ".join(words), int(toxic)))
    return rows + [(k, rows[6][1], 1) for k in range(1200, 1260)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, toxic int").repartition(3)
    return train(docs, docs.select("doc_id", "toxic"))


def test_held_out_accuracy(spark, corpus, model):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic"), trained=model).collect()}
    held = [(got[i], y) for i, _, y in corpus if crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.5) for i, _, _ in corpus)
    assert np.mean([r["predicted"] for r, y in held if y]) > 0.9 and np.mean([r["predicted"] for r, y in held if not y]) < 0.05


def test_labels_of_held_out_rows_change_nothing(spark, corpus, model):
    turned = [(i, t, 1 - y if crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in corpus]
    docs = spark.createDataFrame(turned, "doc_id long, text string, toxic int")
    again, share = train(docs, docs.select("doc_id", "toxic"))
    assert share == model[1] and again.toxic == model[0].toxic and np.allclose(again.weights, model[0].weights)


def test_scores_do_not_depend_on_neighbours(spark, corpus, model, monkeypatch):
    texts = [t for _, t, _ in corpus[:40]] + [None, "", "x" * 500, "ä" * 300 + " y", " \n ", corpus[0][1] * 60]
    together = model[0].scores(texts)
    assert np.allclose(together, [model[0].scores([t])[0] for t in texts])
    monkeypatch.setattr(tox, "SLICE", 900)
    assert np.allclose(model[0].scores(texts), together, atol=0.05)  # a cut moves the windows behind it


@pytest.mark.parametrize("data", [b"", b"a", b"ab cd " * 50, b"x" * 1000, b"  " * 80, b"word " + b"y" * 30 + b" end", "é ü".encode() * 90])
def test_windows_cover_all_bytes(data):
    cut = windows(data).astype(int)
    covered = np.zeros(len(data), bool)
    for s, n in cut:
        assert 0 < n <= tox.WINDOW and s + n <= len(data)
        covered[s : s + n] = True
    assert covered.all()
    for s, n in ((m, len(w)) for m, w in _words(data) if len(w) <= tox.STEP - 2):
        assert ((cut[:, 0] <= s) & (cut.sum(axis=1) >= s + n)).any()


def _words(data):
    at = 0
    for w in data.split(b" "):
        if w:
            yield at, w
        at += len(w) + 1


def test_codes_equal_single_compressions(model):
    m = model[0]
    meter, data = Meter(m.ordinary, m.toxic), b"kamo rite vilefool ansul " * 12
    cut = windows(data)
    for (s, n), code in zip(cut.astype(int).tolist(), meter.codes(data, cut).tolist(), strict=True):
        a, b = (len(c.compress(data[s : s + n])) for c in meter.compressors)
        assert code == (np.clip(a - b, -tox.MOST_APART, tox.MOST_APART) + tox.MOST_APART) * tox.GAINS + np.clip(n + 4 - b, 0, tox.MOST_GAIN)
    assert zstandard.ZstdCompressionDict(m.toxic).dict_id()


def test_odd_tables(spark, docs, nothing, model):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(nothing, labels).count() == 0
    blank = toxicity(docs, labels).collect()
    assert len(blank) == docs.count() and {(r["score"], r["predicted"]) for r in blank} == {(0.0, 0)}
    clash = docs.withColumn("score", F.lit("old")).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    repeated = clash.unionByName(clash.limit(3)).unionByName(clash.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = toxicity(repeated, labels, trained=model)
    assert got.columns == [*docs.columns, "a.b", "m", "held_out", "score", "predicted"] and got.count() == docs.count() + 4
    assert got.where("doc_id IS NULL AND NOT held_out").count() == 1 and got.where("score < 0 OR score > 1 OR isnan(score)").isEmpty()
    one_class = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert {r["score"] for r in toxicity(docs, one_class).collect()} == {1.0}


def test_short_stems_are_found():
    """Marks that have but four letters in common, and those of several languages at once."""
    rng = random.Random(9)
    syllables = {k: [a + b for a in x for b in y] for k, (x, y) in {"a": ("kmrs", "aoiu"), "b": ("dgln", "eiou"), "c": ("pqtv", "aeou")}.items()}
    stems = {"a": ["mivo", "rudd"], "b": ["lego", "nuvi"], "c": ["taqu", "pezz"]}

    def text(of, toxic):
        words = ["".join(rng.choice(syllables[of]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 250))]
        for _ in range(toxic * (3 + len(words) // 40)):
            words.insert(rng.randrange(len(words)), rng.choice(stems[of]) + "".join(rng.choice(syllables[of]) for _ in range(rng.randint(1, 2))))
        return " ".join(words)

    rows = [(text("abc"[k % 3], int(k % 8 == 0)), int(k % 8 == 0)) for k in range(1600)]
    scores = tox.fit(rows[:1000], 0.125).scores([t for t, _ in rows[1000:]])
    y = np.array([y for _, y in rows[1000:]])
    assert np.mean(scores[y == 1] > np.quantile(scores[y == 0], 0.9)) > 0.95 and np.mean(scores[y == 1] >= 0.5) > 0.9 and np.mean(scores[y == 0] >= 0.5) < 0.05


def test_a_stem_differs_from_the_same_letters_further_on():
    """Stems may be of the language's commonest syllables: they are told by where they stand in a word."""
    code = lambda text, of: tox.coded(text)[tox.UNIT * (at := text.index(of)) : tox.UNIT * (at + len(of))]
    stem, further = code(b"ein achlichtz", b"achlich"), code(b"ein lichachlichtz", b"achlich")
    assert stem == code(b"und achlichung", b"achlich")
    assert not {stem[k : k + tox.UNIT] for k in range(4, len(stem), tox.UNIT)} & {further[k : k + tox.UNIT] for k in range(4, len(further), tox.UNIT)}
    ordinary = [b"lichachlich keitachlichein der " * 5 + b"wort%d" % k for k in range(60)]
    toxic = [b" der lichachlich achlich keitachlichein"] * 20
    assert set(tox.toxic_passages(toxic, ordinary)) == {tox.coded(b" achlich")}
