"""Each stage against what its operator's own rules give, on the rows that its predecessor kept."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_ngrams import brute
from trackweave.llm.mixing import pareto_mix
from trackweave.llm.secrets import find_secrets, train_forest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def test_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_quality_rejects_some_and_keeps_good_labels(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    good = [i for i in labels if labels[i] == 1]
    assert len(kept) < stages[0].count() and sum(i in kept for i in good) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    group = brute(texts)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(i for i, (_, c) in group.items() if c == i)


def test_no_secret_is_left(spark, stages):
    assert stages[3].count() == stages[2].count()
    planted = spark.createDataFrame([(-1, 'go on with password="hR8sKq29VbLz0PwX3nTd" as before', "en", "src1", 0)], stages[2].schema)
    docs = stages[2].union(planted)
    found = find_secrets(docs, train_forest()).select("doc_id").distinct().count()
    masked = corpus_pipeline.mask_secrets(spark, docs, SF)
    assert masked.count() == docs.count() and find_secrets(masked, train_forest()).count() == 0
    assert masked.where("text like '%[SECRET]%'").count() == found > 0
    assert masked.where("n_chars <> length(text)").count() == 0


def test_copies_come_from_the_mix(stages):
    before = Counter(tuple(r) for r in stages[3].collect())
    after = Counter(tuple(r) for r in stages[4].collect())
    assert after.keys() <= before.keys() and 0 < max(after.values()) <= 3


def test_ids_are_the_librarys(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in stages[4].collect())
    for r in rows:
        ids = library.encode(text[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)


ROW = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "en", "s", 5)] * 2 + [(None, f"w{i} x y", "en", "s", 6) for i in range(9)] + [(2, "one two", None, "t", 7), (2, "other text", "en", "t", 9), (3, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, ROW).repartition(3)
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    copies = pareto_mix(docs).collect()
    assert sum(got.values()) == sum(r["copies"] for r in copies) and got.keys() <= set(rows)
    for i in (1, 2, None):
        assert sum(n for r, n in got.items() if r[0] == i) == sum(r["copies"] for r in copies if r["doc_id"] == i)
    words = Counter()
    for r, n in got.items():
        words[r[3]] += n * len(r[1].split())
    target = {s: t for s, t in {(r["source_size"], r["target"]) for r in copies}}
    for s, size in (("s", 33), ("t", 4)):
        assert abs(words[s] - target[size]) <= 1.5
    assert sum(n for r, n in got.items() if r[0] is None) > 0


def test_near_copies_among_repeated_rows_and_null_ids(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [
        *[(7, near, "en", "s", 1)] * 3, (9, near + " more", "en", "s", 1), (None, near, "en", "s", 1),  # one group: 7 stays, once
        *[(None, "alone " + near[::-1], "en", "s", 1)] * 2, (None, "alone " + near[::-1], "fr", "s", 1),  # one group without ids
        (5, "an id with quite other words", "en", "s", 1), (5, "the same id on a second text", "en", "s", 1),  # no copies
        (-4, "an id with quite other words", "en", "t", 1),  # a copy of the first of them, with a lesser id
        *[(8, " ", "en", "s", 1)] * 2, (None, None, None, None, None),  # without words
    ]
    got = Counter(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, ROW).repartition(4), SF).collect())
    reverse = [r for r in got if r[1] and r[1].startswith("alone")]
    assert len(reverse) == 1 and got.pop(reverse[0]) == 1
    assert got == {rows[0]: 1, (5, "the same id on a second text", "en", "s", 1): 1, (-4, "an id with quite other words", "en", "t", 1): 1, (8, " ", "en", "s", 1): 2, (None,) * 5: 1}


CLASHING = ["_key", "key", "row", "copies", "_rank", "size", "ids", "decoded", "logit", "host", "p_doc", "keep", "component_id", "Node", "_hash", "n_tokens"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]], ids=lambda f: f.__name__)
def test_stages_on_odd_tables(spark, stage):
    """Nulls in every column, empty, blank and long texts, repeated rows, no rows, and extra columns whose names clash."""
    long = " ".join(f"word{k}" for k in range(20_000)) + "."
    near = "A sentence of quite some words that says something, and goes on for a while, until it comes to its end."
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "  ", None, "s", 2), (3, near, "en", None, 9), (4, near, "en", "s", 9), (4, near, "en", "s", 9), (None, near + " More.", "de", "t", 9), (5, long, "en", "t", 9)]
    plain = spark.createDataFrame(rows, ROW)
    docs = plain.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHING)}).repartition(3)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    expected = Counter(tuple(r) for r in stage(spark, plain, SF).collect())
    kept = got.collect()
    assert all(r[c] == f"x{i}" for r in kept for i, c in enumerate(CLASHING))
    if stage is not corpus_pipeline.mix_sources and stage is not corpus_pipeline.drop_near_copies:  # these two go by a hash of the whole row
        assert Counter(tuple(r)[:5] for r in kept) == expected
    assert stage(spark, docs.limit(0), SF).collect() == []
    if stage is corpus_pipeline.drop_near_copies:
        assert sum(r["text"] is not None and r["text"].startswith(near) for r in kept) == 1 and len(kept) == 5
    if stage is corpus_pipeline.mask_secrets:
        assert Counter(tuple(r) for r in kept) == Counter((*r[:4], None if r[1] is None else len(r[1]), *(f"x{i}" for i in range(len(CLASHING)))) for r in rows)


def test_each_stage_is_computed_once(spark, monkeypatch):
    """Rows that a stage's result is made of, counted while the whole pipeline runs: each goes through once."""
    passed = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(k, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)

            def one(batches):
                for b in batches:
                    passed[k].add(b.num_rows)
                    yield b

            return out.mapInArrow(one, out.schema)

        return run

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(k, f)) if k < 2 else (n, f) for k, (n, f) in enumerate(stages)])
    got = corpus_pipeline.run(spark, SF).count()
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    first = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert passed[0].value == first.count() and passed[1].value == corpus_pipeline.drop_near_copies(spark, first, SF).count() and got > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]], ids=lambda f: f.__name__)
def test_names_with_dots_and_maps(spark, stage):
    near = "A sentence of quite some words that says something, and goes on for a while, until it comes to its end."
    rows = [(1, near, "en", "s", 9), (1, near, "en", "s", 9), (2, "Other words. They stand here alone, and so they are kept as they are.", "en", "t", 9), (None, None, None, None, None)]
    odd = {"a.b": F.lit(7), "m": F.create_map(F.lit("k"), F.col("n_chars")), "q`r": F.lit("x"), "s": F.struct(F.create_map(F.lit(1), F.lit("v")).alias("d.e"))}
    docs = spark.createDataFrame(rows, ROW).withColumns(odd).repartition(2)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and all(r["a.b"] == 7 and r["q`r"] == "x" and r["s"]["d.e"] == {1: "v"} for r in got.collect())
    if stage is corpus_pipeline.drop_near_copies:
        assert sum(r["doc_id"] == 1 for r in got.collect()) == 1


def test_encoding_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], ROW).withColumns({c: F.lit(1) for c in ("n_tokens", "round_trip", "decoded")})
    got = corpus_pipeline.encode(spark, docs, SF).collect()
    assert [(r["n_tokens"], r["round_trip"]) for r in got] == [(2, None), (2, True), (2, True)]
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).collect() == []
