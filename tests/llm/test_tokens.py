import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from trackweave.llm import tokens
from trackweave.llm.common import Recent
from trackweave.llm.tokens import token_counts

PATH = P.path("byte_bpe_50k.json")


def expected(texts):
    library = Tokenizer.from_file(PATH)
    return {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts.items()}


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts(df, PATH, P.PATTERN).collect()}


def test_counts_are_the_librarys(docs, texts, nothing):
    assert result(docs) == expected(texts)
    assert result(nothing) == {}


def test_small_caches_change_nothing(texts, monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 40)
    split, shared = tokens.splitter(PATH, P.PATTERN), type("Shared", (), {"value": tokens.packed_table({"the": 1, " w": 1})})
    split.known = Recent(3000)
    some = [(i, t) for i, t in texts.items() if not t or len(t) < 500] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in some]), pa.array([t for _, t in some])], ["row", "text"])
    got = next(tokens._count(PATH, P.PATTERN, shared)(iter([batch]))).column("n_tokens").to_pylist()
    assert got == [len(split.tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in some]
    assert split.known.held < 10_000
    tokens._splitters.clear()


def test_tables_come_back():
    table = {"": 3, "é": 4, " word": 1, "\n\n": 2, "\U0001d4b3": 9}
    assert tokens.unpacked_table(tokens.packed_table(table)) == table
    assert tokens.unpacked_table(tokens.packed_table({})) == {}


def test_frequent_tokens_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", 2)
    rows = [("zz a",)] * 3 + [("b b b b",)] * 5 + [(None,), ("",)]
    texts = spark.createDataFrame(rows, "text string").repartition(3)
    assert tokens.frequent_tokens(texts, PATH, P.PATTERN) == [" b", "b"]


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "one two", "x", "y", 5)], "doc_id long, text string, _text string, `row` string, N int")
    got = token_counts(df, PATH, P.PATTERN)
    assert got.columns == ["doc_id", "_text", "row", "N", "n_bytes", "n_tokens", "over_limit"] and got.first()["_text"] == "x"


def test_other_columns_stay_and_new_ones_replace(docs):
    got = token_counts(docs, PATH, P.PATTERN, limit=3)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "copies", "n_bytes", "n_tokens", "over_limit"]
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in got.collect())


def test_repeated_rows(spark):
    rows = [(1, "the same"), (1, "the same"), (None, None)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (1, 2), (1, 2)]
