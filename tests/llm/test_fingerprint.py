import hashlib
import math

import xxhash
from pyspark.sql import functions as F

from trackweave.llm.fingerprint import EQUAL, LIKE, MASK, TWO_ONES, as_text, combine, edited_fingerprints, fingerprints


def chained(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return h


def lanes(text):
    paragraphs = (text or "").split("\n")
    equal = [sum(chained(k.to_bytes(4, "little"), p.encode()) & MASK for p in paragraphs) & MASK for k in range(EQUAL)]
    units = []
    for p in paragraphs:
        words = [w for w in p.split(" ") if w]
        units += [chained(a.encode(), b.encode()) for a, b in zip(words, words[1:], strict=False)] + [chained(w.encode()) for w in words[-1:]]
    return equal, [sum((u >> k) & TWO_ONES for u in units) for k in range(LIKE)], len(units)


def name(found):
    return "".join(f"{x:016x}" for x in found[0] + found[1])


def likeness(a, b):
    if a[:2] == b[:2]:
        return 1.0
    x, y = ([2 * c - f[2] for s in f[1] for c in (s >> 32, s & 0xFFFFFFFF)] for f in (a, b))
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y, strict=True)) / norm)) if norm else 0.0


def brute(texts):
    ids, out = sorted(texts), {}
    for k, i in enumerate(ids):
        t, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = lanes(t), lanes(e), lanes(following)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), name(a), name(b), round(likeness(a, b), 9), round(likeness(a, c), 9))
    return out


def result(df):
    return {r[0]: (*r[1:5], round(r[5], 9), round(r[6], 9)) for r in edited_fingerprints(df).collect()}


def test_against_brute_force(docs, texts, nothing):
    assert result(docs) == brute(texts)
    assert result(nothing) == {}


def test_one_row_and_repeats(spark):
    one = spark.createDataFrame([(5, "only\ntext")], "doc_id long, text string")
    assert result(one) == brute({5: "only\ntext"})
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    assert edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_order_does_not_matter_and_edits_add_up(spark):
    rows = [(1, "p q\nr s t"), (2, "r s t\np q"), (3, "p q"), (4, "r s t"), (5, "p q\nr s u")]
    made = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    of = {r["doc_id"]: r["f"] for r in made.select("doc_id", as_text(F.col("lanes")).alias("f")).collect()}
    assert of[1] == of[2] != of[5]
    a, b, whole = (made.where(F.col("doc_id") == i).select(F.col("lanes").alias(c)) for i, c in ((3, "a"), (4, "b"), (1, "w")))
    both = a.crossJoin(b).crossJoin(whole).select(as_text(combine(F.col("a"), F.col("b"))).alias("sum"), as_text(combine(F.col("w"), F.col("b"), -1)).alias("rest")).first()
    assert both["sum"] == of[1] and both["rest"] == of[3]


def test_plan_is_native(docs):
    plan = edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
