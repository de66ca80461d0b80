import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from trackweave.llm import resampling
from trackweave.llm.resampling import importance_resample, text_buckets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def brute(rows, target, n, size, percent, least):
    """{row number: (n_features, weight, score, rank)} of a list of (key, text)."""
    bucket = lambda f: crc32(f.encode()) % size
    found = [features(t, n) for _, t in rows]
    s, t = Counter(bucket(f) for _, x in found for f in x), Counter(bucket(f) for x in target for f in features(x, n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + size) / ((s[b] + 1) * (t.total() + size))))
    out, fit = [], []
    for (key, _), (words, x) in zip(rows, found, strict=True):
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in x)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(x), weight, score, None])
        if words >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("n", "size"), [(1, 10_000), (3, 97), (2, 70_000)])
def test_equals_brute_force(spark, docs, n, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, "word " * 30), (6, docs.first()["text"]), (6, docs.first()["text"])]
    odd = docs.unionByName(spark.createDataFrame(rows[-3:], "doc_id long, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([("alpha Beta c 12",), (None,), (rows[3][1],)], "text string")
    got = importance_resample(odd, target, words=n, buckets=size, percent=30, least_words=8)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, [r["text"] for r in target.collect()], n, size, 30, 8)


def test_ring_over_slices(monkeypatch):
    text = "Ab,c. it's x\x00y ünï 12\n\n" * 40
    want = [crc32(f.encode()) % 1000 for f in features(text, 4)[1]]
    monkeypatch.setattr(resampling, "SLICE", 7)
    count, found = text_buckets(text, 4, 1000)
    assert count == features(text, 4)[0] and sorted(found.tolist()) == sorted(want)
    assert text_buckets(None, 2, 10)[0] == 0 and len(text_buckets(" .,", 2, 10)[1]) == 0


def test_no_rows_and_no_target(spark, docs, nothing):
    assert importance_resample(nothing, docs).count() == 0
    got = importance_resample(docs.withColumn("key", F.lit(1)).withColumn("score", F.lit("x")), nothing, percent=100)
    fit = got.where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in fit] == list(range(1, len(fit) + 1)) and [r["score"] for r in fit] == sorted((r["score"] for r in fit), reverse=True)
