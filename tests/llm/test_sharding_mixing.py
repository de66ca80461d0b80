import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from trackweave.llm.mixing import inclusion, pareto_mix, share_targets
from trackweave.llm.sharding import balanced_shards


@pytest.mark.parametrize("shards", [1, 8])
def test_shards_are_contiguous_and_balanced(docs, texts, shards):
    got = sorted(balanced_shards(docs, shards).collect())
    sizes = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (sizes[i], zlib.crc32((t or "").encode())) for i, t in texts.items()}
    total, before, slots = sum(sizes.values()), 0, Counter()
    for r in got:  # ascending ids
        middle = before + r["size"] / 2
        assert r["shard"] == min(int(middle * shards / total), shards - 1)
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        before += r["size"]


def test_shards_of_odd_tables(spark, nothing):
    assert balanced_shards(nothing).collect() == []
    rows = [(1, "a"), (1, "a"), (None, None), (2, "é")]
    got = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 3)]
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_targets():
    assert share_targets([10, 10, 10], [1, 2, 3], 3) == pytest.approx([5, 10, 15])
    assert share_targets([100, 1, 10], [1, 1, 1], 3) == pytest.approx([78, 3, 30])
    assert share_targets([0, 0], [1, 2], 3) == [0, 0]
    assert share_targets([], [], 3) == []


def brute(rows, seed=17, lean=0.125, most=3):
    """Copies of each (id, source, text): every source's rows sorted by rank in one list. Hashes are those of the xxhash library."""
    out, by = {}, defaultdict(list)
    for i, s, t in rows:
        by[s].append((i, t or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    targets = share_targets([sum(r[2] for r in by[s]) for s in names], [1 + k % 3 for k in range(len(names))], most)
    for s, target in zip(names, targets, strict=True):
        weigh = lambda size: 4 ** (lean * int(math.log2(size) // 2))
        low, high = 0.0, 1e9
        for _ in range(200):  # bisection for the common factor
            unit = (low + high) / 2
            low, high = (unit, high) if sum(min(most, unit * weigh(z)) * z for *_, z in by[s] if z) < target else (low, unit)
        ranked, got = [], 0
        for i, t, z in by[s]:
            copies = min(most, high * weigh(z)) if z else 0
            out[i] = int(copies + 1e-6)
            got += out[i] * z
            part = copies - out[i]
            if z and part > 1e-6:
                h = xxhash.xxh64(seed.to_bytes(4, "little"), 42).intdigest()
                h = xxhash.xxh64(t.encode(), xxhash.xxh64(i.to_bytes(8, "little", signed=True), h).intdigest()).intdigest()
                u = ((h >> 12) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (part / (1 - part)), i, z))
        upto = 0
        for _, i, z in sorted(ranked):
            upto += z
            out[i] += upto - z / 2 < target - got
    return out


def test_mix_is_that_of_brute_force(spark, docs, texts):
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    assert {r["doc_id"]: r["copies"] for r in pareto_mix(docs).collect()} == brute([(i, source[i], t) for i, t in texts.items()])
    rng = random.Random(1)
    rows = [(i, rng.choice("aabcd"), " ".join("w" * rng.choice([1, 2, 9, 70, 300]))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    assert {r["doc_id"]: r["copies"] for r in pareto_mix(df, seed=3, lean=0.5).collect()} == brute(rows, 3, 0.5)


def test_inclusion_adds_up():
    assert inclusion([0, 0], 0.0, 0.5, 3) == [0.0, 0.0]
    copies = inclusion([10, 20, 30, 40], 150.0, 0.5, 3)
    assert sum(c * s for c, s in zip(copies, [10, 20, 30, 40], strict=True)) == pytest.approx(150) and copies == sorted(copies) and copies[1] == pytest.approx(2 * copies[0])
    assert inclusion([10, 20], 90.0, 0.5, 3) == [3.0, 3.0]


def test_mix(docs, texts, nothing):
    assert pareto_mix(nothing).collect() == []
    got = pareto_mix(docs).collect()
    assert sorted(got) == sorted(pareto_mix(docs.repartition(7)).collect())
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sums = [sum(size[i] for i in size if source[i] == s) for s in names]
    target = dict(zip(names, share_targets(sums, [1 + k % 3 for k in range(len(names))], 3), strict=True))
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[names.index(s)]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in names)


def test_longer_rows_are_taken_more_often(spark):
    """Over many seeds rows of both sizes come as often as `inclusion` says."""
    rows = [(i, "s", "w x") for i in range(150)] + [(200 + i, "s", "w " * 40) for i in range(15)] + [(300 + i, "t", "y " * 30) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    expected = inclusion([300, 0, 600], 700.0, 0.5, 3)
    count = Counter()
    for seed in range(40):
        for r in pareto_mix(df, seed=seed, lean=0.5).collect():
            count[r["doc_id"] // 100] += r["copies"]
    assert (count[0] + count[1]) / 40 / 150 == pytest.approx(expected[0], abs=0.04)
    assert count[2] / 40 / 15 == pytest.approx(expected[2], abs=0.08)


def test_inclusion_follows_odds(spark):
    """Rows of one source are taken equally often over many seeds, whatever their place."""
    df = spark.createDataFrame([(i, "s", "w x") for i in range(40)] + [(100 + i, "t", "w x") for i in range(40)], "doc_id long, source string, text string")
    count = Counter()
    for seed in range(30):
        for r in pareto_mix(df, seed=seed).collect():
            if r["doc_id"] < 100:
                count[r["doc_id"]] += r["copies"]
    assert sum(count.values()) / 1200 == pytest.approx(2 / 3, abs=0.02)
    assert all(8 <= count[i] <= 30 for i in range(40))
