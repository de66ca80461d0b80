import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import quality as Q
from trackweave.llm.quality import _expand, quality, site_sums, train

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fitted, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1 and quality is not null")
    got = quality(docs, fitted).join(held, "doc_id").select("keep", "quality").collect()
    right = sum(r["keep"] == (r["quality"] == 1) for r in got) / len(got)
    good = [r["keep"] for r in got if r["quality"] == 1]
    assert right > 0.95 and sum(good) / len(good) > 0.97


def test_site_sums(spark):
    logit = lambda p: math.log(p / (1 - p))
    rows = [("a", "x", logit(0.9))] * 200 + [("a", "y", logit(0.1))] + [("b", "x", logit(0.2))] * 200 + [("c", None, logit(0.99))] + [(None, "x", logit(0.5))] * 3
    sites, base, k_host, k_path = site_sums(spark.createDataFrame(rows, "host string, path string, logit double"))
    of = {(r["host"], r["path"]): r for r in sites.collect()}
    assert len(of) == 5 and 0.5 < base < 0.6 and k_host >= 1 and k_path >= 1
    assert of["a", "x"]["s"] == pytest.approx(180) and of["a", "y"]["host_n"] == 201 and of[None, "x"]["host_s"] == pytest.approx(1.5)


def brute(x, weights, sites):
    """p_host, p_path and p_quality by plain sums over all other rows."""
    p = 1 / (1 + np.exp(-np.clip(_expand(x) @ weights, -12, 12)))
    hosts = sorted({h for h, _ in sites}, key=str)
    groups = lambda key: {k: np.array([key(s) == k for s in sites]) for k in map(key, sites)}
    base = min(max(p.mean(), 0.01), 0.99)

    def strength(rows):  # (n, s, prior)
        n, s, m = map(np.array, zip(*rows, strict=True))
        variance = ((n * (s / n - m) ** 2).sum() - (m * (1 - m)).sum()) / n.sum()
        return min(max((n * m * (1 - m)).sum() / n.sum() / variance - 1, 1.0), 1e4) if variance > 1e-9 else 1e4

    by_host, by_site = groups(lambda s: s[0]), groups(lambda s: s)
    k0 = strength([(by_host[h].sum(), p[by_host[h]].sum(), base) for h in hosts])
    prior = {h: (p[by_host[h]].sum() + k0 * base) / (by_host[h].sum() + k0) for h in hosts}
    k1 = strength([(w.sum(), p[w].sum(), prior[s[0]]) for s, w in by_site.items()])
    out = []
    for i, s in enumerate(sites):
        others = np.arange(len(p)) != i
        host, path = by_host[s[0]] & others, by_site[s] & others
        ph = (p[host].sum() + k0 * base) / (host.sum() + k0)
        pp = (p[path].sum() + k1 * ph) / (path.sum() + k1)
        clipped = min(max(pp, 0.01), 0.99)
        odds = p[i] / (1 - p[i]) * clipped / (1 - clipped) / (base / (1 - base))
        out.append((ph, pp, odds / (1 + odds)))
    return out


@pytest.mark.parametrize("broadcast", [20_000, 2])
def test_posteriors_are_those_of_brute_force(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(Q, "BROADCAST_SITES", broadcast)
    weights = np.random.default_rng(1).normal(size=2 * Q.FEATURES + 1)
    got = {r["doc_id"]: r for r in quality(docs.withColumns({"logit": F.lit("x"), "host": F.lit(1), "n": F.lit(2), "row": F.lit(3)}), docs.limit(0), weights=weights, label="n_chars").collect()}
    rows = docs.collect()
    expected = brute(np.array([Q.features(r["text"]) for r in rows]), weights, [(r["source"], r["lang"]) for r in rows])
    assert len(got) == len(rows)
    for r, e in zip(rows, expected, strict=True):
        g = got[r["doc_id"]]
        assert (g["p_host"], g["p_path"], g["p_quality"]) == pytest.approx(e, abs=1e-6) and (g["logit"], g["host"], g["n"], g["row"]) == ("x", 1, 2, 3)


def test_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (27 * 3, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality long, toxic long")
    got = quality(docs, labels)
    assert got.count() == docs.count()
    assert got.columns == [*docs.columns, "p_doc", "p_host", "p_path", "p_quality", "keep"]
    assert got.where("p_quality is null or keep is null or p_quality < 0 or p_quality > 1").count() == 0
    assert quality(nothing, labels.limit(0)).collect() == []
    assert len(train(docs, labels.limit(0))) > 0
    again = quality(docs.repartition(5), labels)
    close = lambda df: {r["doc_id"]: round(r["p_quality"], 9) for r in df.collect()}
    assert close(again) == close(got)
