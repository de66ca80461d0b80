"""Quality classifier: document evidence and site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, columns

#: The classifier is fitted on at most so many labelled rows, the first by a hash of their id.
MAX_LABELLED = 20_000
#: So many sites with the most rows are broadcast; the rows of others, of which none is hot, are shuffled to theirs.
BROADCAST_SITES = 20_000
FEATURES = 14
#: Characters told apart: white space, symbols of noise, shouts, bars, digits, ends of sentences; then the rest.
KINDS = (" \t\n\r\x0b\x0c", "*$%&#", "!", "|", "0123456789", ".?")
KIND = np.full(129, len(KINDS), np.int64)
KIND[[*range(65, 91), *range(97, 123), 128]] = len(KINDS) + 1  # letters; what isn't ASCII counts as such
for _k, _chars in enumerate(KINDS):
    KIND[[ord(c) for c in _chars]] = _k
ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> list[float]:
    """Shape of a text: case, symbols, repetition and lengths, each between 0 and about 3."""
    text = text or ""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = np.bincount(KIND[np.minimum(chars, 128)], minlength=len(KINDS) + 2)
    n, words = max(1, len(chars)), text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    space, letters = int(kind[0]), int(kind[-1])
    symbols, shouts, bars, digits, stops = map(int, kind[1:-2])
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    pairs = ids[:-1] * ODD + ids[1:]
    spread = pairs[:-3] * ODD + ids[4:] if len(ids) > 4 else ids[:0]
    repeat = lambda x: 1 - len(np.unique(x)) / max(1, len(x)) if len(x) else 0.0
    return [
        sum(len(x) > 1 for x in filter(str.isupper, words)) / w,
        1 - (letters + space) / n,
        symbols / w,
        shouts / w,
        bars / w,
        digits / n,
        repeat(ids),
        repeat(pairs),
        repeat(spread),
        float((ids[1:] == ids[:-1]).sum()) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        min(3.0, w / max(1, stops) / 20),
        min(3.0, letters / w / 6),
        min(3.0, np.log10(1 + w) / 2),
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their square roots (small shares matter) and a constant."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0)), np.ones((len(x), 1))])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    z = _expand(x)
    w = np.zeros(z.shape[1])
    if not len(y):
        return w
    share = np.clip(y.mean(), 0.02, 0.98)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w
    pull = np.full(len(w), ridge * len(y) / 100)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _texts(b: pa.RecordBatch, text: str) -> pa.Array:
    return b.column("row").field(b.schema.field("row").type.get_field_index(text))


def _rows(text: str, weights: np.ndarray | None):
    """Adds to rows with a struct `row` the features of its text (no weights), or the log odds that they give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in _texts(b, text)], float).reshape(-1, FEATURES)
            if weights is None:
                new, name = pa.array(list(x), pa.list_(pa.float64())), "x"
            else:
                new, name = pa.array(np.clip(_expand(x) @ weights, -12, 12)), "logit"
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, name])

    return run


def _map(df: DataFrame, text: str, weights: np.ndarray | None) -> DataFrame:
    new = T.StructField("x", T.ArrayType(T.DoubleType())) if weights is None else T.StructField("logit", T.DoubleType())
    return df.mapInArrow(_rows(text, weights), T.StructType([*df.schema.fields, new]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights from at most MAX_LABELLED labelled keys, chosen by a hash. A key with several labels counts with their mean; of several texts that with the least features counts."""
    some = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(label).alias("y"))
    some = F.broadcast(some.orderBy(F.xxhash64("k"), "k").limit(MAX_LABELLED))
    found = _map(docs.select(F.col(key).alias("k"), F.struct(F.col(text)).alias("row")).join(some, "k"), text, None).groupBy("k", "y").agg(F.min("x").alias("x"))
    got = sorted(found.collect(), key=lambda r: r["k"])
    return fit(np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["y"] for r in got]))


def _strength(groups: DataFrame, prior: str) -> float:
    """Pseudo-count of a Beta prior by moments: variance of group means beyond what their sizes explain.

    groups: n, s (summed probabilities) and the prior mean of each group.
    """
    m = F.col("s") / F.col("n")
    mean = F.col(prior)
    got = groups.where("n > 0").agg(
        F.sum(F.col("n") * (m - mean) ** 2).alias("between"), F.sum(mean * (1 - mean)).alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * mean * (1 - mean)).alias("spread")
    ).first()
    if not got["n"]:
        return 1.0
    variance = (got["between"] - got["noise"]) / got["n"]
    return float(np.clip(got["spread"] / got["n"] / variance - 1, 1.0, 10_000.0)) if variance > 1e-9 else 10_000.0


def site_sums(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """n and s (summed probabilities) of each (host, path), host_n and host_s of its host; the global mean; the pseudo-counts of hosts and of paths.

    scored: host, path, logit. Partial sums are made before the shuffle, so a hot
    host costs a row for each task. The sums are written to the checkpoint folder: all that follows
    reads them, not the texts again.
    """
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = checkpoint(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = float(np.clip((total["s"] or 0.5) / (total["n"] or 1), 0.01, 0.99))
    k_host = _strength(hosts.withColumn("prior", F.lit(base)), "prior")
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    placed = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(placed.withColumn("prior", (F.col("host_s") + k_host * base) / (F.col("host_n") + k_host)), "prior")
    return placed, base, k_host, k_path


def quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", threshold: float = 0.5, weights: np.ndarray | None = None
) -> DataFrame:
    """Adds p_doc, p_host, p_path, p_quality and keep to each row.

    A logistic regression on the text's shape gives document evidence. Summed over
    all rows it gives hosts and paths posterior means; sparse paths lean to their host, sparse
    hosts to the global mean, by pseudo-counts that come from the data's own moments. A row's own evidence is left out of
    what it gets from its site, so that none is counted twice: p_host and p_path are the posteriors of the others.
    The result's log odds are the document's plus what its path's differ from the global ones.

    The BROADCAST_SITES sites with the most rows are broadcast; rows of others, none of which is hot, meet theirs by a shuffle.

    Null and empty texts are scored by their features like any other; a null host or path is one
    of its own. With no labels, or one class, evidence is the clipped prior. Rows may repeat; an empty table
    gives no rows. Columns named as the new ones are replaced; all others stay, whatever their names.
    """
    new = ["p_doc", "p_host", "p_path", "p_quality", "keep"]
    kept = columns(docs, *new)
    weights = train(docs, labels, key, text, label) if weights is None else weights
    site = [F.col(host).alias("host"), F.col(path).alias("path")]
    sums, base, k_host, k_path = site_sums(_map(docs.select(F.struct(F.col(text)).alias("row"), *site), text, weights).select("host", "path", "logit"))
    of = sums.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_n", "host_s")
    ranked = of.orderBy(F.desc("n"), "h", "p")
    rows = docs.select(F.struct(*kept).alias("row"), *site)
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    if of.count() <= BROADCAST_SITES:
        met = _map(rows.join(F.broadcast(of), same, "left").drop("h", "p"), text, weights)
    else:
        most = checkpoint(ranked.limit(BROADCAST_SITES))
        first = rows.join(F.broadcast(most), same, "left").drop("h", "p")
        rest = first.where("n IS NULL").select("row", "host", "path").join(of.hint("shuffle_merge"), same, "left").drop("h", "p")
        met = _map(first.where("n IS NOT NULL"), text, weights).unionByName(_map(rest, text, weights))
    odds = lambda c: F.log(c / (1 - c))
    met = met.withColumn("p_doc", 1 / (1 + F.exp(-F.col("logit"))))
    met = met.withColumn("p_host", (F.col("host_s") - F.col("p_doc") + k_host * base) / (F.col("host_n") - 1 + k_host))
    met = met.withColumn("p_path", (F.col("s") - F.col("p_doc") + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path))
    clipped = F.least(F.greatest(F.col("p_path"), F.lit(0.01)), F.lit(0.99))
    met = met.withColumn("p_quality", 1 / (1 + F.exp(-(F.col("logit") + odds(clipped) - float(np.log(base / (1 - base)))))))
    return met.select("row.*", "p_doc", "p_host", "p_path", "p_quality", (F.col("p_quality") >= threshold).alias("keep"))
