"""Target-distribution importance resampling: hashed n-gram features by running checksums, log ratios as weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpoint

#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Digits, small letters and all bytes outside ASCII stay, capital letters become small, all else is a space.
PLAIN = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, a bounded number of bytes at a time; none for a null text."""
    data, at = (text or "").encode().translate(PLAIN), 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def text_buckets(text: str | None, words: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each run of 1 to `words` consecutive words, in one scan.

    A ring holds the running CRC states of the last starts. Each further word extends every state by a space and the
    word, and starts one of its own, so no run is ever put together as a string.
    """
    found, count, ring = [], 0, []
    for some in word_slices(text):
        count += len(some)
        if words == 1:  # each start ends at once: nothing is left to extend
            found.append(np.fromiter(map(crc32, some), np.uint32, len(some)) % buckets)
            continue
        out: list[int] = []
        for w in some:
            ring = [crc32(w, crc32(b" ", s)) for s in ring[-(words - 1) :]]
            ring.append(crc32(w))
            out += ring
        found.append(np.array(out, np.uint32) % buckets)
    return count, np.concatenate(found) if found else np.empty(0, np.uint32)


def _scan(words: int, buckets: int):
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, packed = [], []
            for text in b.column("text"):
                n, found = text_buckets(text.as_py(), words, buckets)
                counts.append(n)
                packed.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["key", "n_words", "packed"])

    return run, kind


def scanned(rows: DataFrame, words: int, buckets: int) -> DataFrame:
    """(key, n_words, packed) of rows (key, text): the buckets of all features as little-endian numbers, two bytes each for up to 65,536 buckets."""
    form = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("packed", T.BinaryType())])
    return rows.select("key", "text").mapInArrow(_scan(words, buckets)[0], form)


def bucket_counts(packed: DataFrame, buckets: int, kind: str) -> np.ndarray:
    """How many features fall into each bucket. A task sends a row for each bucket that it met, and the driver gets one for each there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for p in b.column(0):
                total += np.bincount(np.frombuffer(p.as_buffer(), kind), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in packed.select("packed").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source, one added to each count."""
    s, t, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + buckets)) / ((a + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gains: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, features, noise = [], [], []
            for p, h in zip(b.column("packed"), b.column("h").to_pylist(), strict=True):
                found = np.frombuffer(p.as_buffer(), kind)
                features.append(len(found))
                weight.append(int(gains[found].sum()))
                noise.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            columns = [pa.array(x, pa.int64()) for x in (features, weight, [w + g for w, g in zip(weight, noise, strict=True)])]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_words"), *columns], ["key", "n_words", "n_features", "weight", "score"])

    return run


def importance_resample(
    docs: DataFrame, target: DataFrame, words: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", key: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """Draws the share of `docs` that looks most like `target`, with Gumbel noise: key, n_features, weight, score, rank.

    Features are runs of 1 to `words` words (A-Z in lower case; runs of letters, digits and all beyond ASCII), hashed
    to `buckets`. A bucket's gain is the floored log ratio of its smoothed shares in target and docs; a row's
    weight is the sum over its features, its score the weight plus noise from a hash of seed and key, so that taking the highest
    scores is sampling without replacement in proportion to the ratio. Of the N rows with `least_words` words, floor(percent * N / 100) are drawn;
    `rank` is their place, null for others. Reruns agree.

    Each text is scanned once: its buckets, two bytes a feature, are written to the checkpoint folder, from which counts and weights come.
    The driver holds two numbers for each bucket. Ranks come from a range sort and the sizes of its
    partitions, so no task sees all rows.

    Null and empty texts have no features and weight 0; null keys are hashed as the empty string and come last among ties; repeated rows
    come back as often and take ranks of their own; an empty target has no features; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    kind = _scan(words, buckets)[1]
    rows = checkpoint(scanned(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words, buckets))
    wanted = scanned(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), words, buckets)
    gains = bucket_gains(bucket_counts(rows, buckets, kind), bucket_counts(wanted, buckets, kind))

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    form = T.StructType([rows.schema["key"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    scored = rows.withColumn("h", h).mapInArrow(_weigh(gains, kind), form).withColumn("fit", F.col("n_words") >= least_words)
    # Sorted rows are written, then numbered by their place in a partition and the sizes of those before it.
    ordered = checkpoint(scored.orderBy(F.desc("fit"), F.desc("score"), F.asc_nulls_last("key"), "n_features"))
    placed = ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("fit"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.expr(f"sum(fit) OVER () * {int(percent)} div 100").alias("drawn"))
    ranked = placed.join(F.broadcast(start), "part").withColumn("rank", F.col("start") + F.col("place") + 1)
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", F.when(F.col("fit") & (F.col("rank") <= F.col("drawn")), F.col("rank")).alias("rank"))
