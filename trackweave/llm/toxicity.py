"""Toxicity by compression distance: how much shorter windows of a text become with a dictionary of toxic text at hand."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns

#: The model is trained on at most so many texts of each class, the first by a hash of their key, and on so many characters of each, from a place that the hash gives.
MAX_EACH, MAX_CHARS = 4_000, 12_000
#: Windows start at a word near every STEP-th byte and end with one, WINDOW bytes later at most.
WINDOW, STEP = 48, 24
#: A text is compressed as UNIT bytes for each of its own, which stand for the bytes of its word up to there, the last SPAN of them at most.
UNIT, SPAN = 2, 8
#: Bytes of the dictionary of ordinary text, and of the one of toxic text that comes on top of it.
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 8_192
#: Windows of ordinary text that its dictionary is trained on.
ORDINARY_WINDOWS = 20_000
#: A passage is toxic where starts of words are in more toxic texts than chance has them by MARGIN standard deviations, LEAST_TEXTS at least.
MARGIN, LEAST_TEXTS = 5.0, 3
#: Differences and gains in bytes beyond these count as these.
MOST_APART, MOST_GAIN = 20, 40
GAINS = MOST_GAIN + 1
#: Bytes of text, or of its coded form, that are compressed in one call.
SLICE = 1 << 20
#: Differences whose windows are counted, and of which the shares are looked at.
COUNTED, SHARED = (1, 2, 3, 4, 5, 6, 8), (2, 3, 4, 5)
CODES = (2 * MOST_APART + 1) * GAINS


def windows(data: bytes) -> np.ndarray:
    """(start, length) of windows that cover all bytes; any word of up to STEP bytes is whole in one of them."""
    n = len(data)
    start = np.arange(0, n, STEP)
    space = np.flatnonzero(np.frombuffer(data, np.uint8) <= 32)
    end = np.minimum(start + WINDOW, n)
    if len(space):
        after = np.append(space, n)[np.searchsorted(space, start)]
        start = np.where(after - start < STEP, after, start)
        start[:1] = 0
        start = np.unique(start[start < n])
        end = np.minimum(start + WINDOW, n)
        last = space[np.maximum(np.searchsorted(space, end) - 1, 0)]
        end = np.where((end < n) & (last > start + STEP), last + 1, end)
    return np.stack([start, end - start], 1).astype(np.uint64)


def word_starts(data: bytes) -> np.ndarray:
    """For each byte, where its word begins: at the last byte up to there that is no letter or digit, -1 if there is none."""
    a = np.frombuffer(data, np.uint8)
    within = ((a >= 97) & (a <= 122)) | ((a >= 48) & (a <= 57)) | (a >= 128)
    return np.maximum.accumulate(np.where(within, np.int32(-1), np.arange(len(a), dtype=np.int32)))


def runs(data: bytes, starts: np.ndarray, form: type = np.uint32) -> np.ndarray:
    """A hash for each byte of the bytes from its word's start up to there, of the last SPAN of them where there are more."""
    a, depth = np.frombuffer(data, np.uint8).astype(form) + form(1), np.minimum(np.arange(len(data), dtype=np.int32) - starts, SPAN).astype(np.uint8)
    h, power = a.copy(), form(1)
    with np.errstate(over="ignore"):
        for j in range(1, min(SPAN, len(a))):
            power = power * form(0x9E3779B1)
            h[j:] += a[:-j] * power * (depth[j:] >= j)
        half = form(4 * h.itemsize - 1)
        h = (h ^ (h >> half)) * form(0x85EBCA77)
        return h ^ (h >> half)


def coded(data: bytes) -> bytes:
    """UNIT bytes for each byte: a hash of its word up to there.

    Letters cost a few bits each in plain text, so a short word stem gains less than a byte from a dictionary; here it gains bytes for each letter. And the stem
    differs from the same letters further on in words, even if it is made of the language's commonest syllables.
    """
    return (runs(data, word_starts(data)) >> np.uint32(32 - 8 * UNIT)).astype(f"<u{UNIT}").tobytes()


def slices(text: str | None) -> Iterator[bytes]:
    """The text in lower case, cut at white space into parts of about SLICE bytes."""
    data, at = (text or "").lower().encode(), 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def grams(data: bytes, size: int) -> np.ndarray:
    """A hash of each run of `size` bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(0, len(a) - size + 1), np.uint64)
    for j in range(size):
        h = h * np.uint64(0x2545F4914F6CDD1D) + a[j : j + len(h)]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def distinct_texts(texts: list[bytes]) -> list[bytes]:
    """Texts of which less than half has been in one before, so that a group of copies counts once."""
    seen: set[int] = set()
    out = []
    for data in texts:
        some = grams(data, 24)
        some = set(some[some % np.uint64(16) == 0].tolist())
        if len(some) < 4 or 2 * len(some & seen) < len(some):
            out.append(data)
            seen |= some
    return out


def _text_counts(texts: list[bytes], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of starts of words and the number of texts that have each; those among some sorted hashes alone, or else those in LEAST_TEXTS at least."""
    found = []
    for x in texts:
        h = np.unique(runs(x, word_starts(x), np.uint64))
        found.append(h if among is None else h[_count_of((among, np.ones(len(among), np.int64)), h) > 0])
    names, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
    kept = n >= (LEAST_TEXTS if among is None else 1)
    return names[kept], n[kept]


def _count_of(counts: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    names, n = counts
    if not len(names):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[at] == h, n[at], 0)


def toxic_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Passages of toxic texts, in coded form, whose starts of words are in far more toxic texts than their share of ordinary ones lets expect; each from its word's start on."""
    of, out = _text_counts(toxic), []
    against = _text_counts(ordinary, of[0])
    for data in toxic:
        starts = word_starts(data)
        h = runs(data, starts, np.uint64)
        n, share = _count_of(of, h), (_count_of(against, h) + 0.5) / (len(ordinary) + 1)
        share = np.minimum(share, 1.0)
        often = (n - len(toxic) * share >= MARGIN * np.sqrt(len(toxic) * share * (1 - share) + 1)) & (n >= LEAST_TEXTS)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], often.astype(np.int8), [0]])))
        if len(edge):
            y = coded(data)
            out += [y[UNIT * max(0, starts[s]) : UNIT * e] for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on the samples; their last bytes as they are where these are too few for training."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _listed(passages: list[bytes], size: int) -> bytes:
    """A dictionary of the passages themselves, each once, the commonest last: those nearest to the text cost least, and the first are cut off."""
    often = Counter(passages)
    return b"".join(sorted(often, key=lambda p: (often[p], p)))[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionary of ordinary text, and the same with the toxic one behind it.

    What both share costs the same under either, so the lengths of a window differ by what toxic text alone explains.
    """
    ends = np.cumsum([len(windows(x)) for x in ordinary], dtype=np.int64)
    taken = np.sort(np.random.default_rng(1).permutation(ends[-1] if len(ends) else 0)[:ORDINARY_WINDOWS])
    cut = []
    for k, of in enumerate(np.split(taken, np.searchsorted(taken, ends[:-1]))):
        if len(of):
            y, some = coded(ordinary[k]), windows(ordinary[k])[of - (ends[k - 1] if k else 0)] * np.uint64(UNIT)
            cut += [y[s : s + n] for s, n in some.tolist()]
    base = _trained(cut, ORDINARY_BYTES)
    passages = [p for p in toxic_passages(toxic, ordinary) if len(p) > 2 * UNIT]
    return base, base + _listed(passages, TOXIC_BYTES)


class Meter:
    """Codes of windows: the difference of their lengths under the two dictionaries, and what the second one gains."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        size = max(8, len(toxic))
        form = {"source_size": UNIT * WINDOW, "dict_size": size, "format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        parameters = zstandard.ZstdCompressionParameters.from_level(3, **form)
        self.compressors = []
        for data in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None
            if held:
                held.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters))

    def codes(self, data: bytes, cut: np.ndarray) -> np.ndarray:
        a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, cut.tobytes()), threads=1)), np.int64, len(cut)) for c in self.compressors)
        return (np.clip(a - b, -MOST_APART, MOST_APART) + MOST_APART) * GAINS + np.clip(cut[:, 1].astype(np.int64) + 4 - b, 0, MOST_GAIN)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of a text, code) of all windows of the texts, about SLICE bytes of text at a time."""
        held, cuts, of, size = [], [], [], 0

        def measured():
            cut = np.concatenate(cuts)
            return np.repeat(of, [len(c) for c in cuts]), self.codes(b"".join(held), cut)

        for k, text in enumerate(texts):
            for data in slices(text):
                cut = windows(data)
                cut = cut * np.uint64(UNIT)
                cut[:, 0] += np.uint64(size)
                held.append(coded(data))
                cuts.append(cut)
                of.append(k)
                size += UNIT * len(data)
                if size >= SLICE:
                    yield measured()
                    held, cuts, of, size = [], [], [], 0
        if cuts:
            yield measured()


def sums(parts: Iterator[tuple[np.ndarray, np.ndarray]], rows: int, odds: np.ndarray) -> np.ndarray:
    """For each text: windows, summed odds of telling ones and of all, windows at each of COUNTED or more, and the largest difference."""
    out = np.zeros((rows, 4 + len(COUNTED)))
    for of, code in parts:
        apart, given = code // GAINS - MOST_APART, odds[code]
        for k, x in enumerate([np.ones(len(of)), np.where(given > 0.7, given, 0), np.clip(given, -0.2, 9), *((apart >= t).astype(float) for t in COUNTED)]):
            out[:, k] += np.bincount(of, x, rows)
        np.maximum.at(out[:, -1], of, apart)
    return out


def evidence(s: np.ndarray) -> np.ndarray:
    """Features of the sums; all are 0 for a text without windows but the last, a constant."""
    share = lambda t: 3 * np.sqrt(s[:, 3 + COUNTED.index(t)] / np.maximum(s[:, 0], 1))
    return np.stack([np.sqrt(np.clip(s[:, 1], 0, 60)), np.clip(s[:, 2], -100, 100), np.log1p(s[:, 0]), *np.log1p(s[:, 3:-1]).T, *map(share, SHARED), s[:, -1] / 4, np.ones(len(s))], 1)


def calibrated(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights of a ridge logistic regression on evidence, with the intercept set for a share of toxic texts."""
    middle, spread = x[:, :-1].mean(0), x[:, :-1].std(0) + 1e-9
    z = np.hstack([(x[:, :-1] - middle) / spread, x[:, -1:]])
    w, pull = np.zeros(z.shape[1]), np.ones(z.shape[1])
    pull[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * w)
    out = np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())
    out[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    odds: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        global _meter
        if _meter is None or _meter[0] != (hash(self.ordinary), hash(self.toxic)):
            _meter = (hash(self.ordinary), hash(self.toxic)), Meter(self.ordinary, self.toxic)
        x = evidence(sums(_meter[1].texts(texts), len(texts), self.odds))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


_meter: tuple | None = None


def fit(texts: list[tuple[str, int]], share: float) -> Model | None:
    """A model of (text, label) pairs; None if a class has no texts.

    The odds of a window's code and the weights come from texts that the dictionaries in use for them weren't trained
    on: two halves lend each other theirs. The model's own dictionaries are then trained on both.
    """
    kept = [[x.lower().encode() for x, y in texts if y == k] for k in (0, 1)]
    ordinary, toxic = (distinct_texts(k) for k in kept)
    if len(ordinary) < 2 or len(toxic) < 2:
        return None
    measured, totals = [], np.zeros((2, CODES))
    for half in (0, 1):
        meter = Meter(*dictionaries(toxic[1 - half :: 2], ordinary[1 - half :: 2]))
        for label, some in enumerate((ordinary[half::2], toxic[half::2])):
            parts = list(meter.texts([x.decode() for x in some]))
            for _, code in parts:
                totals[label] += np.bincount(code, minlength=CODES)
            measured.append((label, len(some), parts))
    rate = totals[1].sum() / totals.sum()
    odds = np.log((totals[1] + 4 * rate) / (totals[0] + 4 * (1 - rate)) * (1 - rate) / rate)
    x = np.concatenate([evidence(sums(iter(parts), n, odds)) for _, n, parts in measured])
    y = np.concatenate([np.full(n, label) for label, n, _ in measured])
    return Model(*dictionaries(toxic, ordinary), odds, calibrated(x, y, share))


def held_out(key: str) -> F.Column:
    """Whether the checksum of the key's text leaves no remainder by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Model | None, float]:
    """A model from MAX_EACH texts of each class that aren't held out, and the share of toxic labels among all that aren't."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    found = known.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    if not found["n"]:
        return None, 0.0
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(MAX_EACH) for y in (0, 1)]
    size = F.greatest(F.length("t") - MAX_CHARS, F.lit(0))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some[0].union(some[1])), "k")
    rows = rows.select("k", "y", F.substring("t", F.pmod(F.xxhash64("k"), size + 1).cast("int") + 1, F.lit(MAX_CHARS)).alias("t")).groupBy("k", "y").agg(F.min("t").alias("t"))
    got = sorted(rows.where("t IS NOT NULL").select(F.xxhash64("k").alias("h"), "t", "y").collect())
    share = float(found["toxic"]) / found["n"]
    return fit([(r["t"], r["y"]) for r in got], float(np.clip(share, 0.01, 0.99))), share


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", trained: tuple[Model | None, float] | None = None) -> DataFrame:
    """Adds held_out, score and predicted to each row.

    Two zstandard dictionaries come from a bounded sample of labelled texts: one is trained on windows of ordinary ones, one holds
    the passages of toxic ones that set them apart. Each window of a whole text, in its `coded` form, is compressed with the first alone and with the second on
    top; the histogram of the differences is weighed by odds and a logistic regression that come from texts which the dictionaries hadn't seen. `score`
    is the probability of label 1, predicted 1 from 0.5 on. Rows whose key's checksum is a multiple of 5 are held out: never learnt from. Only texts are inputs of a score.

    Null and empty texts are scored as texts without windows; a null key isn't held out; rows may repeat; an empty table gives no
    rows. Without labels of both classes, or texts for them, every score is the share of toxic labels (0 with none). All columns stay, whatever their names, except
    that those named as the new ones are replaced.
    """
    model, share = train(docs, labels, key, text, label) if trained is None else trained
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = shared.value.scores(texts) if shared.value is not None else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("held_out"), pa.array(scores, pa.float64())], ["row", "held_out", "score"])

    kept = columns(docs, "held_out", "score", "predicted")
    rows = docs.select(F.struct(*kept).alias("row"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    form = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, form).select("row.*", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
