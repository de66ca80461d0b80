"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, columns

#: Frequent pre-tokens in the broadcast table: bounds its size whatever the input.
FREQUENT = 32_768
#: Pre-tokens that one task proposes for it.
PROPOSED = 4_096
#: Bytes of a worker's cache of other pre-tokens.
CACHE = 48_000_000
#: Longer pre-tokens are encoded each time instead of kept.
KEEP_CHARS = 64
#: Pre-tokens held at a time, however long a text is.
AT_ONCE = 100_000
#: Tasks that join the proposals before the driver does.
JOINERS = 16


class Splitter:
    """Splits texts at the tokenizer's special strings and by its pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find, self.iterate = regex.compile(pattern).findall, regex.compile(pattern).finditer
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.frequent: dict[str, int] = {}
        self.known = Recent(CACHE)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def parts(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Lists of up to AT_ONCE pre-tokens, each with the number of special strings before it."""
        pieces = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
        for k, piece in enumerate(pieces):
            if len(piece) <= AT_ONCE:
                yield self.find(piece), int(k > 0)
            else:
                found, specials = (m.group() for m in self.iterate(piece)), int(k > 0)
                while some := list(islice(found, AT_ONCE)):
                    yield some, specials
                    specials = 0

    def lengths(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


_splitters: dict[tuple[str, str], Splitter] = {}


def splitter(path: str, pattern: str) -> Splitter:
    """A worker's splitter; it outlives tasks, and so does its cache of lengths."""
    if (path, pattern) not in _splitters:
        _splitters[path, pattern] = Splitter(path, pattern)
    return _splitters[path, pattern]


# --- tables of pre-tokens as one binary value: counts or lengths, string sizes, then the strings ----------


def packed_table(table: dict[str, int]) -> bytes:
    names = [t.encode() for t in table]
    return b"".join([np.array([len(table), *table.values(), *map(len, names)], "<i8").tobytes(), *names])


def unpacked_table(data: bytes) -> dict[str, int]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    values, sizes = np.frombuffer(data, "<i8", 2 * n, 8).reshape(2, n).tolist()
    ends = np.cumsum([8 * (2 * n + 1), *sizes]).tolist()
    return {data[s:e].decode(): v for s, e, v in zip(ends, ends[1:], values, strict=False)}


def _top(seen: Counter, most: int) -> dict[str, int]:
    return dict(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most])


def _propose(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(path, pattern), Counter()
        for batch in batches:
            for text in batch.column(0):
                for parts, _ in split.parts(text.as_py() or ""):
                    seen.update(parts)
                if len(seen) > 50 * PROPOSED:
                    seen = Counter(dict(seen.most_common(10 * PROPOSED)))
        table = _top(Counter({t: n for t, n in seen.items() if len(t) <= KEEP_CHARS}), PROPOSED)
        yield pa.record_batch([pa.array([zlib.compress(packed_table(table), 1)] if table else [], pa.binary())], ["table"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table of the sums of all, cut to FREQUENT; what is held in between is bounded too."""
    seen: Counter = Counter()
    for batch in batches:
        for table in batch.column(0).to_pylist():
            seen.update(unpacked_table(zlib.decompress(table)))
            if len(seen) > 8 * FREQUENT:
                seen = Counter(_top(seen, 4 * FREQUENT))
    yield pa.record_batch([pa.array([zlib.compress(packed_table(_top(seen, FREQUENT)), 1)] if seen else [], pa.binary())], ["table"])


def frequent_tokens(texts: DataFrame, path: str, pattern: str) -> list[str]:
    """About the FREQUENT most frequent pre-tokens of a column of texts, most frequent first.

    Each task proposes one table of its PROPOSED first; tables, not pre-tokens, go to JOINERS tasks, and one bounded
    table of each of these to the driver.
    """
    proposed = texts.mapInArrow(_propose(path, pattern), "table binary")
    joined = proposed.repartition(JOINERS, F.crc32("table")).mapInArrow(_joined, "table binary")
    total: Counter = Counter()
    for row in joined.collect():
        total.update(unpacked_table(zlib.decompress(row["table"])))
    return list(_top(total, FREQUENT))


def _count(path: str, pattern: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path, pattern)
        split.frequent = frequent = unpacked_table(shared.value)
        known = split.known

        def add(held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
            used: set[str] = set()
            for _, parts in held:
                used.update(parts)
            known.turn()
            todo = known.missing(used - frequent.keys())
            for t, n in zip(todo, split.lengths(todo), strict=True):
                known.put(t, n)
            length = {t: frequent[t] if t in frequent else known.now[t] for t in used}
            for row, parts in held:
                out[row] += sum(map(length.__getitem__, parts))
            for t in todo:
                if len(t) > KEEP_CHARS:
                    known.forget(t)

        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            held, size = [], 0
            for row, text in enumerate(batch.column("text")):
                for parts, specials in split.parts(text.as_py() or ""):
                    out[row] += specials
                    held.append((row, parts))
                    size += len(parts)
                    if size >= AT_ONCE:
                        add(held, out)
                        held, size = [], 0
            add(held, out)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["row", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Counts the tokens of each text as the `tokenizers` file at `path` gives them.

    A first pass finds frequent pre-tokens (`frequent_tokens`), and their lengths are broadcast as one compact table: at
    most FREQUENT strings of KEEP_CHARS characters. The second pass looks lengths up
    there, then in the worker's cache, and encodes what neither has, in batches. The table is a
    cache: it decides on speed, never on counts. No pre-token is a shuffle key.

    `pattern` is the tokenizer's pre-token pattern. Special strings in a text count as one token,
    the library's default. Null and empty texts have 0 bytes and 0 tokens; rows may repeat; an
    empty table gives no rows. All input columns but the text stay, whatever their names; n_bytes, n_tokens and
    over_limit are added and replace columns of these names.
    """
    tokens = frequent_tokens(docs.select(F.col(text)), path, pattern)
    lengths = dict(zip(tokens, Splitter(path, pattern).lengths(tokens), strict=True)) if tokens else {}
    shared = docs.sparkSession.sparkContext.broadcast(packed_table(lengths))

    kept = columns(docs, text, "n_bytes", "n_tokens", "over_limit")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*kept, size.alias("n_bytes")).alias("row"), F.col(text).alias("text"))
    form = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(_count(path, pattern, shared), form)
    return counted.select("row.*", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
