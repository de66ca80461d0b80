"""Phrase collocations: count tries that grow level by level, merged by prefix range; left parts from a walk, right parts by suffix links."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.ranking import top_k

from .common import checkpoint
from .ngrams import BASE, BYTE, _mix, powers

#: Capital letters become small, what ends a piece a byte that no text has.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
END = b"\xff"
#: Words whose phrases are counted in one go, nodes and words that a shard's trie holds before it is sent, nodes of one serialised block.
CHUNK, HELD, BLOCK = 300_000, 2_000_000, 8192
#: Nodes of one range on average, and blocks whose first paths are looked at for the ranges' bounds.
RANGE, SAMPLE = 250_000, 20_000
#: Bytes of a piece that are split into words at a time.
SLICE = 1 << 21
#: Bits of the filter for each frequent phrase, and the least and largest of its sizes as powers of two: 64 MB at most.
SPREAD, LEAST_BITS, MOST_BITS = 16, 17, 29
#: Bits of a block of the filter, a power of two.
PART = 17
#: Copies of a single word's row, for the join with all phrases that end in it.
SALTS = 16


def word_lists(text: str | None, overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, again): the words of a text, with END after each piece. Of a very long text several lists; `again` words at the start of one are the end of the one before."""
    data, at = (text or "").encode().translate(PLAIN), 0
    last: list[bytes] = []
    while at < len(data):
        end = len(data)
        if end - at > SLICE:
            end = min((x for x in (data.find(c, at + SLICE) for c in (b" ", b"\t", END)) if x >= 0), default=end)
        some = data[at:end].replace(END, b" \xff ").split()
        if end == len(data):
            some.append(END)
        yield last + some, len(last)
        last = (last + some)[-overlap:] if overlap else []
        at = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(words), np.uint8)
    inside = np.arange(len(data)) - np.repeat(start, length)
    return _mix(np.add.reduceat(BYTE[data] * powers(int(length.max()))[inside], start) + length.astype(np.uint64))


def _longer(h: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words from those of k - 1."""
    return h[:-1] * np.uint64(BASE) + w[k - 1 :]


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _place(h: np.ndarray, lang: str, bits: int) -> np.ndarray:
    return (_mix(h ^ _salt(lang)) >> np.uint64(64 - bits)).astype(np.int64)


# --- a shard's trie, one or two levels at a time -----------------------------------------------------


def packed(paths: pa.Array, counts: np.ndarray, ordered: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
    """(nodes, first path, block): the nodes in order of their paths, serialised in blocks."""
    if not ordered:
        order = pc.sort_indices(paths)
        paths, counts = paths.take(order), counts[order.to_numpy()]
    _, ends, data = paths.buffers()
    end = np.frombuffer(ends, np.int32)[paths.offset : paths.offset + len(paths) + 1] if len(paths) else np.zeros(1, np.int32)
    for at in range(0, len(paths), BLOCK):
        some = end[at : at + BLOCK + 1]
        body = data[int(some[0]) : int(some[-1])].to_pybytes()
        head = [np.array([len(some) - 1], "<i8").tobytes(), counts[at : at + BLOCK].astype("<i8").tobytes(), np.diff(some).astype("<i4").tobytes()]
        yield len(some) - 1, body[: some[1] - some[0]], zlib.compress(b"".join([*head, body]), 1)


def unpacked(block: bytes) -> tuple[pa.Array, np.ndarray]:
    data = zlib.decompress(block)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    end = np.zeros(n + 1, np.int32)
    np.cumsum(np.frombuffer(data, "<i4", n, 8 + 8 * n), out=end[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(end.tobytes()), pa.py_buffer(data[8 + 12 * n :])]), np.frombuffer(data, "<i8", n, 8)


class Words(dict):
    """Numbers of words in the order in which they are met; END has 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Trie:
    """The nodes of one language that lie `levels` words deep and all of whose runs of `base` words pass the filter.

    A node is thus added under a frequent parent alone, and if what its suffix link leads to is frequent too. A node is the hash of its
    path, the numbers of its words and a count; paths are put together when the trie is sent.
    """

    def __init__(self, lang: str, levels: tuple[int, ...], base: int, table: np.ndarray, bits: int):
        self.lang, self.levels, self.base, self.table, self.bits = lang, levels, base, table, bits
        self.clear()

    def clear(self) -> None:
        self.words, self.hashes = Words(), word_hashes([END])
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {k: [] for k in self.levels}
        self.nodes, self.settled = 0, 0

    def known(self, h: np.ndarray) -> np.ndarray:
        at = _place(h, self.lang, self.bits)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def count(self, words: list[bytes], again: list[tuple[int, int]]) -> None:
        """`again`: (at, k) where the k words from `at` on have been counted before."""
        before, n = len(self.words), len(words)
        seq = np.fromiter(map(self.words.__getitem__, words), np.int64, n)
        if len(self.words) > before:
            self.hashes = np.concatenate([self.hashes, word_hashes(list(islice(self.words, before, None)))])
        stop = np.append(np.flatnonzero(seq == 0), n)
        left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)  # words to the end of the piece
        old = np.zeros(n, np.int64)
        for at, k in again:
            old[at : at + k] = np.arange(k, 0, -1)
        good = self.known(self.hashes)[seq] if self.base == 1 else None
        h = w = self.hashes[seq]
        for k in range(2, max(self.levels) + 1):
            if k > n:
                break
            h = _longer(h, w, k)
            if k == self.base:
                good = self.known(h)
            if k not in self.levels:
                continue
            new = (left[: len(h)] >= k) & (old[: len(h)] < k)
            for j in range(k - self.base + 1):
                new &= good[j : j + len(h)]
            at = np.flatnonzero(new)
            u, first, times = np.unique(h[at], return_index=True, return_counts=True)
            self.parts[k].append((u, times, seq[at[first][:, None] + np.arange(k)].astype(np.int32)))
            self.nodes += len(u)
        if self.nodes > 2 * self.settled + CHUNK:
            self.settle()

    def settle(self) -> None:
        """Equal nodes of different chunks become one."""
        for k, parts in self.parts.items():
            if len(parts) > 1:
                h, n, path = (np.concatenate(x) for x in zip(*parts, strict=True))
                u, first, of = np.unique(h, return_index=True, return_inverse=True)
                total = np.zeros(len(u), np.int64)
                np.add.at(total, of, n)
                self.parts[k] = [(u, total, path[first])]
        self.nodes = self.settled = sum(len(p[0]) for parts in self.parts.values() for p in parts)

    def sent(self) -> Iterator[tuple[int, bytes, bytes]]:
        self.settle()
        words = pa.array(list(self.words), pa.binary())
        for parts in self.parts.values():
            for _, n, path in parts:
                if len(n):
                    yield from packed(pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in path.T), b" "), n)
        self.clear()


class Roots:
    """The first level, with the root: all words."""

    def __init__(self, lang: str):
        self.lang = lang
        self.seen: Counter = Counter()

    @property
    def nodes(self) -> int:
        return 4 * len(self.seen)  # each takes about as much memory as so many of a trie's

    def count(self, words: list[bytes], again: list[tuple[int, int]]) -> None:
        self.seen.update(words)
        for at, k in again:
            self.seen.subtract(words[at : at + k])

    def sent(self) -> Iterator[tuple[int, bytes, bytes]]:
        self.seen.pop(END, None)
        if n := sum(self.seen.values()):
            self.seen[b""] = n
            yield from packed(pa.array(list(self.seen), pa.binary()), np.fromiter(self.seen.values(), np.int64, len(self.seen)))
        self.seen = Counter()


BLOCKS = "lang string, nodes long, first binary, block binary"


def _grow(levels: tuple[int, ...], base: int, shared, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie | Roots] = {}

        def count(lang: str, words: list[bytes], again: list[tuple[int, int]]) -> None:
            if lang not in tries:
                tries[lang] = Trie(lang, levels, base, *shared.value) if base else Roots(lang)
            tries[lang].count(words, again)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                for n, first, block in trie.sent():
                    yield pa.record_batch([pa.array([lang]), pa.array([n]), pa.array([first], pa.binary()), pa.array([block], pa.binary())], ["lang", "nodes", "first", "block"])
            tries.clear()

        for b in batches:
            held: dict[str, tuple[list[bytes], list[tuple[int, int]]]] = {}
            size = 0
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                for words, again in word_lists(text.as_py(), depth - 1):
                    mine = held.setdefault(lang, ([], []))
                    if again:
                        mine[0].append(END)
                        mine[1].append((len(mine[0]), again))
                    mine[0].extend(words)
                    size += len(words)
                    if len(mine[0]) >= CHUNK:
                        size -= len(mine[0])
                        count(lang, *held.pop(lang))
                    elif size >= 4 * CHUNK:  # many languages, a little of each
                        for name, some in held.items():
                            count(name, *some)
                        held, size = {}, 0
                    else:
                        continue
                    if sum(t.nodes + (len(t.words) if base else 0) for t in tries.values()) > HELD:
                        yield from sent()
            for lang, some in held.items():
                count(lang, *some)
        yield from sent()

    return run


# --- merging by prefix range -------------------------------------------------------------------------


def _key(lang: str, path: bytes) -> bytes:
    return lang.encode() + b"\0" + path


def _dealt(bounds: list[bytes], each: int):
    """Cuts blocks at the bounds between ranges of paths; `each` more parts of a range go by the paths' checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, block in zip(b.column("lang").to_pylist(), b.column("block"), strict=True):
                paths, n = unpacked(block.as_py())
                low = bisect_right(bounds, _key(lang, paths[0].as_py()))
                high = bisect_right(bounds, _key(lang, paths[-1].as_py()))
                at = [0, *(bisect_left(paths, bounds[k], key=lambda p: _key(lang, p.as_py())) for k in range(low, high)), len(paths)]  # noqa: B023
                for k, (s, e) in enumerate(zip(at, at[1:], strict=False)):
                    some, m = paths.slice(s, e - s), n[s:e]
                    of = np.fromiter((crc32(p) % each for p in some.to_pylist()), np.int64, len(some)) if each > 1 else np.zeros(len(some), np.int64)
                    for j in np.unique(of).tolist():
                        mine = np.flatnonzero(of == j)
                        for _, _, data in packed(some.take(pa.array(mine)), m[mine], ordered=True):
                            yield pa.record_batch([pa.array([(low + k) * each + j]), pa.array([lang]), pa.array([data], pa.binary())], ["part", "lang", "block"])

    return run


def _merge(least: int):
    """Merges the blocks of each part, one part after another, and keeps nodes with counts of `least` or more, and the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}

        def added() -> Iterator[pa.RecordBatch]:
            for lang, blocks in held.items():
                paths = pa.chunked_array([p for p, _ in blocks])
                sums = pa.table([paths, pa.array(np.concatenate([n for _, n in blocks]))], ["phrase", "n"]).group_by("phrase").aggregate([("n", "sum")])
                kept = sums.filter(pc.or_(pc.greater_equal(sums["n_sum"], least), pc.equal(sums["phrase"], b"")))
                for b in kept.to_batches():
                    yield pa.record_batch([pa.array([lang] * b.num_rows, pa.string()), b.column("phrase").cast(pa.string()), b.column("n_sum")], ["lang", "phrase", "n"])

        last = None
        for b in batches:
            for part, lang, block in zip(b.column("part").to_pylist(), b.column("lang").to_pylist(), b.column("block"), strict=True):
                if part != last:
                    yield from added()
                    held, last = {}, part
                held.setdefault(lang, []).append(unpacked(block.as_py()))
        yield from added()

    return run


def merged(blocks: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of all serialised tries together.

    Ranges of paths, of about RANGE nodes, are dealt to tasks; their bounds come from the first paths of up to about SAMPLE blocks, so the paths below one
    word may be in several. Blocks are cut at the bounds and shuffled as they are; a task holds one range at a time.
    """
    told = blocks.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.count("*").alias("blocks")).first()
    ranges = -(-told["nodes"] // RANGE) or 1
    some = blocks.where(F.pmod(F.xxhash64("lang", "first"), F.lit(-(-told["blocks"] // SAMPLE) or 1)) == 0).select("lang", "first").limit(4 * SAMPLE)
    heads = sorted(_key(r["lang"], bytes(r["first"])) for r in some.collect()) if ranges > 1 else []
    bounds = sorted({heads[k * len(heads) // ranges] for k in range(1, ranges)}) if heads else []
    dealt = blocks.select("lang", "block").mapInArrow(_dealt(bounds, -(-ranges // (len(bounds) + 1))), "part long, lang string, block binary")
    return checkpoint(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(least), "lang string, phrase string, n long"))


def phrase_filter(frequent: DataFrame, words: int, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes of frequent phrases of so many words, and its bits as a power of two: SPREAD for each phrase, but no more than MOST_BITS.

    It lets all frequent phrases pass, and others now and then; these are counted and then dropped by their counts.
    """
    bits = min(max((SPREAD * count - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def cells(places: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in np.unique(places >> PART).tolist():
            table = np.zeros(1 << PART, np.uint8)
            table[places[places >> PART == part] & ((1 << PART) - 1)] = 1
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([zlib.compress(np.packbits(table, bitorder="little").tobytes(), 1)], pa.binary())], ["part", "cells"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).extend(phrase.encode().split(b" "))
            places = []
            for lang, flat in by_lang.items():
                w = word_hashes(flat).reshape(-1, words)
                h = w[:, 0]
                for j in range(1, words):
                    h = h * np.uint64(BASE) + w[:, j]
                places.append(_place(h, lang, bits))
            if places:
                yield from cells(np.concatenate(places))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table = None, None
        for b in batches:  # sorted by part
            for part, data in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(data), np.uint8)
                if part != last and last is not None:
                    yield pa.record_batch([pa.array([last], pa.int64()), pa.array([table.tobytes()], pa.binary())], ["part", "cells"])
                last, table = part, new if part != last else table | new
        if last is not None:
            yield pa.record_batch([pa.array([last], pa.int64()), pa.array([table.tobytes()], pa.binary())], ["part", "cells"])

    form = "part long, cells binary"
    some = frequent.mapInArrow(hashed, form).repartition("part").sortWithinPartitions("part").mapInArrow(joined, form)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, data in some.toLocalIterator():
        out[part << PART - 3 : (part + 1) << PART - 3] = np.frombuffer(data, np.uint8)
    return out, bits


def frequent_phrases(docs: DataFrame, least: int = 100, depth: int = 5) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to `depth` words with `least` occurrences or more, and for each lang its root: the empty phrase with the number of all words.

    docs: lang (not null), text. The texts are read once for words, for pairs and for triples, and once more for all that is longer.
    """
    spark = docs.sparkSession
    found, levels, base, shared = None, (1,), 0, None
    while levels:
        blocks = checkpoint(docs.mapInArrow(_grow(levels, base, shared, depth), BLOCKS))
        now = merged(blocks, least)
        found = now if found is None else found.unionByName(now)
        base = levels[-1]
        top = now.where("phrase <> ''")
        count = top.count()
        levels = tuple(range(4, depth + 1)) if base == 3 else (base + 1,)
        if base >= depth or not count:
            break
        shared = spark.sparkContext.broadcast(phrase_filter(top, base, count))
    return found


# --- walks and links ---------------------------------------------------------------------------------


def _walk(above):
    """Goes through nodes in order of their paths with those above on a stack: (lang, words, a, n, lefts), lefts being the counts of all proper prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, stack = above.value.get(TaskContext.get().partitionId(), (None, []))
        stack = list(stack)
        for b in batches:
            out = []
            for name, words, n in zip(b.column("lang").to_pylist(), b.column("words").to_pylist(), b.column("n").to_pylist(), strict=True):
                if name != lang:
                    lang, stack = name, []
                while stack and stack[-1][0] != words[: len(stack[-1][0])]:
                    stack.pop()
                if len(words) > 1:
                    out.append((name, words, n, stack[0][1], [m for _, m in stack[1:]]))
                stack.append((words, n))
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["lang", "words", "a", "n", "lefts"])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), b.column("lang").slice(0, 1), b.column("words").slice(0, 1)], ["part", "lang", "words"])
            return


def with_lefts(nodes: DataFrame) -> DataFrame:
    """(lang, words, a, n, lefts) of phrases of two words and more, from (lang, phrase, n) with the roots.

    The nodes are range-sorted by path and written. Each partition is then walked on its own; the nodes above its first
    one, at most depth of them, are told to it. The driver holds these alone.
    """
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    ordered = checkpoint(nodes.select("lang", words.alias("words"), "n").repartitionByRange("lang", "words").sortWithinPartitions("lang", "words"))
    heads = ordered.mapInArrow(_heads, "part int, lang string, words array<string>")
    up = heads.where("size(words) > 0").select("part", "lang", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.slice("words", 1, k))).alias("words"))
    above: dict[int, tuple[str, list]] = {}
    for r in sorted(ordered.join(F.broadcast(up), ["lang", "words"]).collect(), key=lambda r: len(r["words"])):
        above.setdefault(r["part"], (r["lang"], []))[1].append((r["words"], r["n"]))
    shared = nodes.sparkSession.sparkContext.broadcast(above)
    return ordered.mapInArrow(_walk(shared), "lang string, words array<string>, a long, n long, lefts array<long>")


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The phrases of 2 to `depth` words whose parts go together most, for each language: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z in lower case) are cut at `.,;:!?` and line ends, pieces into words at spaces and tabs. a is a phrase's number of
    occurrences, at least `least`; l and r are those of the two parts that the cut of least score floor(1000 * a * n / (l * r)) leaves, n is
    the number of all words of the language. Phrases that occur as often inside a longer one are dropped. The first `top` of each language stay.

    1. Each task counts phrases in a trie, by levels: a node grows only where its parent and its suffix link's target are
       frequent in all texts, which a filter of bounded size tells. Tries are serialised in sorted blocks, written, and merged by ranges of paths.
    2. A walk through the merged nodes in order gives each phrase the counts of its left parts; a join along suffix links those of its right parts. Rows of
       single words, to which very many links may lead, are salted.

    Inside a task phrases of one chunk are told apart by 64-bit hashes; between chunks and tasks by themselves. Null texts are
    empty, a null language is `und`; repeated rows count as often as they are there; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    nodes = frequent_phrases(rows, least, depth)
    phrases = checkpoint(with_lefts(nodes))

    salt = lambda c: F.when(F.instr(c, " ") > 0, 0).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    path = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    named = phrases.withColumn("phrase", F.array_join("words", " "))
    cuts = named.select("lang", "phrase", "words", "a", "n", F.posexplode("lefts").alias("at", "l")).withColumn("k", F.col("at") + 1)
    cuts = cuts.withColumn("link", path(F.col("k") + 1, F.size("words") - F.col("k"))).drop("words", "at").withColumn("salt", salt("link"))
    last = F.when(F.instr("phrase", " ") > 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    ends = nodes.where("phrase <> ''").select("lang", F.col("phrase").alias("link"), F.col("n").alias("r"), F.explode(last).alias("salt"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(ends, ["lang", "link", "salt"]).withColumns({"top": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "bottom": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    within = phrases.where("size(words) > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    first = top_k(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
