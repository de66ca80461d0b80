"""N-gram Jaccard join by rare-first prefix filtering."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions
from .components import components

#: The frequency sketch and the id filter have fixed sizes, whatever the input. The sketch's cells must stay few n-grams wide: where
#: all cells are full, frequent n-grams look rare, and the long runs that they make connect texts that have nothing else in common.
CELL_BITS, BLOCKS = 23, 16
FILTER_BITS = 23
#: Runs of up to so many nodes are paired in full; longer ones first with one node of each block.
SMALL, BLOCK = 32, 4096
#: A cell of the all-pairs comparison holds two blocks of about so many nodes and n-grams at most.
CELL_NODES, CELL_GRAMS = 512, 2_000_000
#: Copies of a cluster's row, for the join with its members.
SALTS = 16
#: Hash ranges of the suffix filter.
RANGES = 64
WORDS_AT_ONCE = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: full avalanche, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x2545F4914F6CDD1D
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 2 * len(_powers)), BASE, np.uint64)
        out[0] = 1
        _powers = np.cumprod(out, dtype=np.uint64)
    return _powers[:n]


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; fewer words make one n-gram."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z alone, ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    found = []
    for at in range(0, len(words) - size + 1, WORDS_AT_ONCE):
        some = words[at : at + WORDS_AT_ONCE + size - 1]
        length = np.fromiter(map(len, some), np.int64, len(some))
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        data = np.frombuffer(b"".join(some), np.uint8)
        inside = np.arange(len(data)) - np.repeat(start, length)
        word = _mix(np.add.reduceat(BYTE[data] * powers(int(length.max()))[inside], start) + length.astype(np.uint64))
        gram = np.zeros(len(some) - size + 1, np.uint64)
        for j in range(size):
            gram = gram * np.uint64(BASE) + word[j : j + len(gram)]
        found.append(_mix(gram))
    return np.unique(np.concatenate(found))


def least_overlap(a, b, share: tuple[int, int]):
    """Fewest common n-grams of two sets of these sizes with a Jaccard similarity of share or more."""
    num, den = share
    return -((-num * (a + b)) // (num + den))


def prefix_length(n: int, share: tuple[int, int]) -> int:
    num, den = share
    return n - -(-num * n // den) + 1


# --- fixed-size tables, added up block by block --------------------------------------------------


def _packed(part: np.ndarray) -> bytes:
    """Compressed byte by byte of the cells: the upper ones are nearly all zero."""
    return zlib.compress(part.view(np.uint8).reshape(-1, part.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _blocks(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k, part in enumerate(np.split(table, BLOCKS)):
        if part.any():
            yield k, _packed(part)


def _grade(counts: np.ndarray) -> np.ndarray:
    """Four grades for each doubling of an n-gram's count."""
    return np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)


def _merged(df: DataFrame, kind: str) -> np.ndarray:
    """Grades of the sum (or bitwise or, for bytes) of the tables whose blocks `df` (block, cells) holds.

    Two rounds: tasks each join a share of the blocks, then one task for each block does the rest. Tasks
    hold BLOCKS blocks at most, and the driver gets one table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _unpacked(cells, kind)
                sums[k] = part.copy() if k not in sums else (sums[k] | part if kind == "u1" else sums[k] + part)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([_packed(v) for v in sums.values()], pa.binary())], ["block", "cells"])

    form = "block int, cells binary"
    some = df.repartition(partitions(df.sparkSession), "block", F.crc32("cells")).mapInArrow(run, form)
    size = (1 << FILTER_BITS - 3 if kind == "u1" else 1 << CELL_BITS) // BLOCKS
    table = np.zeros((BLOCKS, size), np.uint8)
    for row in some.repartition(BLOCKS, "block").mapInArrow(run, form).toLocalIterator():
        part = _unpacked(row["cells"], kind)
        table[row["block"]] = part if kind == "u1" else _grade(part)
    return table.reshape(-1)


# --- passes over the texts ------------------------------------------------------------------------


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, kind = np.zeros(1 << CELL_BITS, np.uint32), pa.int64()

        def rows(ids, n, keys, hists, block, data):
            return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(hists, pa.binary()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["id", "n", "node", "hist", "block", "cells"])

        for batch in batches:
            kind = batch.column(0).type
            ns, keys, hists, seen, held = [], [], [], [], 0

            def count():
                at, many = np.unique((np.concatenate(seen) >> np.uint64(64 - CELL_BITS)).astype(np.uint32), return_counts=True)
                cells[at] += many.astype(np.uint32)

            for text in batch.column(1):
                u = shingles(text.as_py(), size)
                ns.append(len(u))
                keys.append(int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True) if len(u) else None)
                hists.append(np.minimum(np.bincount((u >> np.uint64(58)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes() if len(u) else None)
                seen.append(u)
                held += len(u)
                if held > 1_000_000:
                    count()
                    seen, held = [], 0
            if seen:
                count()
            none = [None] * len(ns)
            yield rows(batch.column(0), ns, keys, hists, none, none)
        if found := list(_blocks(cells)):
            none = [None] * len(found)
            yield rows(pa.array(none, kind), none, none, none, [k for k, _ in found], [c for _, c in found])

    return run


def _prefixes(size: int, share: tuple[int, int], frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, done = frequency.value, set()
        names = ["gram", "node", "at"]
        for batch in batches:
            out, held = [], 0
            for text in batch.column(0):
                u = shingles(text.as_py(), size)
                key = int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)
                if not len(u) or key in done:
                    continue
                if len(done) < 200_000:  # copies within a task leave one set of rows
                    done.add(key)
                # Rare first: by the n-gram's frequency grade, then by hash.
                order = (grade[u >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8))
                first = u[np.argsort(order, kind="stable")[: prefix_length(len(u), share)]]
                out.append((first.view(np.int64), np.full(len(first), key), (len(u) << 32) + np.arange(len(first))))
                held += len(first)
                if held > 200_000:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return run


def _pairs(share: tuple[int, int]):
    """Streams runs of equal n-grams, sorted by set size: candidate pairs (kind 0), and for long runs pairs (kind 1) that connect all its nodes."""
    num, den = share
    corners = {k: np.triu_indices(k, 1) for k in range(2, SMALL + 1)}

    def allowed(n, pos, i, j):
        # Length filter, then positional filter: what can still follow the shared n-gram.
        left = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
        return (num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j])) & (left >= least_overlap(n[i], n[j], share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the run at the end of what has been read
        long_run = None
        made: set[tuple[int, int, int]] = set()
        last_low: list[int] = []

        def put(kind: int, x: np.ndarray, y: np.ndarray, out: list) -> None:
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                row = (kind, a, b) if a < b else (kind, b, a)
                if a != b and row not in made:
                    if len(made) > 100_000:
                        made.clear()
                    made.add(row)
                    out.append(row)

        def take(node: np.ndarray, at: np.ndarray, is_long: bool, out: list) -> None:
            n, pos = at >> 32, at & 0xFFFFFFFF
            if not is_long and len(node) <= SMALL:
                if len(node) < 2:
                    return
                i, j = corners[len(node)]
            else:
                low = int(np.argmin(node))
                i, j = np.full(len(node), low), np.arange(len(node))
                put(1, node[i], node, out)
                if last_low:  # blocks of one run hang together
                    put(1, np.array(last_low), node[[low]], out)
                last_low[:] = [int(node[low])]
            ok = allowed(n, pos, i, j)
            put(0, node[i[ok]], node[j[ok]], out)

        def emit(out: list) -> pa.RecordBatch:
            kind, a, b = zip(*out, strict=True)
            return pa.record_batch([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        for batch in batches:
            gram, node, at = (np.concatenate([*(h[k] for h in held), batch.column(k).to_numpy()]) for k in range(3))
            fresh = np.ones(len(gram), bool)  # copies met in other tasks give equal, adjacent rows
            fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            gram, node, at = gram[fresh], node[fresh], at[fresh]
            cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            ends = np.append(cut[1:], len(gram))
            out: list[tuple[int, int, int]] = []
            for s, e in zip(cut[:-1].tolist(), ends[:-1].tolist(), strict=True):
                if gram[s] == long_run:
                    take(node[s:e], at[s:e], True, out)
                elif e - s > 1:
                    last_low.clear()
                    take(node[s:e], at[s:e], e - s > SMALL, out)
            s = int(cut[-1])
            while len(gram) - s > BLOCK:
                if gram[s] != long_run:
                    last_low.clear()
                    long_run = gram[s]
                take(node[s : s + BLOCK], at[s : s + BLOCK], True, out)
                s += BLOCK
            held = [(gram[s:], node[s:], at[s:])]
            if out:
                yield emit(out)
        if held and len(held[0][0]):
            (gram, node, at), out = held[0], []
            if gram[0] != long_run:
                last_low.clear()
            take(node, at, gram[0] == long_run or len(gram) > SMALL, out)
            if out:
                yield emit(out)

    return run


def _close(share: tuple[int, int]):
    """Suffix filter: the sets' counts by hash range differ by no more than the sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            ha, hb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for c in ("ha", "hb"))
            ok = np.abs(ha - hb).sum(axis=1) <= na + nb - 2 * least_overlap(na, nb, share)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _verified(size: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, u = None, None
        for b in batches:
            ok = []
            for a, x, y in zip(b.column("a").to_pylist(), b.column("ta"), b.column("tb"), strict=True):
                if a != last:
                    last, u = a, shingles(x.as_py(), size)
                v = shingles(y.as_py(), size)
                common = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                ok.append(common >= least_overlap(len(u), len(v), share))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: a product of the incidence matrix, without n-grams that only one set has."""
    grams, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, (names, column) = row[keep], np.unique(column[keep], return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(names), 4096):
        s, e = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[s:e], column[s:e] - low] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _plausible(share: tuple[int, int]):
    """Members of one cell that may be linked with one of another label there, by their sizes and the suffix filter: only their texts are fetched."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, label = pdf["n"].to_numpy(), np.unique(np.array(pdf["label"].tolist()), return_inverse=True)[1]
        hist, found = np.frombuffer(b"".join(pdf["hist"]), np.uint8).reshape(-1, RANGES).astype(np.int16), np.zeros(len(pdf), bool)
        for i in range(len(pdf)):
            ok = (label != label[i]) & (np.abs(hist - hist[i]).sum(axis=1) <= n + n[i] - 2 * least_overlap(n, n[i], share))
            found |= ok
        return pdf.loc[found, ["cluster", "lo", "hi", "id", "label"]]

    return run


def _compared(size: int, share: tuple[int, int]):
    """Links of one cell that join its components: all its pairs are looked at, those are kept that connect."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].tolist()
        root = {x: x for x in pdf["label"]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        label, links = pdf["label"].tolist(), []
        if len(root) > 1:
            sets = [shingles(t, size) for t in pdf["text"]]
            n = np.array([len(s) for s in sets])
            alike = np.triu(_overlaps(sets) >= least_overlap(n[:, None], n[None], share), 1)
            code = np.unique(np.array(label), return_inverse=True)[1]
            for i, j in zip(*np.nonzero(alike & (code[:, None] != code[None])), strict=True):
                x, y = find(label[i]), find(label[j])
                if x != y:
                    root[x] = y
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype=pdf["id"].dtype)

    return run


def _salted(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join with a table of one row for each key, of which SALTS copies are made, so that a hot key's rows are spread over tasks."""
    salts = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salts.hint("shuffle_hash"), [key, "salt"]).drop("salt")


def _cells(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Deals members (cluster, id, n, label) to cells (cluster, lo, hi) so that any two of different labels whose sizes allow a link meet in one.

    Sizes fall into classes as wide as the length filter; each class is split by hash into blocks of bounded
    size, apart for the cluster's largest label and the rest. Two blocks of the same or neighbouring classes are a cell, unless
    both are of the largest label: its members hang together already. So a cluster of m members, k of them outside its largest label, takes about k * m comparisons.
    Clusters of a single label are left out.
    """
    sizes = members.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    labels = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    width = float(np.log(share[1] / share[0]))
    rows = _salted(members, labels, "cluster").select("cluster", "id", "label", "n", (F.col("label") == F.col("largest")).alias("main"), F.floor(F.log(F.col("n")) / width + 1e-9).cast("int").alias("size"))
    rows = checkpoint(rows)
    counts = rows.groupBy("cluster", "main", "size").agg(F.ceil(F.greatest(F.count("*") / CELL_NODES, F.sum("n") / CELL_GRAMS)).cast("int").alias("blocks"))
    every = counts.groupBy("cluster").agg(F.collect_list(F.struct("main", "size", "blocks")).alias("every"))  # as many as a cluster has size classes, twice
    name = lambda main, size, block: F.struct(main.alias("main"), size.alias("size"), block.alias("block"))
    met = _salted(rows, every, "cluster")
    mine = F.filter("every", lambda c: (c["main"] == F.col("main")) & (c["size"] == F.col("size")))[0]["blocks"]
    near = F.filter("every", lambda c: (F.abs(c["size"] - F.col("size")) <= 1) & ~(c["main"] & F.col("main")))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: name(c["main"], c["size"], b))))
    met = met.withColumns({"own": name(F.col("main"), F.col("size"), F.pmod(F.xxhash64("id"), mine).cast("int")), "other": F.explode(others)})
    return met.select("cluster", "id", "label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


# --- the join -------------------------------------------------------------------------------------


def bit_table(bits: DataFrame) -> Broadcast:
    """The numbers below 2 ** FILTER_BITS in a one-column table, as a broadcast bitmap of that fixed size: a filter before a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            table[b.column(0).to_numpy()] = True
        found = list(_blocks(np.packbits(table, bitorder="little")))
        yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], ["block", "cells"])

    return bits.sparkSession.sparkContext.broadcast(_merged(bits.mapInArrow(run, "block int, cells binary"), "u1"))


def in_table(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _among(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of `docs` (id, text) that may be among `ids` (id): a fixed-size filter before the shuffle, for the join that follows."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("bit")
    shared = bit_table(ids.select(bit))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_table(shared.value, b.column("bit").to_numpy()))).drop_columns(["bit"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", bit).mapInArrow(kept, f"id {kind}, text string")


def _verify(pairs: DataFrame, docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of ids whose texts' n-grams are similar enough, each checked once."""
    pairs = checkpoint(pairs.select("a", "b").distinct())
    if pairs.isEmpty():
        return pairs
    texts = _among(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    kind = docs.schema["id"].dataType.simpleString()
    return checkpoint(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(_verified(size, share), f"a {kind}, b {kind}"))


def ngram_components(docs: DataFrame, words: int = 5, share: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups rows whose word n-gram sets have a Jaccard similarity of num/den = `share` or more.

    1. One pass gives each text's set size, a key of its set, and counts for a frequency
       sketch of fixed size. Texts with equal sets are one node from here on.
    2. Each node sends its rare-first prefix: as many n-grams as any similar set must
       share one of. Rows with an n-gram in common meet, sorted by set size.
    3. Runs of up to SMALL nodes give all pairs that pass the length and positional filters. In longer runs
       each node is paired with one node of its block. Pairs pass a suffix filter, then
       the texts of what is left are compared, once for each pair; the links' components follow.
    4. Nodes that long runs connect, but links don't yet, are compared in cells: pairs of blocks of bounded
       size, those of the cluster's largest component among themselves left out. Sizes and the suffix filter tell first which members' texts are needed. A cell returns only links that join components,
       so a large group of near copies leaves fewer rows than it has members, and no link between components is lost.

    n-grams are 64-bit hashes. Words are runs of anything but ASCII white space, A-Z in lower case. Null,
    empty and blank texts have no n-grams and are linked with nothing; a text of fewer words
    than `words` has one n-gram. A null key stands alone (component_id null). Keys should
    be unique; rows that repeat come back as often. An empty table gives no rows; other columns are dropped.
    Returns the key, n_shingles and component_id, the least key of the component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    both = checkpoint(docs.mapInArrow(_profile(words), f"id {kind}, n long, node long, hist binary, block int, cells binary"))
    profile = both.where("block is null").select("id", "n", "node", "hist")
    grade = spark.sparkContext.broadcast(_merged(both.where("block is not null").select("block", "cells"), "u4"))

    # Rows without a key have no place in the groups, so they must not stand between others in a run.
    grams = docs.where("id IS NOT NULL").select("text").mapInArrow(_prefixes(words, share, grade), "gram long, node long, at long")
    runs = grams.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "at", "node")
    met = checkpoint(runs.mapInArrow(_pairs(share), "kind int, a long, b long").distinct())

    known = profile.where("n > 0 and id is not null")
    nodes = checkpoint(known.groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n")).join(known.select("id", "hist").dropDuplicates(["id"]), "id"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id"), F.col("n").alias(f"n{x}"), F.col("hist").alias(f"h{x}"))
    met = met.join(side("a"), "a").join(side("b"), "b")
    pairs = met.where("kind = 0").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "na", "nb", "ha", "hb")
    links = _verify(pairs.mapInArrow(_close(share), f"a {kind}, b {kind}"), docs, words, share)

    # What long runs connect, wherever it isn't one component yet.
    ties = checkpoint(met.where("kind = 1").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct())
    if not ties.isEmpty():
        clusters = components(ties).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        label = components(links).withColumnRenamed("node", "id")
        members = clusters.join(nodes.select("id", "n"), "id").join(label, "id", "left").withColumn("label", F.coalesce("component", "id"))
        cells = checkpoint(_cells(members.select("cluster", "id", "n", "label"), share))
        compared = cells.join(nodes.select("id", "n", "hist"), "id").groupBy("cluster", "lo", "hi")
        block = "struct<main: boolean, size: int, block: int>"
        cells = checkpoint(compared.applyInPandas(_plausible(share), f"cluster {kind}, lo {block}, hi {block}, id {kind}, label {kind}"))
        texts = _among(cells.select("id").distinct(), docs)
        cells = cells.join(texts, "id").groupBy("cluster", "lo", "hi")
        links = checkpoint(links.union(cells.applyInPandas(_compared(words, share), f"a {kind}, b {kind}")))

    groups = components(links).withColumnRenamed("node", "least")
    least = nodes.select("node", F.col("id").alias("least")).join(groups, "least", "left").select("node", F.coalesce("component", "least").alias("component"))
    return profile.join(least, "node", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )
