"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Recent

SPACE = "▁"
#: Bytes of a worker's cache of chunks.
CACHE = 32_000_000
KEEP_CHARS = 64
MARKS, LETTER = string.punctuation, "[A-Za-z\u00c0-\u024f]"
#: Characters of text encoded at a time.
AT_ONCE = 500_000


class PieceCodec:
    """Encodes with an agenda of adjacent symbol pairs, best score first, leftmost on ties.

    No merge joins two characters that stand side by side in no piece. So a text is cut
    at line ends, before spaces and, where no piece has a letter before them, before punctuation marks;
    each chunk is encoded once and kept. Each new chunk is checked against the sentencepiece library, a batch at a time.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.piece = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.rank = {self.piece[i]: -self.library.get_score(i) for i in plain}
        self.id = {self.piece[i]: i for i in plain}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.as_byte = {i: b for b, i in self.byte.items()}
        self.shown = ["" if self.library.is_control(i) else self.piece[i].replace(SPACE, " ") for i in range(size)]
        if len(self.byte) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("the vocabulary needs byte pieces, and space marks only in front")
        if any("\n" in p for p in self.rank):
            raise ValueError("pieces with line ends aren't supported")
        # Marks that no piece has behind a letter.
        behind = {b for p in self.rank for a, b in zip(p, p[1:], strict=False) if re.match(LETTER, a)}
        m = re.escape("".join(sorted(set(MARKS) - behind)))
        self.cut = re.compile(rf" *[{m}]*[^ \n{m}]+(?:(?<!{LETTER})[{m}]+[^ \n{m}]*)*| *[{m}]+| +|\n" if m else r" *[^ \n]+| +|\n").findall
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.cache = Recent(CACHE)
        self.long: list[str] = []  # chunks of the last call that aren't kept
        #: Chunks whose decoded text isn't the chunk itself; and how often the library's ids were not the agenda's.
        self.odd: dict[str, str] = {}
        self.differed = 0
        for text in ("", " a", "a  b\n\n c\t\x00d", "<s>é\U0001d4b3 ▁x"):  # normalisation other than this codec's
            if self.decode(self.encode(text)) != self.library.decode(self.library.encode(text)):
                raise ValueError("unsupported normalisation")

    def agenda(self, text: str) -> list[int]:
        """Ids of one chunk, spaces already marked."""
        symbols, rank = list(text), self.rank.get
        end = len(symbols)
        heap = [(score, i, pair) for i, pair in enumerate(map(add, symbols, symbols[1:])) if (score := rank(pair)) is not None]
        if heap:
            before, after = list(range(-1, end)), list(range(1, end + 1))
            heapify(heap)
            while heap:
                _, i, pair = heappop(heap)
                j = after[i]
                if j >= end or not symbols[i] or symbols[i] + symbols[j] != pair:
                    continue  # one of the two has been merged since
                symbols[i], symbols[j] = pair, ""
                after[i] = k = after[j]
                before[k] = i
                if k < end and (score := rank(new := pair + symbols[k])) is not None:
                    heappush(heap, (score, i, new))
                k = before[i]
                if k >= 0 and (score := rank(new := symbols[k] + pair)) is not None:
                    heappush(heap, (score, k, new))
        ids = []
        for s in symbols:
            if s:
                if (hit := self.id.get(s)) is not None:
                    ids.append(hit)
                else:
                    ids += [self.byte[b] for b in s.encode()]
        return ids

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids, with the space that encoding put in front."""
        if self.as_byte.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out = b"".join([bytes([self.as_byte[i]]) if i in self.as_byte else self.shown[i].encode() for i in ids])
        return out.decode("utf-8", "replace")

    def chunks(self, text: str) -> list[str]:
        return self.cut((" " + text).replace(SPACE, " ")) if text else []

    def learn(self, new: list[str]) -> None:
        """Encodes chunks and holds each against the library, whose ids are taken (and counted) where they differ."""
        mine = [self.agenda(c.replace(" ", SPACE)) for c in new]
        theirs = self.library.encode(["\n" + c for c in new], num_threads=1)
        back = self.library.decode([t[2:] for t in theirs], num_threads=1)
        for chunk, ids, other, their_text in zip(new, mine, theirs, back, strict=True):
            text = self.pieces_text(ids)
            if ids != other[2:] or (text[1:] if text[:1] == " " else text) != their_text:
                self.differed += 1
                ids = other[2:]
                text = self.pieces_text(ids)
            self.cache.put(chunk, np.array(ids, "<u4").tobytes(), 4 * len(ids))
            if text != chunk:
                self.odd[chunk] = text

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The texts' chunks, all of them known from here to the next call."""
        cut = [self.chunks(t or "") for t in texts]
        used: set[str] = set()
        for chunks in cut:
            used.update(chunks)
        self.cache.turn()
        for c in self.long:
            self.cache.forget(c, len(self.cache.now[c])) if c in self.cache.now else None
        if self.odd:
            self.odd = {c: t for c, t in self.odd.items() if c in self.cache.now or c in self.cache.old}
        new = self.cache.missing(used)
        self.learn(new)
        self.long = [c for c in new if len(c) > KEEP_CHARS]
        return cut

    def packed(self, chunks: list[str]) -> tuple[bytes, str]:
        """All ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
        ids = b"".join(map(self.cache.now.__getitem__, chunks))
        text = "".join([self.odd.get(c, c) for c in chunks] if self.odd else chunks)
        return self.bos.to_bytes(4, "little") + ids + self.eos.to_bytes(4, "little"), text[1:]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(self.prepare([text])[0])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """A worker's codec; it outlives tasks, and so does what it has learnt, in a cache of CACHE bytes."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encode(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and chars < AT_ONCE:
                    texts.append(batch.column(column)[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                rows = [pieces.packed(chunks) for chunks in pieces.prepare(texts)]
                arrays = [c.slice(at, len(rows)) for c in batch.columns]
                arrays += [pa.array([ids for ids, _ in rows], pa.binary()), pa.array([text for _, text in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "ids", "decoded"])
                at += len(rows)

    return run


def encode_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `ids` (binary: little-endian unsigned 32-bit, with begin and end ids) and `decoded`.

    Null and empty texts give begin and end alone, decoded to "". Space marks in a text
    (U+2581) decode to spaces, as the library has it. Rows may repeat; an empty
    table gives no rows; other columns stay, columns named ids or decoded are replaced.
    """
    rows = docs.drop("ids", "decoded")
    return rows.mapInArrow(_encode(path, text), T.StructType([*rows.schema, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def digest(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids and SHA-256 of ids and decoded text, without sending either to the JVM."""
    encode = _encode(path, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in encode(batches):
            ids, decoded = b.column("ids").to_pylist(), b.column("decoded").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(x.encode()) for x in decoded])], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
