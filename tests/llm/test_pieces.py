import hashlib
import random

import numpy as np
import public_tokenizers as P
import sentencepiece

from trackweave.llm import pieces
from trackweave.llm.pieces import PieceCodec, digest, encode_pieces

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_digests_are_the_librarys(docs, texts, nothing):
    expected = {}
    for i, t in texts.items():
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        expected[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids).encode()))
    assert {r[0]: tuple(r[1:]) for r in digest(docs, PATH).collect()} == expected
    assert digest(nothing, PATH).collect() == []


def test_agenda_alone_gives_the_librarys_ids():
    """Without the check against the library: each chunk by its own merges."""
    codec, rng = PieceCodec(PATH), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcdeé étion.,!?-('\"  \n\t1239ß漢\U0001d4b3▁<s>") for _ in range(rng.randint(0, 60)))
        ids = [i for c in codec.chunks(text) for i in codec.agenda(c.replace(" ", pieces.SPACE))]
        assert ids == LIBRARY.encode(text), text
        assert codec.decode(ids) == LIBRARY.decode(ids)


def test_texts_come_back_and_columns_stay(docs):
    got = encode_pieces(docs.drop("ids"), PATH)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "copies", "ids", "decoded"]
    for r in got.collect():
        if "▁" not in (r["text"] or ""):
            assert r["decoded"] == (r["text"] or "")


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 1500)
    codec = PieceCodec(PATH)
    for text in ("one two three four", "five six", "one six " + "z" * 100, "z" * 100):
        assert codec.encode(text) == LIBRARY.encode(text, add_bos=True, add_eos=True)
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(20))
        assert codec.encode(text) == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert codec.cache.held < 10_000 and len(codec.cache.old) + len(codec.cache.now) < 60


def test_the_librarys_ids_are_taken_where_the_agenda_differs(monkeypatch):
    codec = PieceCodec(PATH)
    monkeypatch.setattr(codec, "agenda", lambda text: [5])
    assert codec.encode("other words") == LIBRARY.encode("other words", add_bos=True, add_eos=True)
    assert codec.differed == 2 and codec.packed(codec.prepare(["other words"])[0])[1] == "other words"
