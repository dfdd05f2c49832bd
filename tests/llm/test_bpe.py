import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from massgrid.llm import bpe, chunks
from massgrid.llm.bytesops import text_bytes

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens)}, special_tokens={})


def test_like_the_library(vocabulary, library):
    rng = random.Random(5)
    signs = "aaab eé  \n\t.,'s 't 　\x1c\x85日本кот019²½ñ😀👩‍👩 \r\n"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * n for n in range(40)] + [" " * n for n in range(20)] + [None, "", "it's  don't"]
    ids, ends = vocabulary.encode(*text_bytes(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode_ordinary(t or ""), t


def test_replay_like_word_by_word(vocabulary):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))).encode() for _ in range(400)]
    ids, ends = vocabulary.replay(words)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [vocabulary.by_word(w) for w in words]


def test_tables(table, empty, odd_texts, library):
    out = bpe.decode(bpe.encode(table(odd_texts), PATH, P.PATTERN), PATH).collect()
    for r in out:
        assert r.ids == library.encode_ordinary(odd_texts[r.doc_id] or "")
        assert bytes(r.decoded) == (odd_texts[r.doc_id] or "").encode()
    assert len(out) == len(odd_texts)
    assert bpe.decode(bpe.encode(empty, PATH, P.PATTERN), PATH).count() == 0


def thue_morse(n, letters="ab"):
    """Equal under any polynomial modulo 2**64 to the same with letters exchanged, from 1024 letters on."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_unlike_pieces_never_share_ids(vocabulary, library, n):
    for letters in ("ab", "ba", "xy", "yx"):  # one after another, as blocks of one worker
        text = thue_morse(n, letters)
        ids, _ = vocabulary.encode(*text_bytes(pa.array([text])))
        assert b"".join(vocabulary.tokens[i] for i in ids) == text.encode()
        assert ids.tolist() == library.encode_ordinary(text)


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all pieces every piece still gets its own ids."""
    monkeypatch.setattr(chunks, "word_hashes", lambda raw, start, end, *_, **__: np.zeros(len(start), np.uint64))

    def encode(pieces):
        lists = [list(p.as_py()) for p in pieces]
        return np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)])

    known = chunks.ChunkIds(encode)
    for pieces in ([b"abc", b"xyz", b""], [b"xyz", b"ab", b"abc"], [b"q" * 1000, b"abc", b"x"], [b"q" * 1000, b"ab"]):
        ids, ends = known.lookup(pa.array(pieces, pa.binary()))
        assert [bytes(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])] == pieces
    assert len(known.bytes) < 100
