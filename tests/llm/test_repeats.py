import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from massgrid.llm import repeats
from massgrid.llm.bytesops import text_bytes


def covered(texts, length):
    """Which bytes of each text a repeated window covers, from a count of all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = [np.zeros(len(r), bool) for r in raws]
    for r, gone in zip(raws, out):
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
    return out


def brute(texts, length=400):
    """(bytes, removed, runs, digest of the rest) of each text."""
    out = []
    for t, gone in zip(texts, covered(texts, length)):
        r = (t or "").encode()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def test_interval_expansion_against_counts():
    rng = random.Random(9)
    for trial in range(120):
        length = rng.choice([1, 2, 3, 5, 8])
        parts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        raw, offsets = text_bytes(pa.array(parts, pa.binary()))
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [i + length <= len(p) and seen[p[i : i + length]] > 1 for p in parts for i in range(len(p))]
        assert repeats.long_matches(raw, offsets, length).tolist() == want


def passages(seed=4):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [prose(n) for n in (380, 420, 700, 1500)]
    texts = [prose(300) + rng.choice(shared) + prose(rng.choice([0, 50, 900])) + rng.choice(shared) for _ in range(25)]
    return texts + [texts[0], texts[0], shared[3], "ab" * 500, prose(399), shared[1][:399]]


def check(frame, texts, length=400):
    got = {}
    for r in frame.collect():
        got[r.doc_id] = (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_against_all_windows(table, odd_texts):
    texts = passages() + odd_texts
    check(repeats.without_repeats(table(texts)), texts)


def test_shorter_repeats(table, odd_texts, monkeypatch):
    texts = passages(6) + odd_texts
    check(repeats.without_repeats(table(texts), length=200), texts, 200)
    monkeypatch.setattr(repeats, "HOT", 2)
    check(repeats.without_repeats(table(texts), length=90), texts, 90)


def test_text_is_cut_at_characters(table):
    """The passage is preceded and followed by characters that share a byte: these stay whole."""
    core = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    texts = ["x\u00e9" + core + "\u00e9y", "z\u0129" + core + "\u00e8w", "\u00e9" * 300 + "q"]
    out = {r.doc_id: r.kept for r in repeats.without_repeats(table(texts), as_text=True).collect()}
    assert out == {0: "x\u00e9\u00e9y", 1: "z\u0129\u00e8w", 2: "q"}
    assert repeats.whole_characters("a\u20acb".encode(), [(0, 2), (2, 5)]) == [(0, 1), (4, 5)]


def test_short_runs_stay_unless_they_have_many_words(table):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    few, many, long = (" ".join(word(n) for _ in range(k)) for n, k in ((8, 30), (4, 60), (600, 1)))
    texts = [f"{word(9)} {few} {word(30)}|{many}|{word(30)}{long}{word(20)}" for _ in range(2)]
    for r in repeats.without_repeats(table(texts), as_text=True, length=200, words=50).collect():
        assert few in r.kept and many not in r.kept and long not in r.kept and r.n_bytes - len(r.kept) <= 60 * 5 + 600 + 4


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(60):
        parts = [[rng.randint(0, 3) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 6))]
        symbols = np.array([x for i, p in enumerate(parts) for x in [*(c + len(parts) for c in p), i]])
        assert repeats.suffix_order(symbols, len(parts)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


def test_hot_anchors_and_long_texts(table, monkeypatch):
    texts = passages(5)
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "LONG_TEXT", 800)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 900)
    check(repeats.without_repeats(table(texts)), texts)


def test_large_groups_by_windows():
    rng = random.Random(2)
    core = bytes(rng.choice(b"abcd") for _ in range(30))
    parts = [bytes(rng.choice(b"ab") for _ in range(6)) + core + bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(40)]
    raw, offsets = text_bytes(pa.array(parts, pa.binary()))
    seen = Counter((i, p[i : i + 34]) for p in parts for i in range(len(p) - 33))
    want = [i + 34 <= len(p) and seen[i, p[i : i + 34]] > 1 for p in parts for i in range(len(p))]
    assert repeats.aligned_matches(raw, offsets, np.full(len(parts), 6), 34).tolist() == want


def test_carried_columns_and_empty_table(table, empty):
    docs = table(["x" * 500, None])
    out = repeats.without_repeats(docs, ("score", "spans"), as_text=True).collect()
    assert {(r.doc_id, r.kept, r.carried.score, r.carried.spans) for r in out} == {(0, "", 0.5, "x"), (1, "", 0.5, "x")}
    assert repeats.without_repeats(empty).count() == 0


def test_a_passage_in_many_documents_sends_few_copies(table, monkeypatch):
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = prose(900)
    texts = [prose(rng.randint(30, 300)) + shared + prose(rng.randint(30, 300)) for _ in range(60)]
    texts += [prose(50) + shared[a : a + 430] + prose(50) for a in range(0, 460, 23)]
    monkeypatch.setattr(repeats, "HOT", 8)
    resolve = repeats._resolve

    def bounded(length):
        def run(found):
            assert max(Counter(found["key"].to_pylist()).values()) <= 8
            return resolve(length)(found)

        return run

    monkeypatch.setattr(repeats, "_resolve", bounded)
    check(repeats.without_repeats(table(texts)), texts)


def passages_by_words(texts, length):
    """Maximal runs, in words, that repeated sequences of so many words cover, from a count of all."""
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w) + 2, int)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i + 1 : i + 1 + length] = 1
        step = np.diff(gone)
        out.append(list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())))
    return out


def passages_found(frame, texts):
    got = {r.doc_id: [(x.s, x.e) for x in r.passages] for r in frame.collect()}
    return [got[i] for i in range(len(texts))]


def wordy(seed):
    """Texts with common passages of 50 to 300 words of four bytes; the shortest have far under 400 bytes."""
    rng = random.Random(seed)
    prose = lambda n: rng.choice([" ", "\n", " \t"]).join("".join(rng.choice("abcdefgh\u00e9") for _ in range(3)) for _ in range(n))
    shared = [prose(n) for n in (50, 51, 55, 90, 300)]
    texts = [f"{prose(40)} {rng.choice(shared)} {prose(rng.choice([1, 9, 120]))}\n{rng.choice(shared)} {prose(5)}" for _ in range(40)]
    return texts + [texts[0], shared[1], "a b " * 90, "x " * 50, "y " * 52, prose(50)]


def test_passages_by_words_against_counts(table, odd_texts, monkeypatch):
    texts = wordy(3) + odd_texts
    want = passages_by_words(texts, 51)
    assert passages_found(repeats.without_repeats(table(texts), passage=51), texts) == want
    assert {e - s for runs in want for s, e in runs} >= {51, 55, 90, 300}
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "LONG_TEXT", 100)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 300)
    check(frame := repeats.without_repeats(table(texts), passage=20), texts)
    assert passages_found(frame, texts) == passages_by_words(texts, 20)


def test_op7_counts_passages_under_400_bytes_and_leaves_them(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    shared = prose(55)
    texts = [f"{prose(30)} {shared} {prose(20)}", f"{prose(10)} {shared}", prose(120), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(repeats.query(spark, str(tmp_path)).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)
    assert [(r.n_removed, r.n_passages, r.n_passage_words) for r in rows] == [(0, 1, 55), (0, 1, 55), (0, 0, 0), (0, 0, 0)]
