"""Divergences against plain Python with whole numbers, whatever the hash, the blocks and the tiles."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from massgrid.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UP = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top=D.TOP):
    """Rows of the result from (lang, source, text) rows."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UP))) for lang, source, text in rows]
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        every = Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = shares(every), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            order = lambda items: enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1)
            out += [(lang, s, "pair", o, v, k) for k, (o, v) in order([(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}])]
            out += [(lang, s, "term", t, v, k) for k, (t, v) in order([(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]) if k <= top]
    return sorted(out)


def answers(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())


def some_rows(seed, n=160, sources=7):
    rng = np.random.default_rng(seed)
    pool = ["the", "The", "THE", "été", "Été", "naïve", "日本語", "x", "aB", "ß", "zzz" * 20, "o'clock", "snake_case", "e2e", "mid-word", *(f"w{'abcdefgh'[i % 8]}{'klmnopq'[i % 7]}" for i in range(56))]
    rows = []
    for _ in range(n):
        k = int(rng.integers(sources)) if rng.random() > 0.35 else 0
        words = rng.choice(pool, int(rng.integers(0, 30)), p=np.arange(len(pool), 0, -1) / (len(pool) * (len(pool) + 1) / 2))
        rows.append(("en" if rng.random() < 0.6 else "fr", f"s{k}", " ".join(words)))
    return [*rows, ("de", "alone", "nothing that is kept"), ("it", "a", "one"), ("it", "b", None), ("en", "none", ""), (None, None, "the the"), (None, "s1", "the"), ("fr", "s1", "é" * 5000), *rows[:3]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, i, 0.5, "x") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, value double, item string")


@pytest.mark.parametrize("least", [1, 4])
def test_plain(spark, least):
    rows = some_rows(least)
    assert answers(D.divergence(frame(spark, rows), least)) == plain(rows, least)


def test_blocks_and_tiles(spark, monkeypatch):
    """Terms in many blocks and sources in many tiles give the same; few terms are reported where more qualify."""
    monkeypatch.setattr(D, "BLOCK_CELLS", 40)
    monkeypatch.setattr(D, "TILE_SOURCES", 3)
    rows = some_rows(9, 200, 17)
    assert answers(D.divergence(frame(spark, rows), 2, 3)) == plain(rows, 2, 3)


def test_nothing(spark):
    assert D.divergence(frame(spark, [])).isEmpty()


def test_xxh64():
    rng = np.random.default_rng(3)
    size = np.concatenate([np.arange(70), rng.integers(0, 40, 500)])
    data = rng.integers(0, 256, int(size.sum()) + 8).astype(np.uint8)
    start = np.cumsum(size) - size
    want = [xxhash.xxh64_intdigest(data[s : s + n].tobytes()) for s, n in zip(start, size)]
    assert D.xxh64(data, start, size).tolist() == want


@pytest.mark.parametrize("hashes", [1, 5, 2**63])
def test_collisions_are_told_apart(monkeypatch, hashes):
    """Counts do not depend on the hash, even where all terms share one."""
    texts = [r[2] or "" for r in some_rows(5)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    source = np.arange(len(texts)) % 4
    real = D.xxh64
    monkeypatch.setattr(D, "xxh64", lambda *a: real(*a) % np.uint64(hashes))
    of, n, in_texts, data, start, size = D.term_counts(raw, offsets, source)
    got = {(int(s), data[a : a + k].tobytes().decode()): (int(x), int(y)) for s, x, y, a, k in zip(of, n, in_texts, start, size)}
    want = defaultdict(lambda: [0, 0])
    for s, t in zip(source, texts):
        for term, k in Counter(TERM.findall(t.translate(UP))).items():
            want[int(s), term][0] += k
            want[int(s), term][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()} and len(of) == len(got)


def test_shares_of_large_counts():
    n, total = np.array([5, 10**15 // 3, 10**15]), np.array([10**15, 10**15, 10**15])
    assert D.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]
