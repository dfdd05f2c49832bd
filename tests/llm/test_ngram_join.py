import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from massgrid.llm import ngram_join
from massgrid.llm.bytesops import text_bytes, word_hashes


def brute(rows):
    """(doc_id, size, smallest id reachable) by all pairs."""
    sets = {}
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((k, len(sets[k]), find(k)) for k in keys)


def near_copies(seed=3, groups=6, size=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    shared = [word() for _ in range(30)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 40, 90, 200]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            if g % 2:
                text += shared
            texts.append(" ".join(text).replace("a", rng.choice("aA")))
    rng.shuffle(texts)
    return texts


def test_against_all_pairs(table, odd_texts):
    texts = near_copies() + odd_texts
    got = sorted(map(tuple, ngram_join.join_groups(table(texts)).collect()))
    assert got == brute(enumerate(texts))


def test_split_tiles(table, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 2)
    texts = near_copies(11, 3, 12)
    got = sorted(map(tuple, ngram_join.join_groups(table(texts)).collect()))
    assert got == brute(enumerate(texts))


def test_chain_is_one_group(table):
    words = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(9):  # each is linked with the next one only
        words = [*words[:k * 6], *(f"v{k}_{i}" for i in range(2)), *words[k * 6 + 2 :]]
        texts.append(" ".join(words))
    got = sorted(map(tuple, ngram_join.join_groups(table(texts)).collect()))
    assert got == brute(enumerate(texts)) and len({r[2] for r in got}) < 9


def test_null_ids_empty_table_and_representatives(spark, empty, table):
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join_groups(rows).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4), (9, 2, 4)], key=str)
    assert ngram_join.join_groups(empty).count() == 0
    docs = table(["a b c d e f", "a b c d e f", "other words of its own here", None])
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def all_links(rows):
    """Every link between different sets, by least doc_ids, with the shingles in common."""
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset(), key)
    found = [(k, s) for s, k in sets.items() if s]
    return sorted((*sorted((a, b)), len(s & t)) for i, (a, s) in enumerate(found) for b, t in found[i + 1 :] if 100 * len(s & t) >= 75 * len(s | t)), sets


def test_every_link_is_found_and_counted(table, monkeypatch):
    texts = near_copies(5, 3, 9) + near_copies(8, 2, 45)  # some groups are split into parts
    texts += [texts[0], texts[0], None]
    want, _ = all_links(enumerate(texts))
    for rows in (512, 4):
        monkeypatch.setattr(ngram_join, "TILE_ROWS", rows)
        sets, links = ngram_join.similar_sets(table(texts))
        assert sorted(map(tuple, links.collect())) == want
        rep = {r.doc_id: r.rep for r in sets.collect()}
        got = {r.doc_id: r.n_links for r in ngram_join.join(table(texts)).collect()}
        assert got == {k: sum(rep[k] in link[:2] for link in want) for k in range(len(texts))}
    assert len(want) > 500


def test_repeated_rows_have_no_more_links(spark):
    words = [f"w{i}" for i in range(40)]
    a, b, c = (" ".join([*words, *tail]) for tail in ("x", "yz", "uvw"))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(1, a), (1, a), (2, b), (2, b), (2, b), (3, c), (7, other), (7, other + " end"), (8, other + " one two"), (9, None), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.component_id, r.n_links) for r in ngram_join.join(docs).collect()}
    # 7 has two texts, linked with each other, which is no link of it; both are linked with that of 8, and counted together
    assert got == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (7, 7, 2), (8, 7, 2), (9, 9, 0), (None, None, 0)}
    _, links = ngram_join.similar_sets(docs.where("doc_id < 7"))
    assert sorted((r.a, r.b) for r in links.collect()) == [(1, 2), (1, 3), (2, 3)]


def test_sets_of_many_copies_are_broadcast(table, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_PARTS", 4)
    texts = ["a b c d e f"] * 30 + [None] * 20 + ["a b c d e f g h"] * 3 + ["own words of this one text"]
    docs = table(texts)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_groups(docs).collect()) == brute(list(enumerate(texts)))


def test_documents_of_first_blocks_are_spread(spark, table):
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
    docs = table([f"{i} b c d e f g" for i in range(40)]).repartition(20).select("doc_id", "text")
    rows = docs.mapInArrow(ngram_join._shingle_blocks(6, none), "bucket long, block long, shingles binary, documents binary")
    assert rows.where("bucket < 0").select("bucket").distinct().count() > 5


def test_unlike_words_never_link(table):
    """Words that polynomials modulo 2**64 cannot tell apart, and words that differ in one byte anywhere."""
    from test_bpe import thue_morse

    words = [thue_morse(2048, x) for x in ("ab", "ba")] + [("x" * 70)[:i] + "y" + ("x" * 70)[i:] for i in range(0, 71, 10)] + ["x" * n for n in range(1, 20)]
    out = ngram_join.join(table(words)).collect()
    assert all(r.n_shingles == 1 and r.component_id == r.doc_id and r.n_links == 0 for r in out)


def test_sizes_that_can_link_are_in_neighbouring_bands(spark):
    rows = spark.range(1, 5000).select("id", ngram_join.size_band(F.col("id")).alias("band")).collect()
    band = {r.id: r.band for r in rows}
    for n in range(1, 5000):
        assert band[n] - band[ngram_join.required(n)] in (0, 1)


def test_common_shingles_stay_with_their_blocks(table, monkeypatch):
    """A passage in every document: its shingles are known as common, and no task gets them all."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = [" ".join([*passage, *(word() for _ in range(rng.choice([0, 3, 8, 40])))]) for _ in range(300)]
    monkeypatch.setattr(ngram_join, "SAMPLE_ROWS", 200)
    docs = table(texts)
    shingles, frequency = ngram_join.common_shingles(docs.select("doc_id", "text"))
    assert len(shingles) == 26 and (frequency > ngram_join.COMMON).all()
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert got == {k: c for k, _, c in brute(list(enumerate(texts)))}


def test_word_hashes():
    rng = np.random.default_rng(4)
    parts = {bytes(rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)) for _ in range(4000)}
    raw, offsets = text_bytes(pa.array(sorted(parts), pa.binary()))
    h = word_hashes(raw, offsets[:-1], offsets[1:], 3)
    assert len(np.unique(h)) == len(parts)
    assert word_hashes(np.append(np.uint8(7), raw), offsets[:-1] + 1, offsets[1:] + 1, 3).tolist() == h.tolist()
