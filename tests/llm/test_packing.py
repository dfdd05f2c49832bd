import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from massgrid.llm import packing

PATH = P.path("word_bpe_49k.json")


def padding(n):
    return 0 if n & (n - 1) == 0 else 4096 - n


def test_levels_keep_every_id():
    rng = random.Random(1)
    levels, done, sizes = packing.Levels(max_open=16), [], {}
    for d in range(300):
        sizes[d] = rng.choice([1, 5, 700, 2049, 4095, 4096, 9000])
        done += levels.add((d, 0, sizes[d], np.arange(sizes[d], dtype=np.uint32)))
    done += levels.close()
    seen = defaultdict(list)
    for window in done:
        n = sum(len(p[3]) for p in window)
        assert n <= 4096 and padding(n) == 0
        for doc, start, total, ids in window:
            assert total == sizes[doc] and ids.tolist() == list(range(start, start + len(ids)))
            seen[doc] += ids.tolist()
    assert all(sorted(seen[d]) == list(range(n)) for d, n in sizes.items())


def test_least_sum_of_squares():
    levels = packing.Levels(window=10)
    for size in (4, 4, 6):
        list(levels.add((0, 0, size, np.zeros(size, np.uint32))))
    # the second 4 joins the first: no window more; the 6 fits nowhere
    assert np.flatnonzero(levels.count).tolist() == [6, 8]
    assert [len(w) for w in levels.add((0, 0, 4, np.zeros(4, np.uint32)))] == [2]  # filling up 6 takes a square away


def test_choice_of_level_by_the_plain_sum():
    """Each document goes where the sum of squared counts of open windows gets smallest, by trying every level."""
    rng = random.Random(4)
    levels, counts = packing.Levels(window=12), Counter()
    for _ in range(400):
        size = rng.randint(1, 11)

        def after(level):
            trial = Counter(counts)
            trial[level] -= 1 if level else 0
            trial[level + size] += 1 if level + size < 12 else 0
            return sum(v * v for v in trial.values()), trial

        sums = {level: after(level)[0] for level in [0, *(x for x, n in counts.items() if n > 0 and x + size <= 12)]}
        list(levels.add((0, 0, size, np.zeros(size, np.uint32))))
        now = Counter({int(i): int(levels.count[i]) for i in np.flatnonzero(levels.count)})
        assert sum(v * v for v in now.values()) == min(sums.values())
        counts = now


def test_one_window_is_completed_beyond_the_limit():
    rng = random.Random(6)
    levels = packing.Levels(max_open=8)
    for d in range(500):
        before = int(levels.count.sum())
        done = list(levels.add((d, 0, 900, np.zeros(900 + rng.randint(0, 9), np.uint32))))
        assert len(done) <= 2 and before - 2 <= levels.count.sum() <= 8


def test_tables(table, empty, odd_texts):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(table(odd_texts), PATH).withColumn("crc", F.crc32("ids")).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(odd_texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.crc) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and padding(at) == 0
    assert packing.pack(empty, PATH).count() == 0
