r"""Suffix-array dedup: removes every byte that a repeated string of `length` bytes covers; 400 unless told otherwise.

1. Anchors. Every window of that length takes as its anchor the string of two fifths of it (160 bytes) with the least
   hash in it, the leftmost of equals. Equal windows have equal anchors at equal places in them, wherever they stand. The windows of a text that
   share an anchor follow one another; they are a segment, about 500 bytes long. Only hashes leave the text.
2. A segment with equal content elsewhere is repeated as a whole. Anchors with one content need nothing more.
3. For anchors with several contents, one text for each content sends the segment's bytes. Segments that share an
   anchor meet in one bucket, which sorts their suffixes and expands intervals of the Burrows-Wheeler transform
   breadth first: extending all intervals of length l by one symbol to the left yields the common prefixes of value
   l, in increasing order. It stops at the length; boundaries without a value then separate suffixes that share it.
4. The covered intervals go back to all places of their segments by a join, and the texts are cut.

An anchor with more than HOT contents is first split by the 361 bytes (length - 39) that up to 40 of its windows share.
Equal parts are counted before the shuffle: one that stands in several segments is covered as a whole, and only one
copy goes on. Segments of one anchor only match at equal places, so where a split still leaves more than HOT different
parts, their windows are counted by place and hash, without bytes. So no group has more than HOT strings of at most
640 bytes, and texts are never held together.

With by_words the same steps run over words `[^\x20\x09-\x0D]+` in place of bytes: each is a 64-bit hash of its bytes, `length` and
all places count words. So passages are found by their words, however few bytes they have.

Cases: a null or empty text has nothing to remove, nor has one under 400 bytes; a repeated row removes both; rows
with equal doc_ids but other texts are separate; long texts are taken in overlapping pieces; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massgrid.llm.bpe import blocks
from massgrid.llm.bytesops import U64, byte_table, gather_ranges, mix, powers, text_bytes, word_hashes
from massgrid.llm.bytesops import words as word_bounds
from massgrid.llm.common import lean, released, removed, saved, shared_folder

LENGTH = 400
#: Words of the shortest passage that the query counts: over 50.
PASSAGE_WORDS = 51
BLOCK_BYTES = 1 << 20
LONG_TEXT = 4 << 20
HOT = 1000
GROUP = 40
GROUP_WORDS = 5
#: Bytes of segments whose suffixes are sorted at once.
SORTED_BYTES = 1 << 20
PLACE_BITS = 24


class Rolling:
    """Hashes of any range of an array of bytes or of hashes of words."""

    def __init__(self, raw: np.ndarray, seed: int = 7):
        self.up, self.down = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, U64)
        values = byte_table(seed)[raw] if raw.dtype == np.uint8 else mix(raw.astype(U64) + U64(seed))
        np.cumsum(values * self.up[: len(raw)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def units(raw: np.ndarray, offsets: np.ndarray, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Texts as they are, or as a hash for each word, and the offsets of the texts in that."""
    if not by_words:
        return raw, offsets
    start, end, first = word_bounds(raw, offsets)
    return word_hashes(raw, start, end, 23, lower=False), first


def unpacked(column: pa.Array, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(units, offsets) of a binary column of them."""
    raw, offsets = text_bytes(column)
    return (raw.view(U64), offsets // 8) if by_words else (raw, offsets)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for every i, by running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    full = -(-len(x) // width) * width
    rows = np.full(full, U64(2**64 - 1))
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_width(length: int) -> int:
    return 2 * length // 5


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, start in the text, length, anchor's place in the segment, anchor hash, content hash) of all segments."""
    size = np.diff(offsets)
    if not (size >= length).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    roll, width = Rolling(raw), anchor_width(length)
    at = np.arange(len(raw) - width + 1)
    grams = roll.hash(at, at + width)
    low = U64((1 << PLACE_BITS) - 1)
    least = _sliding_min((grams & ~low) | at.astype(U64), length - width + 1)
    rows = np.flatnonzero(size >= length)
    starts = gather_ranges(offsets[:-1][rows], size[rows] - length + 1)
    place = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    begin, end, anchor = starts[first], starts[last] + length, place[first]
    row = np.searchsorted(offsets, begin, side="right") - 1
    return row, begin - offsets[row], end - begin, anchor - begin, grams[anchor].view(np.int64), roll.hash(begin, end).view(np.int64)


PLACES = "k long, h long, start long, len long, at long, anchor long, seg long"


def _places(length: int, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments of all texts."""
        names = ["k", "h", "start", "len", "at", "anchor", "seg"]
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in blocks(offsets, BLOCK_BYTES):
                lo, hi = int(offsets[i]), int(offsets[j])
                block, bounds = units(raw[lo:hi], offsets[i : j + 1] - lo, by_words)
                n = len(block)
                pieces = [(0, n)] if n <= LONG_TEXT else [(s, min(n, s + LONG_TEXT + length - 1)) for s in range(0, n - length + 1, LONG_TEXT)]
                for shift, end in pieces:
                    inner = bounds if len(pieces) == 1 else np.array([0, end - shift])
                    row, start, *rest = segments(block[shift:end], inner, length)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[i + row], h[i + row], start + shift, *rest)], names=names)

    return run


def suffix_order(symbols: np.ndarray, separators: int) -> np.ndarray:
    """Suffix array by prefix doubling. Symbols below `separators` are all different and smaller than the others."""
    n, bits = len(symbols), int(symbols.max() + 1).bit_length()
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):  # as many symbols as a key holds at once; 0 stands for none
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:].astype(np.int64) + 1
    while True:
        order = np.argsort(key)  # equal keys get one rank, so their order is of no account
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        top = int(fresh[-1]) + 1
        if top == n:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:] + 1
        key, width = rank * (top + 1) + ahead, 2 * width


def long_matches(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each byte of some strings starts a substring of `length` bytes that also starts elsewhere in them.

    Breadth-first interval expansion on the Burrows-Wheeler transform. An interval of suffixes with a common prefix w
    is extended to the left by every symbol before it; each extended interval, unless its right boundary has a value
    already, gives that boundary the common prefix |w| and is extended in turn.
    """
    count, n = len(offsets) - 1, len(raw) + len(offsets) - 1
    row = np.repeat(np.arange(count), np.diff(offsets))
    symbols = np.empty(n, np.int64)
    text = np.arange(len(raw)) + row
    symbols[text] = raw.astype(np.int64) + count
    symbols[offsets[1:] + np.arange(count)] = np.arange(count)  # each string ends in a symbol of its own
    order = suffix_order(symbols, count)
    before = symbols[order - 1]
    before[before < count] = -1  # never extended beyond a string's start
    by_symbol = np.argsort((before + 1) * n + np.arange(n))  # stable
    follow = np.empty(n, np.int64)
    # suffixes that start with a string's own end come first; those with symbol c before them keep their order
    follow[by_symbol] = np.arange(n)
    runs = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    run_of = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, n)))
    run_end = np.append(runs[1:], n) - 1
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for level in range(length):
        first = run_of[low]
        pieces = run_of[high] - first + 1
        parent = np.repeat(np.arange(len(low)), pieces)
        run = gather_ranges(first, pieces)
        a, b = np.maximum(low[parent], runs[run]), np.minimum(high[parent], run_end[run])
        symbol = before[a]
        keep = symbol >= 0
        a, b, symbol, parent = follow[a[keep]], follow[b[keep]], symbol[keep], parent[keep]
        sort = np.argsort(a)
        a, b, symbol, parent = a[sort], b[sort], symbol[sort], parent[sort]
        new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])]) if len(a) else np.zeros(0, bool)
        a = a[new]
        b = b[np.append(np.flatnonzero(new)[1:], len(b)) - 1] if len(b) else b
        if not level:
            a, b = np.concatenate([np.arange(count), a]), np.concatenate([np.arange(count), b])
        open_ = ~known[b + 1]
        low, high = a[open_], b[open_]
        known[high + 1] = True
        if not len(low):
            break
    same = np.flatnonzero(~known[:n])
    starts = np.zeros(n, bool)
    starts[order[same]] = starts[order[same - 1]] = True
    return starts[text]


def aligned_matches(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The same for strings that only match at equal distance from `at`, by hashes of one distance after another."""
    roll, out = Rolling(raw, 13), np.zeros(len(raw), bool)
    first, last = -at, np.diff(offsets) - length - at
    for distance in range(int(first.min()), int(last.max()) + 1):
        rows = np.flatnonzero((first <= distance) & (distance <= last))
        start = offsets[:-1][rows] + at[rows] + distance
        _, place, count = np.unique(roll.hash(start, start + length), return_inverse=True, return_counts=True)
        out[start[count[place] > 1]] = True
    return out


def intervals(marks: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of what the marked windows of each string cover; windows of different strings stay apart."""
    at = np.flatnonzero(marks)
    row = np.searchsorted(offsets, at, side="right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[first], at[first] - offsets[row[first]], at[last] - offsets[row[first]] + length if len(at) else at


CONTENTS = "hot boolean, key long, anchor long, seg long, len long, shift long, at long, part long, bytes binary"


def _cut(length: int, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes, or hashes of words, of the segments asked for; of hot anchors, by groups of windows under the hash of what these share."""
        kinds = {"hot": pa.bool_(), "bytes": pa.binary()}
        names = ["hot", "key", "anchor", "seg", "len", "shift", "at", "part", "bytes"]
        width = GROUP_WORDS if by_words else GROUP

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.int64())) for c, x in zip(zip(*out, strict=True), names, strict=True)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                whole_text, _ = units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), by_words)
                for want in wanted.as_py():
                    start, size, at, anchor, seg = (want[x] for x in ("start", "len", "at", "anchor", "seg"))
                    part = whole_text[start : start + size]
                    if not want["hot"]:
                        out.append((False, anchor, anchor, seg, size, 0, at, seg, part.tobytes()))
                        continue
                    roll = Rolling(part, 17)
                    begin = np.arange(size - length + 1)
                    group = (begin - at) // width
                    for g in np.unique(group):
                        a, b = int(begin[group == g][0]), int(begin[group == g][-1])
                        core, whole = roll.hash(np.array([at + g * width + width - 1, a]), np.array([at + g * width + length, b + length]))
                        key = int(mix(np.array([int(core) ^ (anchor & (2**64 - 1)), int(g) & 0xFFFF], U64)).view(np.int64).sum())
                        out.append((True, key, anchor, seg, size, a, at - a, int(whole.view(np.int64)), part[a : b + length].tobytes()))
                if sum(len(o[-1]) for o in out[-200:]) > 1 << 18 or len(out) > 2000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    return run


def _windows(length: int, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of parts, by their place from the anchor and their hash."""
        for batch in batches:
            key, part, at = (batch.column(i).to_numpy() for i in range(3))
            raw, offsets = unpacked(batch.column(3), by_words)
            count = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(len(count)), count)
            start = gather_ranges(offsets[:-1], count)
            begin = start - offsets[row]
            window = Rolling(raw, 19).hash(start, start + length).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[row], part[row], begin, begin - at[row], window)], names=["key", "part", "s", "place", "window"])

    return run


def _resolve(length: int, by_words: bool = False):
    def run(table: pa.Table) -> pa.Table:
        """What is covered in the segments of a bucket."""
        table = table.combine_chunks()
        key, anchor, seg, size, at = (table[c].to_numpy() for c in ("key", "anchor", "seg", "len", "at"))
        hot = table["hot"].to_numpy()
        order = np.lexsort((size, seg, key))
        same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (seg[order][1:] == seg[order][:-1]) & (size[order][1:] == size[order][:-1])])
        order = order[~same]
        group, count = np.unique(key[order], return_counts=True)
        order = order[np.repeat(count, count) > 1]
        parts = table["bytes"].take(pa.array(order)).combine_chunks()
        raw, offsets = unpacked(parts, by_words)
        raw = np.unique(raw, return_inverse=True)[1] if by_words else raw
        found = []
        ends = np.flatnonzero(np.concatenate([key[order][1:] != key[order][:-1], [True]])) + 1 if len(order) else []
        begin, done = 0, 0
        for i, end in enumerate(ends):  # groups are put together up to SORTED_BYTES
            done = end
            more = ends[i + 1] if i + 1 < len(ends) else end
            if i + 1 < len(ends) and offsets[more] - offsets[begin] <= SORTED_BYTES:
                continue
            inner, bytes_ = offsets[begin : end + 1] - offsets[begin], raw[offsets[begin] : offsets[end]]
            marks = long_matches(bytes_, inner, length) if len(bytes_) <= 2 * SORTED_BYTES else aligned_matches(bytes_, inner, at[order[begin:end]], length)
            row, a, b = intervals(marks, inner, length)
            row = order[begin + row]
            found.append((hot[row], anchor[row], seg[row], size[row], a, b))
            begin = done
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, bool), *[np.zeros(0, np.int64)] * 5]
        return pa.table([pa.array(c) for c in cols], names=["hot", "anchor", "seg", "len", "s", "e"])

    return run


def unit_count(by_words: bool) -> Column:
    return F.floor(F.octet_length("bytes") / (8 if by_words else 1)).cast("long")


def _hot_cover(sent: DataFrame, found: DataFrame, copies: DataFrame, many: DataFrame, length: int, folder: str, by_words: bool) -> DataFrame:
    """(anchor, seg, len, s, e) of hot anchors, from what is covered in each part. Windows of one part overlap, so they cover one interval."""
    windows = saved(many.select("key", "part", "at", "bytes").mapInArrow(lean(_windows(length, by_words)), "key long, part long, s long, place long, window long"), "windows", folder)
    again = windows.groupBy("key", "place", "window").count().where("count > 1").drop("count")
    spans = windows.join(again, ["key", "place", "window"]).select("key", "part", "s", (F.col("s") + length).alias("e"))
    spans = spans.union(found.where("hot").select(F.col("anchor").alias("key"), F.col("seg").alias("part"), "s", "e"))
    spans = spans.union(copies.where("n > 1").select("key", "part", F.lit(0).cast("long"), unit_count(by_words)))
    spans = spans.groupBy("key", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return sent.where("hot").select("key", "part", "anchor", "seg", "len", "shift").join(spans, ["key", "part"]).select("anchor", "seg", "len", F.col("shift") + F.col("s"), F.col("shift") + F.col("e"))


def covered(docs: DataFrame, carry: list[str], length: int = LENGTH, text: str = "text", key: str = "doc_id", by_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc_id, k, h, text, carried struct); spans (k, h, list of (s, e)), the covered intervals of a text in bytes or words."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("carried"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h"), "text", "carried")
    folder = shared_folder(docs.sparkSession, "repeats-work")  # for what only the spans are made of
    places = saved(rows.where(F.octet_length("text") >= (2 * length - 1 if by_words else length)).select("k", "h", "text").mapInArrow(lean(_places(length, by_words)), PLACES), "places", folder)
    contents = places.groupBy("anchor", "seg", "len").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("h").alias("h"), F.first("start").alias("start"), F.first("at").alias("at"))
    contents = saved(contents, "contents", folder)
    released(docs.sparkSession)
    several = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("hot", F.col("kinds") > HOT)
    wanted = contents.join(several, "anchor")
    volume = wanted.agg(F.sum("len")).first()[0] or 0
    buckets = max(16, int(volume) * (8 if by_words else 1) // (256 << 10))
    asked = wanted.groupBy("k", "h").agg(F.collect_list(F.struct("start", "len", "at", "anchor", "seg", "hot")).alias("wanted"))
    sent = saved(rows.join(asked, ["k", "h"]).select("text", "wanted").mapInArrow(lean(_cut(length, by_words)), CONTENTS), "parts", folder)
    copies = saved(sent.where("hot").groupBy("key", "part").agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("bytes").alias("bytes")), "hot-parts", folder)
    different = copies.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1")
    large = F.broadcast(different.where(F.col("parts") > HOT).select("key"))  # a key for at least HOT parts
    few = copies.join(large, "key", "left_anti").join(different, "key")
    bucket = F.pmod("key", F.lit(buckets)).alias("bucket")
    strings = sent.where("not hot").select(bucket, "hot", "key", "anchor", "seg", "len", "at", "bytes")
    strings = strings.union(few.select(bucket + buckets, F.lit(True), "key", F.col("key"), "part", unit_count(by_words), "at", "bytes"))
    found = saved(strings.groupBy("bucket").applyInArrow(_resolve(length, by_words=True) if by_words else _resolve(length), "hot boolean, anchor long, seg long, len long, s long, e long"), "found", folder)
    parts = found.where("not hot").drop("hot").union(_hot_cover(sent, found, copies, copies.join(large, "key", "left_semi"), length, folder, by_words))
    whole = contents.where("n > 1").select("anchor", "seg", "len", F.lit(0).cast("long").alias("s"), F.col("len").alias("e"))
    cover = saved(whole.union(parts), "cover", folder)
    del contents, wanted, whole, asked, sent, strings, copies, different, large, few, found, parts
    released(docs.sparkSession)
    back = places.select("k", "h", "start", "anchor", "seg", "len").join(cover, ["anchor", "seg", "len"])
    spans = saved(back.groupBy("k", "h").agg(F.collect_list(F.struct((F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))).alias("spans")), "spans")
    removed(folder)
    del places, cover, back
    released(docs.sparkSession)
    return rows, spans


def merged(pairs: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of intervals that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((p["s"], p["e"]) for p in pairs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def whole_characters(raw: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cuts without characters of which a byte stays."""
    inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for s, e in cut:
        while inner(s):
            s += 1
        while inner(e):
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False, length: int = LENGTH, words: int = 0, passage: int = 0) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<s, e>>, kept binary, carried struct, passages array<struct<s, e>>) of every document.

    carry: more columns to keep in the struct. as_text: kept is a string, and spans end at characters: one that is
    covered in part stays. length: the least length of a repeated string in bytes. words: covered runs of at most
    so many words (white space apart, parts counted) stay, unless they have LENGTH bytes. passage: where it is not 0, passages
    are the maximal runs that repeated sequences of so many words cover, counted in words; nothing is cut by them.
    """
    rows, spans = covered(docs, list(carry), length)
    if passage:
        _, runs_of_words = covered(docs, [], passage, by_words=True)
        spans = spans.join(runs_of_words.withColumnRenamed("spans", "passages"), ["k", "h"], "full")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<struct<s:long,e:long>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, runs, passages = [], [], [], []
            for text, found, repeated in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                raw = text.encode()
                cut = merged(found or [])
                cut = [(s, e) for s, e in cut if e - s >= LENGTH or len(raw[s:e].split()) > words] if words else cut
                cut = whole_characters(raw, cut) if as_text else cut
                at, parts = 0, []
                for s, e in cut:
                    parts.append(raw[at:s])
                    at = e
                left = b"".join([*parts, raw[at:]])
                kept.append(left.decode() if as_text else left)
                sizes.append(len(raw))
                runs.append([{"s": s, "e": e} for s, e in cut])
                passages.append([{"s": s, "e": e} for s, e in merged(repeated or [])])
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string() if as_text else pa.binary()), batch.column(3), pa.array(passages, kind)], names=["doc_id", "n_bytes", "spans", "kept", "carried", "passages"])

    joined = rows.join(spans, ["k", "h"], "left").select("doc_id", "text", "spans", "carried", "passages")
    return joined.mapInArrow(lean(run), f"doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept {'string' if as_text else 'binary'}, carried {joined.schema['carried'].dataType.simpleString()}, passages array<struct<s:long,e:long>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what repeated 400-byte strings leave of every document. kept_text shows a character cut in half as U+FFFD.

    n_passages, n_passage_words: the runs that repeated sequences of over 50 words cover, also those under 400 bytes, which stay.
    """
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE_WORDS)
    passages = F.size("passages").cast("long").alias("n_passages"), F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_passage_words")
    cut = "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    return out.select(*cut, F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"), *passages)
