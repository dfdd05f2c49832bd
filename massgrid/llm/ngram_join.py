"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap by 75 % or more.

1. Blocks of documents become sorted sets of 64-bit shingle hashes. Every block sends each hash bucket one
   packed array, which drops shingles that stand in one set only (they are in no intersection) and sends the
   others back to their blocks with their frequency. Shingles that are common in a sample stay with their blocks.
2. A set's prefix is its `n - ceil(0.75 n) + 1` rarest shingles; two linked sets share a shingle of their
   prefixes. Shingles of one set come first, so most sets have no prefix left that could meet another, and
   end here. A prefix shingle makes a tile: the sets that hold it there.
3. First every set of a tile is held against the tile's least set, by bitmap and then exactly. The verified links give
   components.
4. Then the tiles are taken whole, band of sizes by band: sets sorted by size, each against the following sizes that can
   still reach the threshold, unless both are in one component already. Bitmap signatures bound the overlap from above:
   a bit that is set on one side only stands for at least one shingle that is not shared. Pairs that remain get
   the exact intersection of sorted arrays. A tile of more than TILE_ROWS sets is split into blocks, and each pair
   of blocks goes to a task of its own. Now the components are known.
5. A link never leaves its component. So the join takes every component whole, each pair of its sets once: one of
   more than TILE_ROWS sets or TILE_SHINGLES shingles is split into pairs of parts. Each of these cells goes by sizes
   and bitmaps as the tiles do, and counts the exact overlap of the pairs that remain.
6. What is known of a set goes back to its documents by one join. Sets with more than one in 4,096 documents as copies
   are at most 4,096, so they are broadcast, and no task gets all copies of one.

Equal sets count once, so copies never make pairs. Shingles are held as 48-bit values, so a pair of sets of 500
has a chance of 1e-9 to share a shingle by accident.

Cases: a null or empty text has no shingles and is linked with nothing; fewer than five words make one shingle;
a null doc_id is linked with nothing and has a null component; rows that share a doc_id count as one document
in components; repeated ones have no more links than one, and other texts of one doc_id are sets of their own, whose links
are counted under it together;
an empty table gives an empty result; very long texts are taken whole, a text of over BLOCK_BYTES as a block of its own;
of equal sets the least doc_id stands for all; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.llm.bpe import blocks
from massgrid.llm.bytesops import U64, gather_ranges, list_array, mix, shingle_sets, text_bytes
from massgrid.llm.common import bucket_count, lean, released, removed, saved, shared_folder, text_rows
from massgrid.llm.graph import components

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 60_000  # a row of a block is a 16-bit number
SIGNATURE_WORDS = 8
#: Documents of the sample that tells common shingles, how many of them hold such, the most shingles kept, the least frequency they get.
SAMPLE_ROWS, COMMON_IN, MOST_COMMON, COMMON = 2000, 10, 1 << 16, 1 << 30
#: Sets of a tile that one task compares; larger tiles are split.
TILE_ROWS = 512
#: Shingles, copies counted, of the sets of a part of a component.
TILE_SHINGLES = 1 << 18
#: A set with more than one in so many documents as copies is hot; there are no more such sets than this number.
HOT_PARTS = 4096
LOW = U64(0xFFFF)


def required(n, percent: int = 75):
    """Least overlap with any set that a set of n shares at the threshold."""
    return (percent * n + 99) // 100


def size_band(n, percent: int = 75):
    """A band of sizes; two sets that can link are in one band or in neighbouring ones. A band is a little wider than their ratio, so rounding parts none."""
    return F.floor(F.log(n) / math.log(100.0001 / percent)).cast("int")


def linked(common, n_left, n_right, percent: int = 75):
    return 100 * common >= percent * (n_left + n_right - common)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values, none of them negative."""
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    return starts, np.append(starts, len(values))[1:]


def _block_sets(keys: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple:
    """Sizes, set hashes, representative rows and (shingle | row) values, sorted."""
    sets, bounds = shingle_sets(raw, offsets)
    sizes = np.diff(bounds)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets), dtype=U64)])
    digest = mix((total[bounds[1:]] - total[bounds[:-1]]) + sizes.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
    order = np.lexsort((keys, digest))
    first = np.ones(len(order), bool)
    first[1:] = digest[order[1:]] != digest[order[:-1]]
    chosen = np.zeros(len(order), bool)
    chosen[order[first]] = True
    rows = np.repeat(np.arange(len(sizes)), sizes)
    mine = chosen[rows]
    values = (sets[mine] & ~LOW) | rows[mine].astype(U64)
    values.sort()
    return sizes, digest, chosen, values


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, frequencies): those that COMMON_IN documents of a sample hold, at most MOST_COMMON.

    They are not sent to be counted, as one would bring a row of every document that holds it to one task. A frequency
    only orders a set's shingles, so an estimate that all tasks share serves as well.
    """
    share = min(1 << 20, (SAMPLE_ROWS << 20) // max(1, rows.count()) + 1)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(1 << 20)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                sets, _ = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([pa.array((sets >> U64(16)).view(np.int64))], names=["shingle"])

    counts = sample.mapInArrow(lean(run), "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON_IN)
    found = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow().sort_by("shingle")
    return found["shingle"].to_numpy().astype(U64), (found["count"].to_numpy() + COMMON).astype(np.uint32)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of the shingle of each packed value among the known ones, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values >> U64(16)), len(known) - 1)
    return np.where(known[at] == values >> U64(16), at, -1)


def _shingle_blocks(bits: int, common: Broadcast):
    """Blocks of documents: one row for each bucket of shingles, and one with the block's documents and common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                for i in range(lo, hi, BLOCK_ROWS):
                    j = min(hi, i + BLOCK_ROWS)
                    sizes, digest, _, values = _block_sets(keys[i:j], raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    often = _among(values, common.value[0]) >= 0
                    values, held = values[~often], values[often]
                    bucket = (values >> U64(64 - bits)).astype(np.int64)
                    cuts, ends = _runs(bucket)
                    shingles = [values[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
                    documents = keys[i:j].tobytes() + digest.tobytes() + sizes.astype(np.int64).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.append(bucket[cuts], -1 - int(mix(np.array([block], U64))[0] >> U64(64 - bits))), pa.int64()), pa.array(np.full(len(cuts) + 1, block), pa.int64()), pa.array([*shingles, held.tobytes()], pa.binary()), pa.array([None] * len(cuts) + [documents], pa.binary())],
                        names=["bucket", "block", "shingles", "documents"],
                    )
                    block += 1

    return run


def _frequent(common: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        """The shingles of a bucket that more than one set holds, by block, with their frequency."""
        schema = pa.schema([("block", pa.int64()), ("shingles", pa.binary()), ("frequency", pa.binary()), ("documents", pa.binary())])
        table = table.combine_chunks()
        if table.num_rows and table["bucket"][0].as_py() < 0:
            known, frequency = common.value
            held = [frequency[_among(np.frombuffer(x, U64), known)].tobytes() for x in table["shingles"].to_pylist()]
            return pa.table([table["block"], table["shingles"], pa.array(held, pa.binary()), table["documents"]], schema=schema)
        parts = [np.frombuffer(x.as_buffer(), U64) for c in table["shingles"].chunks for x in c]
        values = np.concatenate(parts)
        block = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(values >> U64(16), kind="stable")
        key = values[order] >> U64(16)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        count = np.repeat(count, count)
        order, count = order[count > 1], count[count > 1]
        by_block = np.argsort(block[order], kind="stable")
        order, count = order[by_block], count[by_block].astype(np.uint32)
        of = block[order]
        cuts, ends = _runs(of)
        names = table["block"].to_numpy()
        values = values[order]
        return pa.table(
            [pa.array(names[of[cuts]]), pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([count[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.nulls(len(cuts), pa.binary())], schema=schema
        )

    return run


def signature(shingles: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """A bitmap of 64 * SIGNATURE_WORDS bits for every row."""
    bit = (mix(shingles) % U64(64 * SIGNATURE_WORDS)).astype(np.int64)
    out = np.zeros(n_rows * SIGNATURE_WORDS, U64)
    np.bitwise_or.at(out, rows * SIGNATURE_WORDS + bit // 64, U64(1) << (bit % 64).astype(U64))
    return out.reshape(n_rows, SIGNATURE_WORDS)


SETS = "doc_id long, digest long, n long, shared array<long>, prefix array<long>, bits binary"


def _prefixes(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Documents of a block; those that can link with another set get their shared shingles, prefix and bitmap."""
        table = table.combine_chunks()
        documents = next(x for x in table["documents"].to_pylist() if x is not None)
        keys, digest, sizes = np.frombuffer(documents, np.int64).reshape(3, -1)
        packed = [(np.frombuffer(s, U64), np.frombuffer(f, np.uint32)) for s, f in zip(table["shingles"].to_pylist(), table["frequency"].to_pylist(), strict=True) if s]
        values = np.concatenate([p[0] for p in packed]) if packed else np.zeros(0, U64)
        frequency = np.concatenate([p[1] for p in packed]) if packed else np.zeros(0, np.uint32)
        rows, shingles = (values & LOW).astype(np.int64), values >> U64(16)
        n = len(keys)
        have = np.bincount(rows, minlength=n)
        room = sizes - required(sizes, percent) + 1 - (sizes - have)
        live = room[rows] > 0
        rows, shingles, frequency = rows[live], shingles[live], frequency[live]
        have = np.bincount(rows, minlength=n)
        bounds = np.concatenate([[0], np.cumsum(have)])
        rare = np.lexsort((shingles, frequency, rows))
        plain = np.lexsort((shingles, rows))
        place = np.arange(len(rows)) - bounds[rows[rare]]
        ahead = rare[place < room[rows[rare]]]
        active = have > 0
        bits = signature(shingles, rows, n)
        none = pa.array(~active)
        lists = []
        for at in (plain, ahead):
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[at], minlength=n))])
            lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shingles[at].view(np.int64)), mask=none))
        signatures = pa.array([bits[i].tobytes() if active[i] else None for i in range(n)], pa.binary())
        return pa.table([pa.array(keys), pa.array(digest), pa.array(sizes), *lists, signatures], names=["doc_id", "digest", "n", "shared", "prefix", "bits"])

    return run


def _bound(m_left: np.ndarray, m_right: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Most shingles that two sets of m_left and m_right can share, by their bitmaps."""
    return np.minimum(m_left - np.bitwise_count(left & ~right).sum(1), m_right - np.bitwise_count(right & ~left).sum(1))


def _pairs_by_size(cell: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y), x < y: the pairs of each cell whose sizes can link, some 200,000 at a time. Rows are sorted by cell and size."""
    _, start = np.unique(cell, return_index=True)
    last = np.empty(len(cell), np.int64)
    for a, b in zip(start, np.append(start[1:], len(cell)), strict=True):  # sizes up to 100/75 of a set's own are its band
        last[a:b] = a + np.searchsorted(n[a:b], n[a:b] * 100 // percent, side="right")
    left = np.arange(len(cell))
    width = last - left - 1
    total = np.concatenate([[0], np.cumsum(width)])
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(total, total[i] + 200_000, side="right")) - 1)
        yield np.repeat(left[i:j], width[i:j]), gather_ranges(left[i:j] + 1, width[i:j])
        i = j


def _tile_pairs(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of a bucket of tiles, or of two blocks of a large tile, that the sizes and bitmaps do not rule out."""
        table = table.combine_chunks()
        order = np.lexsort((table["n"].to_numpy(), table["cell"].to_numpy()))
        tile, rep, n, m, component, side, low = (table[c].to_numpy()[order] for c in ("cell", "rep", "n", "m", "component", "side", "low"))
        bits, found = _bitmaps(table["bits"])[order], []
        for x, y in _pairs_by_size(tile, n, percent):
            keep = (component[x] != component[y]) & (rep[x] != rep[y]) & ((side[x] == 0) | (side[x] != side[y])) & ~(low[x] & low[y])
            x, y = x[keep], y[keep]
            keep = linked(_bound(m[x], m[y], bits[x], bits[y]), n[x], n[y], percent)
            x, y = x[keep], y[keep]
            found.append(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, SIGNATURE_WORDS)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact overlap of the sorted arrays of pairs whose bitmaps leave room for a link."""
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = batch.column("shared_a"), batch.column("shared_b")
            bound = _bound(*(pc.list_value_length(c).to_numpy().astype(np.int64) for c in (x, y)), *(_bitmaps(batch.column(c)) for c in ("bits_a", "bits_b")))
            common = np.zeros(batch.num_rows, np.int64)
            for k in np.flatnonzero(linked(bound, n_a, n_b, percent)).tolist():
                common[k] = len(np.intersect1d(x[k].values.to_numpy(), y[k].values.to_numpy(), assume_unique=True))
            keep = pa.array(linked(common, n_a, n_b, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def _overlaps(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, number: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Exact intersections of pairs of non-empty arrays, x ascending; held is zero for every number, and is so again at the end."""
    common = np.zeros(len(x), np.int64)
    start, stop = _runs(x)
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        own = number[bounds[x[a]] : bounds[x[a] + 1]]
        held[own] = 1
        others = y[a:b]
        lo, hi = int(others[0]), int(others[-1]) + 1
        if hi - lo <= 2 * (b - a):  # near copies follow one another
            sums = np.add.reduceat(held[number[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo])
            common[a:b] = sums[others - lo]
        else:
            width = bounds[others + 1] - bounds[others]
            common[a:b] = np.add.reduceat(held[number[gather_ranges(bounds[others], width)]], np.cumsum(width) - width)
        held[own] = 0
    return common


def _cell_links(percent: int, listed: bool):
    def run(table: pa.Table) -> pa.Table:
        """The links of a bucket of cells: by sizes, then bitmaps, then the exact overlap of the arrays."""
        table = table.combine_chunks()
        order = np.lexsort((table["n"].to_numpy(), table["cell"].to_numpy()))
        cell, rep, n, side = (table[c].to_numpy()[order] for c in ("cell", "rep", "n", "side"))
        bits = _bitmaps(table["bits"])[order]
        lists = table["shared"].combine_chunks().take(pa.array(order))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        bounds, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        m = np.diff(bounds)
        shingles, number = np.unique(values, return_inverse=True)
        held, found = np.zeros(len(shingles), np.int32), [(np.zeros(0, np.int64),) * 3]
        for x, y in _pairs_by_size(cell, n, percent):
            keep = (rep[x] != rep[y]) & ((side[x] == 0) | (side[x] != side[y]))
            x, y = x[keep], y[keep]
            keep = linked(_bound(m[x], m[y], bits[x], bits[y]), n[x], n[y], percent)
            x, y = x[keep], y[keep]
            common = _overlaps(x, y, bounds, number, held)
            keep = linked(common, n[x], n[y], percent)
            found.append((rep[x[keep]], rep[y[keep]], common[keep]))
        x, y, common = (np.concatenate(c) for c in zip(*found, strict=True))
        if listed:
            return pa.table([np.minimum(x, y), np.maximum(x, y), common], names=["a", "b", "common"])
        reps, count = np.unique(np.concatenate([x, y]), return_counts=True)
        return pa.table([reps, count], names=["rep", "n_links"])

    return run


def _grouped(docs: DataFrame, percent: int, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets, reps, active, groups): (doc_id, digest, n) of every document, (digest, n, rep, copies) of every set with
    words, (rep, n, shared, ...) of those that may have links, and (rep, component) of those that have one. rep is the
    least doc_id with the same set.
    """
    rows = text_rows(docs).where("doc_id is not null")
    buckets = bucket_count(docs, 256 << 10, 256)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows))  # at most MOST_COMMON shingles
    blocks_ = rows.mapInArrow(lean(_shingle_blocks(buckets.bit_length() - 1, common)), "bucket long, block long, shingles binary, documents binary")
    frequent = blocks_.groupBy("bucket").applyInArrow(_frequent(common), "block long, shingles binary, frequency binary, documents binary")
    sets = saved(frequent.groupBy("block").applyInArrow(_prefixes(percent), SETS), "sets", folder)
    del blocks_, frequent
    released(docs.sparkSession)  # the shuffles so far hold all shingles, those to come only shared ones
    reps = sets.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    active = sets.where("prefix is not null").join(reps.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])  # a repeated row is one set
    active = saved(active.select(F.col("doc_id").alias("rep"), "n", "shared", "prefix", "bits"), "active-sets", folder)
    postings = active.select("rep", "n", F.explode("prefix").alias("tile"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda x: active.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}"), F.col("bits").alias(f"bits_{x}"))
        joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "shared_a", "shared_b", "bits_a", "bits_b")
        return saved(joined.mapInArrow(lean(_verify(percent)), "a long, b long"), name, folder)

    pivots = postings.groupBy("tile").agg(F.min(F.struct("rep", "n")).alias("p"), F.max("rep").alias("top")).where("p.rep < top").select("tile", F.col("p.rep").alias("a"), F.col("p.n").alias("n_a"))
    near = postings.join(pivots, "tile").where(f"rep <> a and 100 * least(n, n_a) >= {percent} * greatest(n, n_a)")
    first = verified(near.select("a", F.col("rep").alias("b")).distinct(), "links-by-pivot")
    groups = saved(components(first, folder), "groups-by-pivot", folder).select(F.col("vertex").alias("rep"), "component")
    # sets that can link are in one band of sizes or in neighbours: a set meets its own band's and the next greater one's
    own = size_band(F.col("n"), percent)
    banded = postings.select("rep", "n", F.inline(F.array(*(F.struct(F.xxhash64("tile", own + k).alias("tile"), F.lit(k == 1).alias("low")) for k in (0, 1)))))
    open_ = banded.join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = open_.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"), F.bool_and("low").alias("low")).where("lo < hi and not low")
    mixed = mixed.select("tile", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("parts"))
    # a large tile becomes blocks, and each pair of blocks a cell; sides 1 and 2 only meet each other
    marked = active.select("rep", F.size("shared").cast("long").alias("m"), "bits")
    dealt = open_.join(mixed, "tile").join(marked, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cells = dealt.select(F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "rep", "n", "m", "component", "bits", "low", side.cast("int").alias("side"))
    pairs = cells.withColumn("bucket", F.pmod("cell", F.lit(4 * buckets))).groupBy("bucket").applyInArrow(_tile_pairs(percent), "a long, b long")
    second = verified(pairs.distinct(), "links-by-tile")
    groups = saved(components(first.union(second), folder), "groups", folder).withColumnRenamed("vertex", "rep")
    return sets.select("doc_id", "digest", "n"), reps, active, groups


def _of_documents(sets: DataFrame, found: DataFrame, folder: str | None) -> DataFrame:
    """(doc_id, n, ...) of every document, with what `found` (digest, n, copies, ...) knows of its set; null without words."""
    found = saved(found, "of-sets", folder)
    most = sets.count() // HOT_PARTS
    more = [c for c in found.columns if c not in ("digest", "n", "copies")]
    hot, others, rows = found.where(F.col("copies") > most), found.where(F.col("copies") <= most), sets.where("n > 0")
    hot = F.broadcast(hot.select("digest", "n", *more))  # at most HOT_PARTS rows
    known = rows.join(hot, ["digest", "n"]).unionByName(rows.join(hot.select("digest", "n"), ["digest", "n"], "left_anti").join(others.drop("copies"), ["digest", "n"]))
    blank = sets.where("n = 0").select("doc_id", "n", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more))
    return known.select("doc_id", "n", *more).unionByName(blank)


def _links(active: DataFrame, groups: DataFrame, percent: int, listed: bool) -> DataFrame:
    """All links of the components: pairs (a, b, common), or (rep, n_links), where n_links may come in parts."""
    held = active.select("rep", F.size("shared").cast("long").alias("m")).join(groups, "rep").groupBy("component").agg(F.count("*").alias("rows"), F.sum("m").alias("m"))
    large = held.select("component", F.ceil(F.greatest(F.col("rows") / TILE_ROWS, F.col("m") / TILE_SHINGLES)).cast("int").alias("parts")).where("parts > 1")
    placed = groups.join(large, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # as with tiles: pairs of parts, in which sides 1 and 2 only meet each other
    dealt = active.select("rep", "n", "shared", "bits").where(F.size("shared") > 0).join(placed, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cell = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    cells = dealt.select(cell.alias("cell"), "parts", "rep", "n", side.cast("int").alias("side"), "shared", "bits")
    bucket = F.when(F.col("parts") > 1, F.col("cell")).otherwise(F.pmod("cell", F.lit(bucket_count(active, 64 << 10, 256))))
    return cells.withColumn("bucket", bucket).drop("parts").groupBy("bucket").applyInArrow(_cell_links(percent, listed), "a long, b long, common long" if listed else "rep long, n_links long")


def similar_sets(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(sets, links): a row (doc_id, n, rep) of every document, and every link (a, b, common), a < b, between representatives.

    rep is the least doc_id with the same set; common is the number of shingles that both sets hold. A group of k
    near copies has up to k (k - 1) / 2 links.
    """
    sets, reps, active, groups = _grouped(docs, percent)
    return _of_documents(sets, reps, None), _links(active, groups, percent, True)


def join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; n_links counts the different sets linked with its own.

    Every link is found and counted where it is found, so that a large group sends no pairs. Copies have the n_links of their set.
    """
    return _joined(docs, percent, True)


def join_groups(docs: DataFrame, percent: int = 75, folder: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; enough links are followed to know the groups.

    folder: a shared folder for the tables that the result reads; the caller may remove it when it has the result.
    """
    return _joined(docs, percent, False, folder)


def _joined(docs: DataFrame, percent: int, counted: bool, folder: str | None = None) -> DataFrame:
    sets, reps, active, groups = _grouped(docs, percent, folder)
    if counted:
        counts = _links(active, groups, percent, False).groupBy("rep").agg(F.sum("n_links").alias("n_links"))
        groups = groups.join(saved(counts, "link-counts"), "rep", "left")
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    of_sets = reps.join(groups, "rep", "left").select("digest", "n", "copies", F.coalesce("component", "rep").alias("component"), *more)
    linked_ = _of_documents(sets, of_sets, folder).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *more)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = shingle_sets(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), batch.column(0)], names=["doc_id", "n_shingles", "component_id"])

    unnamed = text_rows(docs).where("doc_id is null").mapInArrow(lean(sizes), "doc_id long, n_shingles long, component_id long")
    return linked_.union(unnamed.withColumn("n_links", F.lit(0).cast("long")) if counted else unnamed)


def representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows, with all their columns, but those of documents in a group with a smaller doc_id."""
    folder = shared_folder(docs.sparkSession, "near-copies-work")
    others = saved(join_groups(docs, percent, folder).where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    removed(folder)
    released(docs.sparkSession)
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: groups of near-duplicate documents, and the number of different sets that each one's is linked with."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
shingles as (select doc_id, unnest(s) as g from sets),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from common join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * k >= 75 * (len(p.s) + len(q.s) - k)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sets union select reach.a, edges.b from reach join edges on reach.b = edges.a),
rep as (select doc_id, min(doc_id) over (partition by list_sort(s)) as rep from sets),
counts as (
  select a, count(distinct y.rep) as k from edges join rep x on x.doc_id = a join rep y on y.doc_id = b where x.rep <> y.rep group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, (select min(b) from reach where a = doc_id) as component_id,
  cast(coalesce((select k from counts where a = doc_id), 0) as bigint) as n_links from sets
"""
