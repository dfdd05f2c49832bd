"""Divergence of sources from their language and from one another, by smoothed shares of terms, in whole numbers.

Texts of an Arrow batch lie end to end as UTF-8 bytes; a lookup table marks bytes of terms and lower-cases A-Z, and where
the mark changes a term begins or ends. Terms are grouped by their XXH64, which is computed for all slices of one length
at once and put in order with the source; neighbours of one hash are then compared byte by byte, and where they differ
told apart by their bytes. So a batch gives one row for each (lang, source, term), with occurrences and documents.

After the counts are added up and terms in too few documents of their language dropped, terms are dealt to blocks by a
hash, and sources, where a language has very many, to tiles. For a block and two tiles a task holds a CSR matrix of
shares, sources by terms; the divergence of one source from all others is one vector operation over the stored
cells, summed by row with reduceat, and shares of absent terms, which are one number for each source, are added
in closed form. Blocks are added up by Spark. The numbers of a group, a term and a language travel with the cells, so
nothing is broadcast. Shares are whole billionths by long division, so products never leave 64 bits.

Cases: null text, lang and source are ''; a text without terms counts as a document and gives its group; repeated rows are
documents of their own; a language without kept terms has pairs of value 0 and no terms; a language with one source has
no pairs; ties are ordered by the item's UTF-8 bytes; an empty table gives an empty result; other columns,
whatever their names, are ignored. Long texts are split over blocks of bytes only between texts, never inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massgrid.llm.bytesops import U64, gather_ranges, mix, text_bytes, words
from massgrid.llm.bpe import blocks
from massgrid.llm.common import lean, saved, shared_folder

BILLION = 10**9
#: Added to every count.
PRIOR = 5
#: Documents of a language that a term must stand in, and terms of a group that are reported.
LEAST_DOCUMENTS, TOP = 30, 50
#: Bytes of text that are tokenized at once, cells of a block, sources of a tile.
BLOCK_BYTES, BLOCK_CELLS, TILE_SOURCES = 16 << 20, 1 << 18, 256
#: Bytes that are no part of a term: ASCII other than letters.
BREAK = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The five primes of XXH64, fixed values of that hash.
P1, P2, P3, P4, P5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of the slices of a byte array. Slices under 32 bytes are hashed together by length, others by the library."""
    out = np.empty(len(start), U64)
    order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(size[order].clip(max=32), np.arange(34))
    for n in range(32):
        at = order[bounds[n] : bounds[n + 1]]
        if not len(at):
            continue
        cells = data[start[at][:, None] + np.arange(n)]
        h = np.full(len(at), P5 + U64(n), U64)
        done = 0
        while n - done >= 8:
            lane = np.ascontiguousarray(cells[:, done : done + 8]).view("<u8")[:, 0]
            h = _rotated(h ^ (_rotated(lane * P2, 31) * P1), 27) * P1 + P4
            done += 8
        if n - done >= 4:
            h = _rotated(h ^ (np.ascontiguousarray(cells[:, done : done + 4]).view("<u4")[:, 0].astype(U64) * P1), 23) * P2 + P3
            done += 4
        for k in range(done, n):
            h = _rotated(h ^ (cells[:, k].astype(U64) * P5), 11) * P1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        out[at] = h ^ (h >> U64(32))
    for i in order[bounds[32] :]:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return out


def _equal(data: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether slices a[i] and b[i] have the same bytes, eight at a time."""
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))  # the eight bytes from any place
    same = size[a] == size[b]
    at, done = np.flatnonzero(same), 0
    while len(at := at[size[a[at]] > done]):
        unused = U64(8) * (U64(8) - np.minimum(size[a[at]] - done, 8).astype(U64))
        differ = ((eight[start[a[at]] + done] ^ eight[start[b[at]] + done]) << unused) != 0
        same[at[differ]] = False
        at, done = at[~differ], done + 8
    return same


def grouped(data: np.ndarray, start: np.ndarray, size: np.ndarray, source: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): slices so ordered that those of one source and term lie together, in their own order, and where each such run begins.

    Equal hashes come together first; neighbours are then compared by source and bytes, and where they differ, runs of one hash are told apart by their bytes.
    """
    key = mix(hashes + U64(0x9E3779B97F4A7C15) * (source + 1).astype(U64))
    order = np.argsort(key, kind="stable")
    known = np.append(False, key[order[1:]] == key[order[:-1]])
    at = np.flatnonzero(known)
    exact = _equal(data, start, size, order[at], order[at - 1]) & (source[order[at]] == source[order[at - 1]])
    same = known.copy()
    same[at] = exact
    if not exact.all():
        run = np.cumsum(~known)
        for r in np.unique(run[at[~exact]]):
            low, high = np.searchsorted(run, [r, r + 1])
            own = [(source[i], data[start[i] : start[i] + size[i]].tobytes(), i) for i in order[low:high]]
            own.sort()
            order[low:high] = [i for *_, i in own]
            same[low + 1 : high] = [x[:2] == y[:2] for x, y in zip(own, own[1:])]
    return order, np.flatnonzero(~same)


def term_counts(raw: np.ndarray, offsets: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, occurrences, texts, bytes, start, size) of every source and term of some texts; `source` numbers each text's lang and source."""
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = LOWER[raw]
    start, end, first = words(data[: len(raw)], offsets, BREAK)
    size, text = end - start, np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order, begins = grouped(data, start, size, source[text], xxh64(data, start, size))
    heads, text = order[begins], text[order]
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = text[1:] != text[:-1]
    fresh[begins] = 1
    in_texts = np.add.reduceat(fresh, begins) if len(begins) else begins
    return source[text[begins]], np.diff(np.append(begins, len(order))), in_texts, data, start[heads], size[heads]


def prepared(docs: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_docs) of all texts, added up over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            numbers: dict = {}
            source = np.array([numbers.setdefault((x["lang"], x["source"]), len(numbers)) for x in pairs.to_pylist()], np.int64)
            names = list(numbers)
            for i, j in blocks(offsets, BLOCK_BYTES):
                of, n, in_docs, data, start, size = term_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], source[i:j])
                ends = np.concatenate([[0], np.cumsum(size)])
                terms = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[gather_ranges(start, size)])).cast(pa.string())
                lang, src = (pa.array([x[k] for x in names], pa.string()).take(pa.array(of)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, src, terms, pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "in_docs"])

    cells = prepared(docs).mapInArrow(lean(run), "lang string, source string, term string, n long, in_docs long")
    return cells.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) for count <= total < 2**53, by long division to base 1000."""
    count, total = np.broadcast_arrays(np.asarray(count, np.int64), np.asarray(total, np.int64))
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def share_column(count: str, total: str) -> F.Column:
    """The same of two long columns."""
    out = f"{count} div {total}"
    rest = f"{count} % {total}"
    for _ in range(3):
        out, rest = f"(({out}) * 1000 + (({rest}) * 1000) div {total})", f"((({rest}) * 1000) % {total})"
    return F.expr(f"1 + {out}")


def tables(docs: DataFrame, folder: str, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, cells), both written.

    groups: lang, source, total (N + 5 V of the group), terms (V), tile, tiles and blocks of the language.
    cells: lang, term, source, n, total, lang_n, lang_total, block, for kept terms with n > 0.
    """
    every = saved(counted(docs), "counts", folder)
    kept = every.groupBy("lang", "term").agg(F.sum("in_docs").alias("in_docs"), F.sum("n").alias("lang_n")).where(F.col("in_docs") >= least)
    kept = saved(kept.drop("in_docs"), "kept", folder)
    cells = saved(every.drop("in_docs").join(kept, ["lang", "term"]), "shared", folder)
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")).join(cells.groupBy("lang").agg(F.count("*").alias("cells")), "lang")
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    pairs = prepared(docs).select("lang", "source").distinct()
    tiles = pairs.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"))
    numbers = pairs.join(tiles, "lang").join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    terms = F.coalesce("terms", F.lit(0))
    groups = numbers.select(
        "lang", "source", (F.coalesce("total", F.lit(0)) + PRIOR * terms).alias("total"), terms.alias("terms"), (F.coalesce("lang_total", F.lit(0)) + PRIOR * terms).alias("lang_total"),
        F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), "tiles", (F.coalesce("cells", F.lit(0)) / BLOCK_CELLS + 1).cast("int").alias("blocks"),
    )
    groups = saved(groups, "groups", folder)
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    return groups, saved(cells.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "lang_n", "total", "lang_total", "tile", "tiles", "blocks", block), "cells", folder)


def divergences(n: np.ndarray, column: np.ndarray, bounds: np.ndarray, total: np.ndarray, width: int, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sums of |p - q| over `width` terms for each of `rows` and of `others`, rows of a CSR matrix of counts.

    From each sum `width` times the difference of the shares of absent terms is taken, so that terms which no row has need not be known.
    """
    data = share(n + PRIOR, np.repeat(total, np.diff(bounds)))
    base = share(np.full(len(total), PRIOR), total)
    stored = np.flatnonzero(np.diff(bounds))
    summed = np.zeros((len(rows), len(total)), np.int64)
    for k, row in enumerate(rows):
        dense = np.full(width, base[row])
        own = slice(bounds[row], bounds[row + 1])
        dense[column[own]] = data[own]
        # terms that the other lacks: all terms at its base share, less those that it has
        rank = np.sort(dense)
        ahead = np.concatenate([[0], np.cumsum(rank)])
        below = np.searchsorted(rank, base)
        summed[k] = base * below - ahead[below] + (ahead[-1] - ahead[below]) - base * (width - below)
        if len(stored):
            here = dense[column]
            cells = np.abs(data - here) - np.abs(np.repeat(base, np.diff(bounds)) - here)
            summed[k, stored] += np.add.reduceat(cells, bounds[:-1][stored])
        summed[k] -= width * np.abs(base - base[row])
    return summed[:, others]


def pair_sums(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language with kept terms, in blocks of terms and tiles of sources: what
    their divergence has beyond that of two sources without terms."""
    tile_pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("low"), F.greatest("tile", t).alias("high")))
    in_blocks = groups.where("terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = in_blocks.select("lang", "source", "total", "tile", "block", F.explode(tile_pairs).alias("pair"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    body = cells.select("lang", "source", "total", "tile", "block", F.explode(tile_pairs).alias("pair"), "term", "n")
    rows = heads.unionByName(body).select("lang", "block", "pair.low", "pair.high", "source", "total", "tile", "term", "n")

    def block(table: pa.Table) -> pa.Table:
        source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
        source, names, term, width = source.indices.to_numpy(), source.dictionary, term.indices.fill_null(-1).to_numpy(), len(term.dictionary)
        n, tile = table.column("n").to_numpy(), table.column("tile").to_numpy()
        head = np.flatnonzero(term < 0)
        total, tiles = np.ones(len(names), np.int64), np.zeros(len(names), np.int64)
        total[source[head]], tiles[source[head]] = table.column("total").to_numpy()[head], tile[head]
        cell = np.flatnonzero(term >= 0)
        cell = cell[np.argsort(source[cell], kind="stable")]
        bounds = np.searchsorted(source[cell], np.arange(len(names) + 1))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        rows, others = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
        sums = divergences(n[cell], term[cell], bounds, total, width, rows, others)
        a, b = np.repeat(rows, len(others)), np.tile(others, len(rows))
        keep = a != b
        out = [pa.array([table.column("lang")[0].as_py()] * int(keep.sum()), pa.string()), names.take(pa.array(a[keep])), names.take(pa.array(b[keep])), pa.array(sums.ravel()[keep], pa.int64())]
        if low == high:
            return pa.table(out, names=["lang", "source", "item", "value"])
        back = [out[0], out[2], out[1], out[3]]
        return pa.concat_tables([pa.table(x, names=["lang", "source", "item", "value"]) for x in (out, back)])

    parts = rows.groupBy("lang", "block", "low", "high").applyInArrow(block, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: all other sources, and the terms above the language's share."""
    groups, cells = tables(docs, shared_folder(docs.sparkSession, "divergence"), least)
    others = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = groups.select("lang", "source", "total", "terms").join(others, "lang").where(F.col("source") != F.col("item")).join(pair_sums(groups, cells), ["lang", "source", "item"], "left")
    absent = F.col("terms") * F.abs(share_column(str(PRIOR), "total") - share_column(str(PRIOR), "item_total"))
    value = F.when(F.col("terms") > 0, absent + F.coalesce("value", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shares = cells.select("lang", "source", F.col("term").alias("item"), (F.col("n") + PRIOR).alias("n"), "total", (F.col("lang_n") + PRIOR).alias("lang_n"), "lang_total")
    excess = shares.select("lang", "source", "item", (share_column("n", "total") - share_column("lang_n", "lang_total")).alias("value"))
    best = excess.where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    terms = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: divergences of all sources of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_share(count: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + {PRIOR})) // ({total}))"


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
pairs AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
totals AS (SELECT p.lang, p.source, coalesce(sum(c.n), 0) AS n FROM pairs p LEFT JOIN cells c ON p.lang = c.lang AND p.source = c.source GROUP BY ALL),
shares AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {_sql_share("coalesce(c.n, 0)", f"t.n + {PRIOR} * l.v")} AS p, {_sql_share("k.n", f"l.n + {PRIOR} * l.v")} AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
