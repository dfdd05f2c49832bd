"""Stored tables in ranges of a key, and what prunes them: mass ranges, bitmaps of taxa, and trigrams.

A table is dealt to ranges of about equal rows and written with the range's number as a partition column, so a search
that knows the ranges it needs lists and opens no other files. The numbers come from small tables that are stored beside.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massgrid.operators.search import BUCKET, names_match
from massgrid.plans.ptm import Plan
from massgrid.shared import written

#: Rows of a range of peptides and of proteins.
STRIPE, BLOCK = 150_000, 100_000
#: Ranges of a table: each is a folder and a task. Beyond so many, ranges grow up to STRIPE rows before there are more of them.
MOST_RANGES = 512
#: Greatest taxon whose bitmap is a literal: 8 MB at most. Beyond it taxa are joined.
MOST_TAXON = (1 << 26) - 1


def write_ranges(table: DataFrame, path: str, key: str, order: list[str], number: str, rows: int) -> None:
    """Rows in ranges of the key, sorted within each; equal keys share a range. The table is made once and counted as it stands."""
    made = written(table, "ranged")
    parts = range_number(made.count(), rows)
    dealt = made.repartitionByRange(parts, key).withColumn(number, F.spark_partition_id())
    dealt.sortWithinPartitions(number, *order).write.mode("overwrite").partitionBy(number).option("compression", "zstd").parquet(path)


def range_number(n: int, rows: int) -> int:
    """How many ranges n rows have: of the asked size up to MOST_RANGES, then larger ones, so that files grow and not their number."""
    return max(1, min(math.ceil(n / rows), MOST_RANGES), math.ceil(n / max(rows, STRIPE)))


def range_table(peptides: DataFrame) -> DataFrame:
    """(partition, lo, hi, n, taxa): bounds and size of each mass range, and the taxa of its peptides as words of 64 bits by number."""
    bounds = peptides.groupBy("partition").agg(F.min("mass").alias("lo"), F.max("mass").alias("hi"), F.count("*").alias("n"))
    borne = peptides.select("partition", F.explode(F.concat("unique_taxonomy_ids", "non_unique_taxonomy_ids")).alias("id"))
    words = borne.groupBy("partition", F.expr("id div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(id % 64))")).alias("bits"))
    bitmaps = words.groupBy("partition").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("taxa"))
    return bounds.join(bitmaps, "partition", "left")


def touched_by(windows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(partition) of the ranges that meet one of the windows (lo, hi); by 1-Dalton buckets, so there is an equality to join on."""
    buckets = F.explode(F.sequence(F.expr(f"lo div {BUCKET}"), F.expr(f"hi div {BUCKET}"))).alias("bucket")
    asked = windows.select("lo", "hi", buckets).alias("w")
    both = ranges.select("partition", "lo", "hi", buckets).alias("r").join(asked, "bucket")
    return both.where("r.lo <= w.hi and r.hi >= w.lo").select("partition").distinct()


def pruned(peptides: DataFrame, plan: Plan, ranges: DataFrame, taxa: bytes | None = None) -> DataFrame:
    """The peptides of the ranges that the plan's windows meet and, if a bitmap of taxa is given, that bear one of them.

    The numbers of the ranges go to the driver, a few for each window, and become a filter on the partition column.
    """
    windows = peptides.sparkSession.createDataFrame([plan.window(c) for c in plan.conditions], "lo long, hi long")
    near = ranges if taxa is None else ranges.where(F.exists(F.map_entries("taxa"), lambda e: words_meet(taxa, e["key"], e["value"])))
    return peptides.where(F.col("partition").isin([r.partition for r in touched_by(windows, near).collect()]))


def bitmap_of(taxa: DataFrame) -> bytes | None:
    """Taxa (id) as a bitmap, eight to a byte; None if there is an id that is negative or over MOST_TAXON."""
    ids = taxa.select(F.col("id").cast("long").alias("id"))
    rows = ids.groupBy(F.expr("id div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, int(abs(id % 8)))")).alias("bits"), F.min("id").alias("least"), F.max("id").alias("most"))
    ends = rows.agg(F.min("least").alias("least"), F.max("most").alias("most")).first()
    if ends.most is None:
        return b""
    if ends.least < 0 or ends.most > MOST_TAXON:
        return None
    out = bytearray(ends.most // 8 + 1)
    for r in rows.select("at", "bits").toLocalIterator():  # 8 MB of bits at most
        out[r.at] = r.bits
    return bytes(out)


def _byte(bitmap: bytes, at: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(F.lit(bytearray(bitmap)), (at + 1).cast("int"), 1)), 16, 10).cast("int"), F.lit(0))


def has(bitmap: bytes, taxon: Column) -> Column:
    """Whether a taxon is in a bitmap."""
    within = (taxon >= 0) & (taxon < 8 * len(bitmap))
    return within & (F.getbit(_byte(bitmap, F.floor(taxon / 8)), (taxon % 8).cast("int")) == 1)


def words_meet(bitmap: bytes, word: Column, bits: Column) -> Column:
    """Whether a word of 64 taxa has one of the bitmap."""
    within = (word >= 0) & (word * 8 < len(bitmap))
    return within & reduce(lambda a, b: a | b, (_byte(bitmap, word * 8 + k).cast("long").bitwiseAND(F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255))) != 0 for k in range(8)))


def of_bitmap(peptides: DataFrame, bitmap: bytes, unique: bool = False) -> DataFrame:
    """Peptides of a protein of one of the taxa; unique: unique in exactly one of them. A filter, so nothing is shuffled."""
    if unique:
        return peptides.where(F.size(F.filter("unique_taxonomy_ids", lambda t: has(bitmap, t))) == 1)
    return peptides.where(F.exists("unique_taxonomy_ids", lambda t: has(bitmap, t)) | F.exists("non_unique_taxonomy_ids", lambda t: has(bitmap, t)))


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case."""
    low = F.lower(text)
    return F.when(F.length(low) > 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def gram_table(proteins: DataFrame) -> DataFrame:
    """(gram, id, block): postings of accessions and gene names of proteins that are stored in blocks."""
    grams = F.array_union(trigrams(F.coalesce("accession", F.lit(""))), trigrams(F.coalesce(F.array_join("genes", " "), F.lit(""))))
    return proteins.select(F.explode(grams).alias("gram"), "id", "block")


def grams_of(term: str) -> set[str]:
    """Trigrams that a text must have for a term; % and _ stand for any text. Only those whose lower case is beyond doubt."""
    pieces = [] if "\\" in term else re.split("[%_]", term.lower())
    return {p[i : i + 3] for p in pieces for i in range(len(p) - 2) if p[i : i + 3].isascii()}


def candidates(grams: DataFrame, terms: tuple[str, ...]) -> DataFrame | None:
    """(id, block) of the proteins that have all trigrams of a term; None if a term has none, so that all must be read."""
    found = []
    for term in terms:
        wanted = sorted(grams_of(term))
        if not wanted:
            return None
        hits = grams.where(F.col("gram").isin(wanted)).groupBy("id", "block").agg(F.count("*").alias("n"))
        found.append(hits.where(F.col("n") == len(wanted)).select("id", "block"))
    return reduce(DataFrame.union, found).distinct()


def find_indexed(proteins: DataFrame, grams: DataFrame, *terms: str) -> DataFrame:
    """What search.find_proteins finds, reading the blocks of proteins that have a candidate; reviewed ones first."""
    test = names_match(terms)
    near = candidates(grams, terms)
    if near is not None:
        near = written(near, "candidates")
        blocks = [r.block for r in near.select("block").distinct().collect()]  # a number for each block at most
        proteins = proteins.where(F.col("block").isin(blocks)).join(near.select("id"), "id", "left_semi")
    return proteins.where(test).orderBy(F.desc("is_reviewed"), "accession")
