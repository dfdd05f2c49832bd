"""From proteins to the peptide table: one shuffle on mass and sequence, then a layout sorted by mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massgrid.functions.chemistry import residue_counts
from massgrid.operators.digest import Protease, digest, digest_masses
from massgrid.shared import written

#: Rows of one file, and so of one mass range: a search reads the footers' minima and maxima and few files.
STRIPE = 150_000


def aggregate(digested: DataFrame, proteins: bool = True, taxa: bool = True, names: bool = False) -> DataFrame:
    """(mass, sequence, protein_ids, unique_taxonomy_ids, non_unique_taxonomy_ids, is_swiss_prot, is_trembl).

    A taxon is unique to a peptide if just one of its proteins bears it. One shuffle: the map sides collect each peptide's
    (taxon, protein) pairs, and the lists are made of the sorted pairs. proteins/taxa=False leave the lists empty.
    names: adds `accessions`, sorted, from the digest's, so that ids need not be joined with proteins again.
    """
    pairs = digested.groupBy("mass", "sequence").agg(F.sort_array(F.collect_set(F.struct("taxonomy_id", "protein_id", *(["accession"] if names else [])))).alias("pairs"), F.bool_or("is_reviewed").alias("is_swiss_prot"), F.bool_or(~F.col("is_reviewed")).alias("is_trembl"))
    empty = F.array().cast("array<int>")
    same = lambda t, at, x: F.coalesce(F.get(t, at) == x, F.lit(False))
    # pairs are sorted by taxon, so a taxon of one protein differs from its neighbours, and others are told by their second place
    alone = lambda t: F.filter(t, lambda x, i: ~same(t, i - 1, x) & ~same(t, i + 1, x))
    shared = lambda t: F.filter(t, lambda x, i: same(t, i - 1, x) & ~same(t, i - 2, x))
    of = lambda body: F.transform(F.array("pairs.taxonomy_id"), body)[0]  # noqa: E731 - the list is made once, not for each of its places
    one = F.size("pairs") == 1  # as most peptides have: nothing to sort or to tell apart
    return pairs.select(
        "mass",
        "sequence",
        (F.when(one, F.col("pairs.protein_id")).otherwise(F.sort_array(F.array_distinct("pairs.protein_id"))) if proteins else F.array().cast("array<long>")).alias("protein_ids"),
        (F.when(one, F.col("pairs.taxonomy_id")).otherwise(of(alone)) if taxa else empty).alias("unique_taxonomy_ids"),
        (F.when(one, empty).otherwise(of(shared)) if taxa else empty).alias("non_unique_taxonomy_ids"),
        "is_swiss_prot",
        "is_trembl",
        *([F.sort_array("pairs.accession").alias("accessions")] if names else []),
    )


def peptides(proteins: DataFrame, protease: Protease = Protease()) -> DataFrame:
    """The peptide table with residue counts."""
    return aggregate(digest(proteins.select("id", "sequence", "taxonomy_id", "is_reviewed"), protease)).withColumn("aa_counts", residue_counts(F.col("sequence")))


def write_peptides(table: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted by mass over all files, so row groups have narrow mass ranges."""
    ranged = table.repartitionByRange(partitions, "mass") if partitions else table.repartitionByRange("mass")
    ranged.sortWithinPartitions("mass", "sequence").write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", STRIPE).parquet(path)


def protein_bytes(sequence: str = "sequence", accession: str = "accession", genes: str = "genes") -> Column:
    """Estimated bytes of a protein row: id, taxon and flag, packed sequence, accession and genes."""
    packed = F.floor((F.lit(16) + 5 * F.length(sequence) + 7) / 8)
    return (F.lit(4 + 4 + 1) + packed + F.octet_length(accession) + F.coalesce(F.aggregate(genes, F.lit(0), lambda n, g: n + F.octet_length(g)), F.lit(0))).cast("long")


def pairs_per_protein(digested: DataFrame, proteins: DataFrame) -> DataFrame:
    """(proteins, pairs, mean): different (mass, protein) pairs, and how many a protein has; counted, not sampled."""
    pairs = digested.groupBy("protein_id").agg(F.countDistinct("mass").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return pairs.crossJoin(proteins.agg(F.count("*").alias("proteins"))).select("proteins", "pairs", (F.col("pairs") / F.greatest("proteins", F.lit(1))).alias("mean"))


def estimated_pairs(proteins: DataFrame, protease: Protease = Protease(), error: float = 0.05, first: int = 256, z: float = 5.0) -> DataFrame:
    """(proteins, sampled, mean, low, high, pairs): how many different masses a protein has, from a sample.

    Proteins are drawn by a hash of their id with chances in proportion to their lengths, about `first` of them, and more
    until the interval is within `error` of the mean, or all are drawn and the mean is exact. Pairs grow with the length, so
    masses per residue are estimated, which are bounded, however long a few proteins are. The interval is z standard errors
    (at z = 5, one in a million misses it) and, for what no draw has shown, z^2/2 draws of the most masses per residue seen.
    Each sample holds the one before it. All lengths are read, but only the proteins drawn are digested, for their masses
    alone; a protein without peptides counts as 0.
    """
    spark = proteins.sparkSession
    sized = proteins.select("id", "sequence", F.length("sequence").cast("double").alias("size"))
    total, residues, longest = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0.0)), F.coalesce(F.max("size"), F.lit(0.0))).first()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    wanted = float(first)
    while True:
        each = wanted / residues if residues else 0.0
        whole = 2 * wanted >= total or not residues
        # the first condition needs the id alone, so sequences of others are not made
        drawn = sized if whole else written(sized.where(place < each * longest).where(place < each * F.col("size")), "drawn")
        counts = digest_masses(drawn.select("id", "sequence"), protease).groupBy("protein_id").agg(F.countDistinct("mass").alias("n"))
        if whole:
            mean = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / max(total, 1)
            sampled, half = total, 0.0
            break
        sizes = drawn.groupBy("id").agg(F.sum("size").alias("size"), F.max("size").alias("row"))
        chance = F.least(F.lit(1.0), each * F.col("row"))
        every = sizes.join(counts, F.col("id").eqNullSafe(F.col("protein_id")), "left").select(F.coalesce("n", F.lit(0)).cast("double").alias("n"), "size", (1 / chance).alias("w"))
        spare = F.col("w") * (F.col("w") - 1)  # what a protein that is drawn for certain has none of
        x = every.agg(F.count("*").alias("k"), F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("size")).alias("size"), F.max(F.col("n") / F.col("size")).alias("most"), *(F.sum(spare * F.col(a) * F.col(b)).alias(a + b) for a, b in (("n", "n"), ("n", "size"), ("size", "size")))).first()
        rate = x.n / x.size if x.k else 0.0
        if rate:
            spread = z * max(0.0, x.nn - 2 * rate * x.nsize + rate**2 * x.sizesize) ** 0.5 / residues / rate
            unseen = z * z / 2 * x.most / rate / wanted
            if spread + unseen <= error:
                sampled, mean = x.k, rate * residues / total
                half = (spread + unseen) * mean
                break
            # the size at which both, falling with its root and with itself, would be within the error
            a, b = spread * wanted**0.5, unseen * wanted
            wanted = max(2 * wanted, 1.1 * ((a + (a * a + 4 * b * error) ** 0.5) / (2 * error)) ** 2)
        else:
            wanted *= 4
    row = (total, sampled, float(mean), float(mean - half), float(mean + half), round(mean * total))
    return spark.createDataFrame([row], "proteins long, sampled long, mean double, low double, high double, pairs long")


def unassigned(table: DataFrame, ranges: DataFrame) -> DataFrame:
    """(mass, peptides) of masses that no range holds; a sound tiling has none."""
    return unheld(mass_counts(table), ranges)


def unheld(counts: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same from counted masses."""
    masses = counts.select("mass", F.col("n").alias("peptides"))
    return masses.join(partitions_of(masses.select("mass"), ranges).select("mass"), "mass", "left_anti")


def mass_index(digested: DataFrame) -> DataFrame:
    """(mass, protein_ids): sorted distinct proteins of every mass; a digest of masses alone will do."""
    return digested.groupBy("mass").agg(F.sort_array(F.collect_set("protein_id")).alias("protein_ids"))


def mass_counts(table: DataFrame) -> DataFrame:
    """(mass, n): how many peptides have a mass."""
    return table.groupBy("mass").agg(F.count("*").alias("n"))


def peptide_counts(digested: DataFrame) -> DataFrame:
    """(mass, n): how many different peptides have a mass, from rows in which a peptide may come more than once.

    Equal peptides have equal masses, so dealt by mass alone they meet, are told apart and counted without another shuffle.
    """
    return mass_counts(digested.select("mass", "sequence").repartition("mass").distinct())


def partition_ranges(table: DataFrame, rows: int = STRIPE) -> DataFrame:
    """(partition, lo, hi, n): consecutive mass ranges of about `rows` peptides each; all of one mass share a range."""
    return tiled(written(mass_counts(table), "mass-counts"), rows)


def tiled(counts: DataFrame, rows: int = STRIPE) -> DataFrame:
    """The same from counted masses, which are read twice.

    Running counts are taken in two levels, inside a bucket of masses and over buckets, so no task sorts more than one
    bucket's masses.
    """
    counts = counts.withColumn("bucket", F.expr("mass div 100000000000"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    ahead = buckets.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("before"))  # a row for each 100 Dalton
    inside = Window.partitionBy("bucket").orderBy("mass").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("before")
    placed = counts.join(ahead, "bucket").withColumn("partition", F.floor(start / rows).cast("long"))
    return placed.groupBy("partition").agg(F.min("mass").alias("lo"), F.max("mass").alias("hi"), F.sum("n").alias("n"))


def tiling_faults(ranges: DataFrame) -> DataFrame:
    """Ranges that overlap the one before them; empty if the tiling is sound. A handful of rows by design."""
    before = F.lag("hi").over(Window.orderBy("lo", "hi"))
    return ranges.select("partition", "lo", "hi", before.alias("before")).where("before >= lo")


def partitions_of(masses: DataFrame, ranges: DataFrame) -> DataFrame:
    """All ranges that hold a mass: an interval join, made an equi-join on 1-Dalton buckets of both."""
    spread = ranges.select("partition", "lo", "hi", F.explode(F.sequence(F.expr("lo div 1000000000"), F.expr("hi div 1000000000"))).alias("bucket"))
    return masses.withColumn("bucket", F.expr("mass div 1000000000")).join(spread, "bucket").where("mass between lo and hi").select(*masses.columns, "partition")


def stats(proteins: DataFrame, table: DataFrame) -> DataFrame:
    """(key, value): numbers of proteins, peptides and masses."""
    p = table.agg(F.count("*").alias("peptides"), F.countDistinct("mass").alias("masses"))
    return p.crossJoin(proteins.agg(F.count("*").alias("proteins"))).select(F.expr("stack(3, 'proteins', proteins, 'peptides', peptides, 'masses', masses) as (key, value)"))


def touching_windows(windows: DataFrame) -> DataFrame:
    """(partition, signature, lo, hi, members) after joining windows of one partition and signature that overlap or touch."""
    order = Window.partitionBy("partition", "signature").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("new", (reach.isNull() | (reach < F.col("lo"))).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(order))
    return island.groupBy("partition", "signature", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("members")).drop("island")
