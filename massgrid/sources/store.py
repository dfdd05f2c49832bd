"""A build on disk: one folder with the tables of proteins, peptides, taxa and ranks, what prunes them, statistics and configuration.

Peptides lie in folders by mass range and proteins by block of ids; `ranges` has bounds and taxa of each mass range, `grams`
the trigrams of protein names, and taxa carry their places in a walk of the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid.operators import build, layout, taxonomy
from massgrid.operators.digest import Protease
from massgrid.sources.files import config_text, read_config

TABLES = ("proteins", "peptides", "taxa", "ranks", "ranges", "grams")
#: Peptides of a mass range, and so of a file.
RANGE_ROWS = build.STRIPE


def write_blob(spark: SparkSession, text: str, path: str) -> None:
    """One text as one row, so that it is read back whole whatever its lines."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(path)


def read_blob(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(path).first().value


def _write_grams(proteins: DataFrame, path: str, mode: str) -> None:
    layout.gram_table(proteins).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode(mode).option("compression", "zstd").parquet(f"{path}/grams")


def append_proteins(rows: DataFrame, path: str) -> None:
    """More proteins to a stored table, as a block of their own, and their trigrams; the peptides of a build are made anew."""
    last = rows.sparkSession.read.parquet(f"{path}/proteins").agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]
    more = rows.withColumn("block", F.lit(last + 1))
    more.write.mode("append").partitionBy("block").parquet(f"{path}/proteins")
    _write_grams(more, path, "append")


def write(path: str, proteins: DataFrame, taxa: DataFrame, ranks: DataFrame, protease: Protease = Protease(), comment: str = "", range_rows: int = RANGE_ROWS, block_rows: int = layout.BLOCK) -> None:
    """Digest, aggregate and store everything; peptides are sorted by mass, proteins by id."""
    spark = proteins.sparkSession
    layout.write_ranges(proteins, f"{path}/proteins", "id", ["id"], "block", block_rows)
    taxonomy.nested(taxa).repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/taxa")
    ranks.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    stored = spark.read.parquet(f"{path}/proteins")
    _write_grams(stored, path, "overwrite")
    layout.write_ranges(build.peptides(stored, protease), f"{path}/peptides", "mass", ["mass", "sequence"], "partition", range_rows)
    table = spark.read.parquet(f"{path}/peptides")
    layout.range_table(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    write_stats(counters(stored, table), path)
    ranges = sorted(tuple(r) for r in spark.read.parquet(f"{path}/ranges").select("lo", "hi", "n").collect())  # a row for each file
    write_blob(spark, config_text(protease, ranges, comment), f"{path}/configuration")


def counters(proteins: DataFrame, table: DataFrame) -> DataFrame:
    """(key, value): numbers of proteins, peptides and masses, and the bytes of proteins and peptides."""
    sizes = [rows.agg(F.lit(key).alias("key"), F.coalesce(F.sum(size), F.lit(0)).alias("value")) for key, rows, size in (("protein_bytes", proteins, build.protein_bytes()), ("peptide_bytes", table, row_size()))]
    return build.stats(proteins, table).union(sizes[0]).union(sizes[1])


def row_size():
    from massgrid.functions.chemistry import row_bytes

    return row_bytes()


def write_stats(stats: DataFrame, path: str) -> None:
    """Statistics by key; the values of keys that are there already are replaced, others stay."""
    spark = stats.sparkSession
    new = {r.key: r.value for r in stats.collect()}  # a handful
    write_blob(spark, repr(sorted((read_stats(spark, path) | new).items())), f"{path}/stats")


def read_stats(spark: SparkSession, path: str) -> dict[str, int]:
    import ast

    from pyspark.errors import AnalysisException

    try:
        return dict(ast.literal_eval(read_blob(spark, f"{path}/stats")))
    except AnalysisException:  # no statistics yet
        return {}


def read(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables by name, configuration)."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, read_config(read_blob(spark, f"{path}/configuration"))


def missing_associations(proteins: DataFrame, peptides: DataFrame) -> DataFrame:
    """(mass, sequence, id) of protein ids in the peptide table that the protein table lacks; a sound build has none."""
    return peptides.select("mass", "sequence", F.explode("protein_ids").alias("id")).join(proteins.select("id"), "id", "left_anti").select("mass", "sequence", "id")
