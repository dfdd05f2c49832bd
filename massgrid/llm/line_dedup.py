"""Line dedup by levelled sorted runs of line hashes, DataFrame functions alone.

A line's key is the line without white space at both ends, A-Z lower-cased; two 64-bit hashes with unlike seeds stand for
it. Documents come in batches of ascending doc_id. A run is a table of (h1, h2, owner), hashed to buckets and sorted
within each, of keys that no earlier run holds; its owner is the smallest doc_id that has the key. A new batch is reduced
to one row a key (with map-side combine, so a line that a third of all documents hold is one row a task), merge-anti-joins
the runs, bucket by bucket without moving them, and adds what is left as a run of level 0. Where a level has `fanout`
runs they are compacted into one run of the next level, so n batches leave about fanout * log(n) runs.

A line is dropped if its key has another owner. That is an anti-join on (h1, h2, doc_id), so no key is hot: a pair of
key and document has as many rows as that document has such lines. Places of dropped lines are brought back to the
texts by one join on doc_id.

Cases: a null or empty text is one empty line; keys under `least` code points, empty ones included, are never dropped; an
owner keeps all lines of its key, repeated ones too; rows that share a doc_id are one document, repeated rows are
answered each; rows with a null doc_id are no documents: they own nothing and keep all their lines; an empty table gives
an empty result; other columns, whatever their names, are ignored. Texts are split whole, and time grows with the text.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid.llm.common import removed, saved, shared_folder, text_rows
from massgrid.llm.secrets import let

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of the shortest key that counts.
LEAST = 10
BATCHES, FANOUT = 6, 3
HASHES = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased; lines in ASCII alone take the quick way."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, place, h1, h2) of every line whose key counts; row tells apart texts that share a doc_id."""
    texts = text_rows(docs).where(F.col("doc_id").isNotNull())
    lines = texts.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keys = lines.select("doc_id", "row", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select("doc_id", "row", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of line hashes in one folder; `levels[i]` names the tables of level i.

    Runs are external tables of the session's catalog, so that Spark knows their buckets. As many buckets as
    shuffle partitions: what a batch is grouped by needs no second shuffle to meet them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_folder(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        """All runs, the highest level first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def owners(self) -> DataFrame:
        """(h1, h2, owner) of every key so far; each key stands in one run."""
        empty = self.spark.createDataFrame([], "h1 long, h2 long, owner long")
        return reduce(DataFrame.union, self.runs()) if any(self.levels) else empty

    def add(self, lines: DataFrame) -> None:
        """Take in a batch (h1, h2, doc_id), whose doc_ids are greater than those of all earlier ones."""
        fresh = lines.groupBy(*HASHES).agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), HASHES, "left_anti")
        self._store(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self._store(reduce(DataFrame.union, map(self.spark.table, old)).repartition(self.buckets, *HASHES), level + 1)
        self.levels[level] = []
        self._forget(old)

    def _store(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            removed(f"{self.folder}/{name}")


def batched(lines: DataFrame, docs: DataFrame, batches: int) -> DataFrame:
    """Adds `batch`: ranges of ascending doc_id with about as many documents each; a doc_id is in one batch."""
    shares = [k / batches for k in range(1, batches)]
    bounds = (docs.select(F.percentile_approx(F.col("doc_id").cast("long"), shares, 10_000)).first()[0] or []) if shares else []
    return lines.withColumn("batch", reduce(Column.__add__, ((F.col("doc_id") > b).cast("int") for b in sorted(set(bounds))), F.lit(0)))


def dropped_places(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """(doc_id, row, gone): the places of lines whose key another document owns."""
    kept = owners.select(*HASHES, F.col("owner").alias("doc_id"))
    return lines.join(kept, [*HASHES, "doc_id"], "left_anti").groupBy("doc_id", "row").agg(F.collect_list("place").alias("gone"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped): every text without the lines at the places in `gone`."""
    texts = text_rows(docs).withColumn("row", F.xxhash64("text"))
    both = texts.join(gone.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "gone"), (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("of")), "left")
    left = lambda v: F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col("gone"))  # noqa: E731  by a hash set: time in proportion
    rebuilt = let(F.split("text", "\n", -1), lambda v: let(left(v), lambda at: F.struct(F.array_join(F.transform(at, lambda i: v[i]), "\n").alias("kept"), F.size(at).alias("n"))))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = both.select("doc_id", n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), F.struct(F.col("text").alias("kept"), n_lines.cast("int").alias("n"))).otherwise(rebuilt).alias("x"))
    return out.select("doc_id", F.col("x.kept").alias("kept"), "n_lines", (F.col("n_lines") - F.col("x.n")).alias("n_dropped"))


def dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped): lines whose key stands in several documents stay only in the smallest doc_id."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "line-dedup")
    path = f"{folder}/lines.parquet"
    lines = batched(line_rows(docs, least), docs, batches)
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, f"{folder}/runs", fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select(*HASHES, "doc_id"))
    return without(docs, saved(dropped_places(lines, runs.owners()), "gone", folder))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document without the lines that a smaller doc_id holds, as digests."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
owned AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= {LEAST} GROUP BY key),
marked AS (SELECT k.doc_id, place, line, coalesce(owner <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN owned USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
