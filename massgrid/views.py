"""The engine's tables, derived from the driver's tables by expressions that DuckDB has, too.

Proteins are whole documents: their ASCII letters in upper case, but O and U, of which prose is full and which stand for
rare residues. So B, J, X and Z remain, and peptides that hold one are dropped by a digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from massgrid.functions.chemistry import CANONICAL, MASS, WATER
from massgrid.operators.digest import Protease


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out if a table has fewer splits than there are cores, as one small file does; else leaves them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < cores else rows


#: The residue of each byte of a text, 0 for those that are left out, as all bytes of other than ASCII characters are.
RESIDUE = np.zeros(256, np.uint8)
for _c in set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") - set("OU"):
    RESIDUE[[ord(_c), ord(_c.lower())]] = ord(_c)


@F.arrow_udf(StringType())
def residues(text: pa.Array) -> pa.Array:
    """Letters of a text's bytes in upper case, without O and U; none for null. A batch is one array of bytes."""
    text = text.fill_null(b"")
    ends = np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_binary(text.type) else np.int64)[text.offset : text.offset + len(text) + 1]
    data = RESIDUE[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]] if len(text) else np.zeros(0, np.uint8)
    made = np.zeros(len(text) + 1, np.int64)
    if len(text):  # counted by text, so that no number for each byte is held
        made[1:] = [np.count_nonzero(data[a:b]) for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(made.cumsum()), pa.py_buffer(data[data != 0])).cast(pa.string())


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("accession"),
        residues(F.col("text").cast("binary")).alias("sequence"),
        (F.lit(1000) + F.col("doc_id") % 25).cast("int").alias("taxonomy_id"),
        (F.col("doc_id") % 3 == 0).alias("is_reviewed"),
        F.array("source", "lang").alias("genes"),
    )


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root that is its own parent, regions as genera, nations as species."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    root = spark.range(1).select(F.lit(1).alias("id"), F.lit(1).alias("parent_id"), F.lit("root").alias("scientific_name"), F.lit(1).alias("rank_id"))
    genera = region.select((F.col("r_regionkey") + 100).cast("int"), F.lit(1), "r_name", F.lit(2))
    species = nation.select((F.col("n_nationkey") + 1000).cast("int"), (F.col("n_regionkey") + 100).cast("int"), "n_name", F.lit(3))
    return root.union(genera).union(species)


def ranks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "no rank"), (2, "genus"), (3, "species")], "id int, name string")


# --- the same in DuckDB's SQL -------------------------------------------------------------------------------------

PROTEINS_SQL = """proteins as (
  select doc_id as id, 'D' || doc_id as accession,
    regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[OU]', '', 'g') as sequence,
    cast(1000 + doc_id % 25 as int) as taxonomy_id, doc_id % 3 = 0 as is_reviewed, [source, lang] as genes from documents)"""

TAXA_SQL = """taxa as (
  select 1 as id, 1 as parent_id, 'root' as scientific_name, 1 as rank_id union all
  select r_regionkey + 100, 1, r_name, 2 from region union all
  select n_nationkey + 1000, n_regionkey + 100, n_name, 3 from nation),
ranks as (select * from (values (1, 'no rank'), (2, 'genus'), (3, 'species')) as t(id, name))"""


def mass_sql(sequence: str = "sequence") -> str:
    return " + ".join([str(WATER), *(f"(length({sequence}) - length(replace({sequence}, '{c}', ''))) * {MASS[c]}" for c in CANONICAL)])


FRAGMENTS_SQL = """residues as (
  select id, n, p, sequence[p] as c, sequence[p + 1] as following from (
    select id, sequence, length(sequence) as n, unnest(range(1, length(sequence) + 1)) as p from proteins)),
cuts as (
  select id, p, row_number() over (partition by id order by p) as k, coalesce(lag(p) over (partition by id order by p), 0) as a
  from residues where p = n or (c in ('K', 'R') and following <> 'P'))"""


def digest_sql(protease: Protease) -> str:
    """CTEs up to digest (protein_id, sequence, mass, taxonomy_id, is_reviewed, genes, accession), by cut places."""
    low, high = protease.shortest, protease.longest
    pairs = f"""pairs as (
  select x.id, x.a, y.p - x.a as size from cuts x, (select unnest(range(0, {protease.most_missed + 1})) as j) s
  join cuts y on y.id = x.id and y.k = x.k + s.j)"""
    if protease.rule == "unspecific":
        # stretches from each place up to the first unknown residue, and what they begin with
        stretches = f"stretches as (select id, regexp_extract(substr(sequence, s, {high}), '^[{CANONICAL}]*') as stretch from (select id, sequence, unnest(range(1, length(sequence) - {low} + 2)) as s from proteins))"
        ctes = [stretches, f"pieces as (select distinct id, left(stretch, w) as peptide from (select id, stretch, unnest(range({low}, length(stretch) + 1)) as w from stretches where length(stretch) >= {low}))"]
    elif protease.semi:
        ends = f"""ends as (
  select id, a, w from (select id, a, size, unnest(range({low}, least({high}, size) + 1)) as w from pairs where size >= {low}) union
  select id, a + size - w, w from (select id, a, size, unnest(range({low}, least({high}, size) + 1)) as w from pairs where size >= {low}))"""
        ctes = [FRAGMENTS_SQL, pairs, ends, "pieces as (select distinct e.id, substr(sequence, a + 1, w) as peptide from ends e join proteins using (id))"]
    else:
        ctes = [FRAGMENTS_SQL, pairs, f"pieces as (select distinct e.id, substr(sequence, a + 1, size) as peptide from pairs e join proteins using (id) where size between {low} and {high})"]
    if protease.rule == "unspecific":  # very many, so without what their proteins have besides
        return "with recursive " + ",\n".join([PROTEINS_SQL, *ctes, f"digest as (select id as protein_id, peptide as sequence, {mass_sql('peptide')} as mass from pieces)"])
    last = f"""digest as (
  select p.id as protein_id, peptide as sequence, {mass_sql("peptide")} as mass, taxonomy_id, is_reviewed, genes, accession from pieces join proteins p using (id) where not regexp_matches(peptide, '[^{CANONICAL}]'))"""
    return "with recursive " + ",\n".join([PROTEINS_SQL, *ctes, last])


PEPTIDES_SQL = """by_taxon as (
  select mass, sequence, taxonomy_id, count(distinct protein_id) as n, bool_or(is_reviewed) as r, bool_or(not is_reviewed) as o from digest group by all),
ids as (select mass, sequence, list_sort(list(distinct protein_id)) as protein_ids from digest group by all),
peptides as (
  select t.mass, t.sequence, any_value(protein_ids) as protein_ids, coalesce(list_sort(list(taxonomy_id) filter (n = 1)), []) as unique_taxonomy_ids,
    coalesce(list_sort(list(taxonomy_id) filter (n > 1)), []) as non_unique_taxonomy_ids, bool_or(r) as is_swiss_prot, bool_or(o) as is_trembl
  from by_taxon t join ids i on t.mass = i.mass and t.sequence = i.sequence group by t.mass, t.sequence)"""
