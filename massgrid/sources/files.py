"""Other sources and all sinks: modification and mass lists, taxonomy dumps, configuration, FASTA, TSV, JSON."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massgrid.functions.chemistry import PROTON, float_mass, to_int
from massgrid.operators.digest import Protease
from massgrid.plans.ptm import Ptm
from massgrid.shared import written

CONFIG_VERSION = 2
#: Fixed value: the first field of FASTA headers.
FASTA_NAME = "mdb"


def read_ptms(spark: SparkSession, path: str) -> list[Ptm]:
    """A short tab-separated list with a header: name, amino_acid, mass_delta, mod_type, position."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="name string, amino_acid string, mass_delta double, mod_type string, position string").collect()
    return [Ptm.of(r.name, r.amino_acid, r.mass_delta, r.mod_type, r.position) for r in rows]


def read_masses(spark: SparkSession, path: str) -> DataFrame:
    """(mass): one on a line, in Dalton or as m/z and charge."""
    parts = F.split(F.trim("value"), r"\s+")
    dalton = F.when(F.size(parts) > 1, F.get(parts, 0).cast("double") * F.get(parts, 1).cast("double") - F.get(parts, 1).cast("double") * F.lit(PROTON)).otherwise(F.get(parts, 0).cast("double"))
    return spark.read.text(path).where(F.trim("value") != "").select((dalton * F.lit(1e9)).cast("long").alias("mass"))


def mass_from(value: float | tuple[float, int]) -> int:
    """A query mass: Dalton, or (m/z, charge)."""
    if isinstance(value, tuple | list):
        mz, charge = value
        return to_int(mz * charge - charge * PROTON)
    return to_int(value)


def _dump(spark: SparkSession, path: str) -> Column | DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(taxa, ranks) of a dump's node and name files; only scientific names are kept."""
    n = _dump(spark, nodes).select(F.get("f", 0).cast("int").alias("id"), F.get("f", 1).cast("int").alias("parent_id"), F.get("f", 2).alias("rank"))
    titles = _dump(spark, names).where(F.get("f", 3) == "scientific name").select(F.get("f", 0).cast("int").alias("id"), F.get("f", 1).alias("scientific_name"))
    listed = [r.rank for r in n.select("rank").distinct().orderBy("rank").collect()]  # a few dozen
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate(listed, 1)], "id short, name string")
    taxa = n.join(titles, "id", "left").join(F.broadcast(ranks.select(F.col("id").alias("rank_id"), F.col("name").alias("rank"))), "rank")
    return taxa.select("id", "parent_id", "scientific_name", "rank_id"), ranks


def orphans(taxa: DataFrame) -> DataFrame:
    """Taxa whose parent is missing; a sound table has none."""
    return taxa.join(taxa.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")


def config_text(protease: Protease, ranges: list[tuple[int, int, int]] = (), comment: str = "") -> str:
    return json.dumps({"version": CONFIG_VERSION, "comment": comment, "protease": asdict(protease), "partitions": [list(r) for r in ranges]}, indent=2)


def read_config(text: str) -> dict:
    """Configuration of a build; older versions only had a list of ranges."""
    found = json.loads(text)
    if found.get("version") != CONFIG_VERSION:
        raise ValueError(f"configuration version {found.get('version')!r}, not {CONFIG_VERSION}")
    return found | {"protease": Protease(**found["protease"]), "partitions": [tuple(r) for r in found["partitions"]]}


def numbered(rows: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """Adds n: consecutive numbers in the order. The sorted rows are written once and numbered as they stand there, so a
    lost executor changes no number.
    """
    tagged = rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_at"))
    tagged = written(tagged, "sorted")
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_rows"))
    ahead = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows") + start).alias("_before"))  # a row for each task of the sort
    return tagged.join(F.broadcast(ahead), "_part").withColumn("n", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def fasta(forms: DataFrame, with_mass: bool = True, sequence: str = "proforma", mass: str = "form_mass") -> DataFrame:
    """(value) one text row, header and sequence, for each form; the number in the header follows mass and sequence."""
    rows = numbered(forms, mass, sequence)
    head = [F.lit(">" + FASTA_NAME), F.col("n").cast("string"), *([plain_number(float_mass(F.col(mass)))] if with_mass else [])]
    return rows.select(F.concat(F.concat_ws("|", *head), F.lit("\n"), F.col(sequence)).alias("value"), "n").orderBy("n").select("value")


def plain_number(x: Column) -> Column:
    """Decimal without an exponent or trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(x, 9), ",", ""), r"\.?0+$", "")


def peptides_tsv(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """Columns of the peptide export, lists joined by commas; protein ids become accessions.

    Peptides that bear `accessions` (see build.aggregate) are not shuffled; others are joined with their proteins.
    """
    names = None if "accessions" in peptides.columns else peptides.select("mass", "sequence", F.explode("protein_ids").alias("id")).join(proteins.select("id", "accession"), "id").groupBy("mass", "sequence").agg(F.array_join(F.sort_array(F.collect_list("accession")), ",").alias("proteins"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    named = peptides.withColumn("proteins", F.array_join("accessions", ",")) if names is None else peptides.join(names, ["mass", "sequence"])
    return named.select(plain_number(float_mass(F.col("mass"))).alias("mass"), "sequence", "proteins", "is_swiss_prot", "is_trembl", joined("unique_taxonomy_ids"), joined("non_unique_taxonomy_ids"))


# Columns of the two instrument layouts.
LAYOUTS = {
    "thermo": ["Compound", "Mass [m/z]", "Formula [M]", "Species", "CS [z]", "Start [min]", "End [min]", "NCE", "Accession"],
    "bruker": ["Mass [m/z]", "Charge", "Isolation Width [m/z]", "RT [s]", "RT Range [s]", "Start IM [1/K0]", "End IM [1/K0]", "CE [eV]", "External ID", "Description", "Accession"],
}


def targets_tsv(targets: DataFrame, layout: str, species: str, energy: float) -> DataFrame:
    """Targets in an instrument's layout; columns that it leaves to the user are empty."""
    known = {"Compound": "proforma", "External ID": "proforma", "Mass [m/z]": "mz", "CS [z]": "charge", "Charge": "charge", "Accession": "protein"}
    fixed = {"Species": species, "Description": f"Species: {species}", "NCE": str(energy), "CE [eV]": str(energy)}
    return targets.select(*((F.col(known[c]).cast("string") if c in known else F.lit(fixed.get(c, ""))).alias(c) for c in LAYOUTS[layout]))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


def text_lines(forms: DataFrame, sequence: str = "proforma", mass: str = "form_mass") -> DataFrame:
    """Plain text: an empty line, then one form on a line, by mass."""
    first = forms.sparkSession.range(1).select(F.lit("").alias("value"), F.lit(-1).cast("long").alias("m"))
    return first.union(forms.select(sequence, mass)).orderBy("m", "value").select("value")


def mobility_request(sequences: list[str], charges: list[int], name: str = "0") -> dict:
    """Body of an inference request for ion mobilities: two columns of equal length."""
    if len(sequences) != len(charges):
        raise ValueError("as many charges as sequences are needed")
    column = lambda n, kind, data: {"name": n, "shape": [len(data), 1], "datatype": kind, "data": data}
    return {"id": name, "inputs": [column("peptide_sequences", "BYTES", sequences), column("precursor_charges", "INT32", charges)]}


def mobility_response(body: dict) -> list[float]:
    """The values of the only output of an inference response."""
    return [float(x) for x in body["outputs"][0]["data"]]
