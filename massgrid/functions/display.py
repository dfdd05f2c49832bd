"""Text for readers, and the search payload of a URL."""

from __future__ import annotations

import base64
import json
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from massgrid.functions.chemistry import rounded


def peptide_text() -> Column:
    """Sequence, mass and owners of a row of the peptide table."""
    lists = [F.concat(F.lit(f"{label}: "), F.array_join(F.col(c).cast("array<string>"), ", ")) for label, c in (("proteins", "protein_ids"), ("unique taxa", "unique_taxonomy_ids"), ("other taxa", "non_unique_taxonomy_ids"))]
    return F.concat_ws("\n", F.col("sequence"), F.concat(F.lit("mass: "), rounded(F.col("mass")).cast("string")), *lists, F.concat(F.lit("SwissProt: "), F.col("is_swiss_prot").cast("string")), F.concat(F.lit("TrEMBL: "), F.col("is_trembl").cast("string")))


def protein_text(width: int = 60) -> Column:
    """Accession, taxon, genes, and the sequence in lines."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat_ws("\n", F.col("accession"), F.concat(F.lit("taxon: "), F.col("taxonomy_id").cast("string")), F.concat(F.lit("genes: "), F.array_join("genes", ", ")), F.when(F.col("is_reviewed"), "reviewed").otherwise("not reviewed"), lines)


def taxon_text() -> Column:
    """Name, rank and ids of a ranked taxon."""
    return F.format_string("%s (%s), id %d, parent %d", "scientific_name", "rank", "id", "parent_id")


def search_payload(text: str) -> dict:
    """The JSON of a search, base64-encoded in a URL; the URL-safe alphabet and missing padding are fine."""
    plain = unquote(text).replace("-", "+").replace("_", "/")
    return json.loads(base64.b64decode(plain + "=" * (-len(plain) % 4)))
