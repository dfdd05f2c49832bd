"""Assay targets: peptides that are unique to one species, by charge, with their retention scores."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massgrid.functions.chemistry import HEAVIEST, dalton_to_mz, float_mass, mass_of
from massgrid.functions.hydrophobicity import hydrophobicity
from massgrid.functions.proforma import expand
from massgrid.operators import layout
from massgrid.operators.search import in_one_taxon, of_taxa
from massgrid.plans.ptm import Ptm, PtmSet, conditions, mass_bounds


def charges(spec: str) -> list[int]:
    """"2", "2,3" or "2-4": sorted and distinct, each within 0 and 255."""
    spec = spec.strip()
    if not spec:
        raise ValueError("charges must not be empty")
    try:
        if "-" in spec:
            low, high = (int(x) for x in spec.split("-", 1))
            found = range(low, high + 1)
            if low > high:
                raise ValueError(f"{low} is above {high}")
        else:
            found = [int(x) for x in spec.split(",")]
    except ValueError as e:
        raise ValueError(f"invalid charges {spec!r}: {e}") from None
    if any(not 0 <= x <= 255 for x in found):
        raise ValueError(f"invalid charges {spec!r}")
    return sorted(set(found))


def label(accession: str = "accession", genes: str = "genes"):
    """accession (gene, gene), or the accession alone."""
    return F.when(F.size(genes) > 0, F.concat(F.col(accession), F.lit(" ("), F.array_join(genes, ", "), F.lit(")"))).otherwise(F.col(accession))


def can_change(ptms: list[Ptm]) -> Column:
    """Whether a sequence has a residue that a modification is for; one of a bond is for all."""
    roles = PtmSet(ptms)
    residues = {p.residue for p in [*roles.static, *roles.variable, *roles.n_terminal, *roles.c_terminal]}
    return F.lit(True) if roles.n_bond or roles.c_bond else reduce(lambda a, b: a | b, (F.contains("sequence", F.lit(r)) for r in sorted(residues)), F.lit(False))


def forms_of(ptms: list[Ptm], most_variable: int):
    """pandas UDF: (proforma, mass) of a sequence, modified in every allowed way, and plain; null for null.

    Which conditions a sequence meets depends on its ends, if modifications are for some, and on how many modified residues
    it has, up to what a condition can ask for; they are enumerated once for each such key, not for each sequence.
    """
    roles = PtmSet(ptms)
    fixed = sorted(p.residue for p in roles.static)
    free = sorted({p.residue for p in [*roles.variable, *roles.n_terminal, *roles.c_terminal]})
    first, last = ({p.residue for p in end} for end in (roles.n_terminal, roles.c_terminal))

    top = HEAVIEST + sum(abs(p.delta) for p in ptms) * 50
    known: dict[tuple, list] = {}

    def one(sequence: str | None) -> list[dict] | None:
        if sequence is None:
            return None
        out = {sequence: mass_of(sequence)}
        if roles:
            key = tuple(sequence.count(r) for r in fixed), tuple(min(sequence.count(r), most_variable + 2) for r in free), sequence[0] in first and sequence[0], sequence[-1] in last and sequence[-1]
            if key not in known:  # a condition without modifications has the plain form alone
                known[key] = [c for c in conditions(roles, top, *mass_bounds(top, roles, 1), most_variable) if c.matches(sequence) and any((c.static, c.variable, c.n_terminal, c.c_terminal, c.n_bond, c.c_bond))]
            for c in known[key]:
                out.update(expand(sequence, c))
        return [{"proforma": text, "mass": m} for text, m in sorted(out.items())]

    def run(sequences: pd.Series) -> pd.Series:
        return sequences.map(one)

    return F.pandas_udf(run, "array<struct<proforma:string,mass:long>>")


def targets(peptides: DataFrame, proteins: DataFrame, species: list[int] | DataFrame, spec: str = "2-3", ptms: list[Ptm] | None = None, most_variable: int = 2) -> DataFrame:
    """(protein, sequence, proforma, charge, mz, hydrophobicity) for each protein, peptide, peptidoform and charge."""
    bitmap = layout.bitmap_of(species) if isinstance(species, DataFrame) else None
    if bitmap is not None:
        own = layout.of_bitmap(peptides, bitmap, unique=True)
    else:
        own = of_taxa(peptides, species, unique=True) if isinstance(species, DataFrame) else peptides.where(in_one_taxon(species))
    # forms are made once for a peptide that can have some, before it is repeated for its proteins
    plain = F.array(F.struct(F.col("sequence").alias("proforma"), F.col("mass").alias("mass")))
    forms = F.coalesce(forms_of(ptms, most_variable)(F.when(can_change(ptms), F.col("sequence"))), plain) if ptms else plain
    made = own.select("sequence", "protein_ids", F.explode(forms).alias("form")).select("sequence", "form.proforma", "form.mass", F.explode("protein_ids").alias("id"))
    rows = made.join(proteins.select("id", label().alias("protein")), "id").withColumn("charge", F.explode(F.array(*(F.lit(c) for c in charges(spec)))))
    return rows.select("protein", "sequence", "proforma", "charge", dalton_to_mz(float_mass(F.col("mass")), F.col("charge")).alias("mz"), hydrophobicity("sequence").alias("hydrophobicity"))
