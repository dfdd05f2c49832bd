"""Masses: integers of a billionth of a Dalton, so sums are exact. Everything is a Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 1_000_000_000
PROTON = 1.007276466621
#: Two hydrogens and an oxygen.
WATER = 18_010_564_700

# Monoisotopic residue masses in Dalton.
_RESIDUES = """
A 71.037113805 Alanine
C 103.009184505 Cysteine
D 115.026943065 Aspartic acid
E 129.042593135 Glutamic acid
F 147.068413945 Phenylalanine
G 57.021463735 Glycine
H 137.058911875 Histidine
I 113.084064015 Isoleucine
K 128.094963050 Lysine
L 113.084064015 Leucine
M 131.040484645 Methionine
N 114.042927470 Asparagine
O 237.147726925 Pyrrolysine
P 97.052763875 Proline
Q 128.058577540 Glutamine
R 156.101111050 Arginine
S 87.032028435 Serine
T 101.047678505 Threonine
U 150.953633405 Selenocysteine
V 99.068413945 Valine
W 186.079312980 Tryptophan
X 0.0 Unknown
Y 163.063328575 Tyrosine
"""


def to_int(dalton: float) -> int:
    """Scaled mass, truncated toward zero."""
    return int(dalton * SCALE)


def to_float(mass: int) -> float:
    return mass / SCALE


RESIDUE_NAMES = {line.split()[0]: line.split(maxsplit=2)[2] for line in _RESIDUES.split("\n") if line}
MASS = {line.split()[0]: to_int(float(line.split()[1])) for line in _RESIDUES.split("\n") if line}
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
#: Integer mean over the canonical residues.
AVERAGE = sum(MASS[c] for c in CANONICAL) // len(CANONICAL)


def code_number(letter: str) -> int:
    """Place of a residue in count vectors; upper and lower case are the same."""
    n = ord(letter.upper()) - ord("A")
    if letter.upper() not in MASS:
        raise ValueError(f"no residue {letter!r}")
    return n


def code_letter(number: int) -> str:
    return chr(number + ord("A"))


def int_mass(dalton: Column) -> Column:
    return (dalton * F.lit(float(SCALE))).cast("long")


def float_mass(mass: Column) -> Column:
    return mass / F.lit(float(SCALE))


def count_of(sequence: Column, letter: str) -> Column:
    return (F.length(sequence) - F.length(F.replace(sequence, F.lit(letter)))).cast("long")


def peptide_mass(sequence: Column) -> Column:
    """Water and all residues: exact integers, one generated expression."""
    return reduce(lambda a, c: a + count_of(sequence, c) * F.lit(MASS[c]), (c for c in MASS if MASS[c]), F.lit(WATER))


def mass_of(sequence: str) -> int:
    """The same on the driver."""
    return WATER + sum(MASS[c] for c in sequence)


def windows_of(*sequences: str) -> list[tuple[int, int]]:
    """The windows that hold just the masses of some peptides."""
    return [(m, m) for m in map(mass_of, sequences)]


def mz_to_dalton(mz: Column, charge: Column) -> Column:
    return mz * charge - charge * F.lit(PROTON)


def dalton_to_mz(dalton: Column, charge: Column) -> Column:
    return (dalton + charge * F.lit(PROTON)) / charge


def ppm_window(mass: Column, lower: int, upper: int) -> tuple[Column, Column]:
    """Integer division comes first, as in the definition of the window."""
    million = F.floor(mass / F.lit(1_000_000)).cast("long")
    return mass - million * lower, mass + million * upper


def ppm_bounds(mass: int, lower: int, upper: int) -> tuple[int, int]:
    return mass - mass // 1_000_000 * lower, mass + mass // 1_000_000 * upper


def residue_counts(sequence: Column) -> Column:
    """26 counts by letter."""
    return F.array(*(count_of(sequence, code_letter(i)).cast("byte") for i in range(26)))


def amino_acids(spark: SparkSession) -> DataFrame:
    """(code, mono_mass, is_canonical, name), a fixed table."""
    return spark.createDataFrame([(c, MASS[c], c in CANONICAL, RESIDUE_NAMES[c]) for c in sorted(MASS)], "code string, mono_mass long, is_canonical boolean, name string")


#: No peptide of 50 residues is heavier.
HEAVIEST = WATER + 50 * MASS["W"]


def rounded(mass: Column) -> Column:
    """Dalton to four places, as shown to readers."""
    return F.round(float_mass(mass), 4)


def row_bytes(sequence: str = "sequence", ids: str = "protein_ids", unique: str = "unique_taxonomy_ids", other: str = "non_unique_taxonomy_ids") -> Column:
    """Estimated bytes of a peptide row: partition and mass, packed sequence, 26 counts, ids and taxa, flags."""
    packed = F.ceil((F.length(sequence) * 5 + 6) / 8)
    return (F.lit(16) + packed + 26 + 4 * (F.size(ids) + F.size(unique) + F.size(other)) + 1).cast("long")


def mass_unit(name: str) -> str:
    """Thompson (m/z) or Dalton, by any of their usual names."""
    known = {"th": "Thompson", "thompson": "Thompson", "m/z": "Thompson", "da": "Dalton", "dalton": "Dalton"}
    try:
        return known[name.strip().lower()]
    except KeyError:
        raise ValueError(f"no unit of mass: {name!r}") from None


def summary(rows: DataFrame, value: Column) -> DataFrame:
    """(n, mean, deviation, least, most) of a value; the deviation is that of the whole population."""
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))
