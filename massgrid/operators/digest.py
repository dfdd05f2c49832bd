"""In-silico digestion: proteins to peptides, in narrow steps.

A protease is a cleavage rule and limits. Peptides go by places in the residues (see places), the full digest of a sequence
is one split; nothing is shuffled, so a digest scales with its scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massgrid.operators import places

#: Cut sites, by the name of the rule: a zero-width pattern, and a pattern that counts them.
RULES = {"trypsin": (r"(?<=[KR])(?!P)", r"[KR](?!P)"), "unspecific": (r"(?!^)", r".")}
LONGEST = 50


@dataclass(frozen=True)
class Protease:
    """Rule, peptide lengths and missed cleavages; `semi-` before a rule's name frees one end of each peptide."""

    name: str = "trypsin"
    shortest: int = 6
    longest: int = 50
    missed: int | None = None
    keep_unknown: bool = False

    def __post_init__(self):
        if self.rule not in RULES:
            raise ValueError(f"no protease {self.name!r}; known are {', '.join(RULES)}, each with semi- before it")
        if not 1 <= self.shortest <= self.longest <= LONGEST:
            raise ValueError(f"peptide lengths must be within 1 and {LONGEST}")

    @property
    def rule(self) -> str:
        return self.name.lower().removeprefix("semi-")

    @property
    def semi(self) -> bool:
        return self.name.lower().startswith("semi-")

    @property
    def most_missed(self) -> int:
        """Unlimited by default: no peptide has more sites than residues."""
        return self.longest if self.missed is None else self.missed


def fragments(sequence: Column, protease: Protease) -> Column:
    """The full digest of a sequence, in order, without empty pieces."""
    return F.filter(F.split(sequence, RULES[protease.rule][0]), lambda x: x != "")


def missed_cleavages(sequence: Column, protease: Protease) -> Column:
    """Cut sites in a peptide; one at its very end counts, too."""
    return F.regexp_count(sequence, F.lit(RULES[protease.rule][1])).cast("long")


def digest(proteins: DataFrame, protease: Protease = Protease(), masses: tuple[int, int] | list[tuple[int, int]] | None = None) -> DataFrame:
    """A row (protein_id, sequence, mass, and what the protein has besides) for each distinct peptide of each protein.

    All are narrow: each task lays out its proteins' residues and goes by places. masses: a window (low, high) or a list of
    them, both included; peptides of other masses are not made.
    """
    return places.peptides(proteins, protease, None if masses is None else merged([masses] if isinstance(masses, tuple) else masses))


def merged(windows: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows in order, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(w for w in windows if w[0] <= w[1]):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def digest_masses(proteins: DataFrame, protease: Protease = Protease(), masses: tuple[int, int] | None = None) -> DataFrame:
    """(protein_id, mass): the distinct masses of each protein's peptides; no peptide is made."""
    out = places.masses(proteins, protease)
    return out.where(F.col("mass").between(*masses)) if masses else out


def digest_summaries(proteins: DataFrame, protease: Protease = Protease()) -> DataFrame:
    """A row of numbers for each protein over its distinct peptides: see places.summaries. No peptide leaves its task."""
    return places.summaries(proteins, protease)
