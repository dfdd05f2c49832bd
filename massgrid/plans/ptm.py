"""Post-translational modifications and the conditions that a mass search makes of them.

The planner runs on the driver: its output is small data, one row for each hypothesis, which the search joins with
the peptides. One mass and ten thousand take the same path.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from math import floor

from pyspark.sql import DataFrame, SparkSession

from massgrid.functions.chemistry import AVERAGE, MASS, ppm_bounds, to_float, to_int

STATIC, VARIABLE = "Static", "Variable"
ANYWHERE, TERMINUS_N, TERMINUS_C, BOND_N, BOND_C = "Anywhere", "Terminus-N", "Terminus-C", "Bond-N", "Bond-C"
MOST_CONDITIONS = 200_000


@dataclass(frozen=True)
class Ptm:
    """One modification. Equality ignores the name."""

    name: str = field(compare=False)
    residue: str
    delta: int
    kind: str
    position: str = ANYWHERE

    @classmethod
    def of(cls, name: str, residue: str, dalton: float, kind: str, position: str = ANYWHERE) -> Ptm:
        if kind not in (STATIC, VARIABLE) or position not in (ANYWHERE, TERMINUS_N, TERMINUS_C, BOND_N, BOND_C):
            raise ValueError(f"{name}: unknown type {kind!r} or position {position!r}")
        if residue.upper() not in MASS:
            raise ValueError(f"{name}: no residue {residue!r}")
        return cls(name, residue.upper(), to_int(dalton), kind, position)

    @property
    def total_mass(self) -> int:
        return MASS[self.residue] + self.delta


class PtmSet:
    """Modifications by role; raises if two roles collide on a residue."""

    def __init__(self, ptms: Iterable[Ptm] = ()):
        ptms = list(ptms)
        free = [p for p in ptms if p.position == ANYWHERE]
        self.static, self.variable = ([p for p in free if p.kind == k] for k in (STATIC, VARIABLE))
        self.n_terminal, self.c_terminal, self.n_bond, self.c_bond = ([p for p in ptms if p.position == x] for x in (TERMINUS_N, TERMINUS_C, BOND_N, BOND_C))
        fixed = Counter(p.residue for p in self.static)
        for p in self.static:
            if fixed[p.residue] > 1:
                raise ValueError(f"{p.name}: {p.residue} has two static modifications")
        for p in [*self.variable, *self.n_terminal, *self.c_terminal]:
            if p.residue in fixed:
                raise ValueError(f"{p.name}: {p.residue} has a static modification")

    def __bool__(self) -> bool:
        return any((self.static, self.variable, self.n_terminal, self.c_terminal, self.n_bond, self.c_bond))


@dataclass(frozen=True)
class Condition:
    """One hypothesis: which modifications a peptide bears, and what is then left of the mass."""

    mass: int
    static: tuple[Ptm, ...] = ()
    variable: tuple[Ptm, ...] = ()
    n_terminal: Ptm | None = None
    c_terminal: Ptm | None = None
    n_bond: Ptm | None = None
    c_bond: Ptm | None = None
    excluded: frozenset[str] = frozenset()

    def without(self, ptm: Ptm, **roles) -> Condition | None:
        """With one more modification; None if it is heavier than what is left."""
        return None if ptm.delta > self.mass else replace(self, mass=self.mass - ptm.delta, **roles)

    def exact(self) -> dict[str, int]:
        """Residues whose number is fixed."""
        return {**dict.fromkeys(sorted(self.excluded), 0), **dict(sorted(Counter(p.residue for p in self.static).items()))}

    def least(self) -> dict[str, int]:
        """Residues of which there must be enough: variable modifications and those at the ends together."""
        ends = [p for p in (self.n_terminal, self.c_terminal) if p]
        return dict(sorted(Counter(p.residue for p in [*self.variable, *ends]).items()))

    def choices(self) -> list[tuple[str, int, int]]:
        """(residue, n, before): n equal modifications choose among a residue's places, of which `before` are taken."""
        out, before = [], Counter()
        for (residue, _), n in sorted(Counter((p.residue, p.delta) for p in self.variable).items()):
            out.append((residue, n, before[residue]))
            before[residue] += n
        return out

    def signature(self) -> str:
        """The condition as text, in the order in which it is tested."""
        parts = [f"occurrences of '{r}' == {n}" for r, n in self.exact().items()]
        parts += [f"starts with '{self.n_terminal.residue}'"] if self.n_terminal else []
        parts += [f"ends with '{self.c_terminal.residue}'"] if self.c_terminal else []
        return ", ".join([*parts, *(f"occurrences of '{r}' >= {n}" for r, n in self.least().items())])

    def composition(self) -> tuple:
        """What two conditions must share to be the same; the mass and signature alone would mix up roles."""
        key = lambda ps: tuple(sorted((p.residue, p.delta) for p in ps))
        return self.mass, key(self.static), key(self.variable), *(p and (p.residue, p.delta) for p in (self.n_terminal, self.c_terminal)), *(p and p.delta for p in (self.n_bond, self.c_bond)), self.excluded

    def matches(self, sequence: str) -> bool:
        """All tests but the mass."""
        return (
            all(sequence.count(r) == n for r, n in self.exact().items())
            and all(sequence.count(r) >= n for r, n in self.least().items())
            and (not self.n_terminal or sequence.startswith(self.n_terminal.residue))
            and (not self.c_terminal or sequence.endswith(self.c_terminal.residue))
        )


def mass_bounds(mass: int, ptms: PtmSet, shortest: int = 6) -> tuple[int, int]:
    """Masses that a reduced condition may have: negative deltas can lift it above the query."""
    worst = sum(max((-p.delta for p in group if p.delta < 0), default=0) for group in (ptms.static, ptms.variable))
    return shortest * MASS["G"], mass + worst * floor(1.3 * (mass // AVERAGE))


def conditions(ptms: PtmSet, mass: int, low: int, high: int, most_variable: int = 2, first_only: bool = False) -> list[Condition]:
    """All conditions of one mass. Residues of static modifications that a condition does not use are excluded.

    first_only: of each list of modifications at the ends or bonds only the first applicable one is used.
    """
    fixed = frozenset(p.residue for p in ptms.static)
    if not ptms:
        return [Condition(mass)]

    def static(made: list[Condition], start: Condition, k: int) -> None:
        if k == len(ptms.static):
            made.append(start)
            return
        static(made, start, k + 1)
        step = start
        while (step := step.without(ptms.static[k], static=(*step.static, ptms.static[k]), excluded=step.excluded - {ptms.static[k].residue})) and low <= step.mass <= high:
            static(made, step, k + 1)

    def variable(made: list[Condition], start: Condition, k: int) -> None:
        if k == len(ptms.variable):
            made.append(start)
            return
        variable(made, start, k + 1)
        step = start
        while (step := step.without(ptms.variable[k], variable=(*step.variable, ptms.variable[k]))) and len(step.variable) <= most_variable and low <= step.mass <= high:
            variable(made, step, k + 1)

    base: list[Condition] = []
    static(base, Condition(mass, excluded=fixed), 0)
    out: list[Condition] = []
    for c in base:
        variable(out, c, 0)
    for role in ("n_terminal", "c_terminal", "n_bond", "c_bond"):
        for c in list(out):
            for ptm in getattr(ptms, role):
                if more := c.without(ptm, **{role: ptm}):
                    out.append(more)
                    if first_only:
                        break
        if len(out) > MOST_CONDITIONS:
            raise ValueError(f"more than {MOST_CONDITIONS} conditions: allow fewer modifications")
    return list({c.composition(): c for c in out}.values())


def merged_windows(windows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(signature, low, high, members) after joining windows of one signature that overlap or touch."""
    out: list[list] = []
    for sign, low, high in sorted(windows):
        if out and out[-1][0] == sign and low <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], high), out[-1][3] + 1
        else:
            out.append([sign, low, high, 1])
    return [tuple(x) for x in out]


@dataclass
class Plan:
    """The conditions of a search by number, with their windows."""

    query_mass: list[int]
    conditions: list[Condition]
    ppm: tuple[int, int] = (10, 10)

    @classmethod
    def of(cls, masses: Iterable[int], ptms: Iterable[Ptm] = (), ppm: tuple[int, int] = (10, 10), most_variable: int = 2, shortest: int = 6, first_only: bool = False) -> Plan:
        roles, query, found = PtmSet(ptms), [], []
        for mass in masses:
            for c in conditions(roles, mass, *mass_bounds(mass, roles, shortest), most_variable, first_only):
                query.append(mass)
                found.append(c)
        return cls(query, found, ppm)

    def window(self, c: Condition) -> tuple[int, int]:
        return ppm_bounds(c.mass, *self.ppm)

    def forms_overlap(self) -> bool:
        """Whether a modification of an end is also a variable one, so that two conditions can write one peptidoform alike."""
        key = lambda ps: {(p.residue, p.delta) for p in ps if p}
        return bool(key(p for c in self.conditions for p in c.variable) & key(p for c in self.conditions for p in (c.n_terminal, c.c_terminal)))

    SCHEMA = "cond_id int, query_mass long, mass long, lo long, hi long, signature string, exact map<string,int>, least map<string,int>, starts string, ends string"

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, q, c.mass, *self.window(c), c.signature(), c.exact(), c.least(), c.n_terminal and c.n_terminal.residue, c.c_terminal and c.c_terminal.residue) for i, (q, c) in enumerate(zip(self.query_mass, self.conditions, strict=True))]
        return spark.createDataFrame(rows, self.SCHEMA)

    def sql(self, sequence: str = "sequence", mass: str = "mass") -> str:
        """The conditions as rows of (cond_id, query_mass, sequence) over a table `digest`, in plain SQL."""
        number = lambda r: f"length({sequence}) - length(replace({sequence}, '{r}', ''))"
        parts = []
        for i, (q, c) in enumerate(zip(self.query_mass, self.conditions, strict=True)):
            low, high = self.window(c)
            tests = [f"{mass} between {low} and {high}", *(f"{number(r)} = {n}" for r, n in c.exact().items()), *(f"{number(r)} >= {n}" for r, n in c.least().items())]
            tests += [f"{sequence}[1] = '{c.n_terminal.residue}'"] if c.n_terminal else []
            tests += [f"{sequence}[-1] = '{c.c_terminal.residue}'"] if c.c_terminal else []
            parts.append(f"select {i} as cond_id, cast({q} as bigint) as query_mass, * from digest where {' and '.join(tests)}")
        return " union all ".join(parts)


def describe(c: Condition) -> str:
    return f"{c.signature()} @ {to_float(c.mass):.9f}"
