"""Peptidoforms: where a condition's modifications can stand on a sequence, and how they are written."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from massgrid.functions.chemistry import SCALE, mass_of
from massgrid.plans.ptm import Condition

Form = tuple[str, int]  # ProForma text, mass


def delta_text(delta: int) -> str:
    """A signed delta in Dalton without trailing zeros or an exponent."""
    whole, part = divmod(abs(delta), SCALE)
    return ("-" if delta < 0 else "+") + f"{whole}.{part:09d}".rstrip("0").rstrip(".")


def render(sequence: str, mods: dict[int, int], n_bond: int | None = None, c_bond: int | None = None, everywhere: tuple[tuple[str, int], ...] = ()) -> str:
    head = "<" + ",".join(f"[{delta_text(d)}]@{r}" for r, d in everywhere) + ">" if everywhere else ""
    body = "".join(c + (f"[{delta_text(mods[i])}]" if i in mods else "") for i, c in enumerate(sequence))
    return head + (f"[{delta_text(n_bond)}]-" if n_bond is not None else "") + body + (f"-[{delta_text(c_bond)}]" if c_bond is not None else "")


def expand(sequence: str, c: Condition) -> Iterator[Form]:
    """Every placement of the condition's modifications on a sequence that matches it.

    Each residue gets exactly as many variable modifications as the condition has for it; residues with a static
    one get no other, and a modification of an end takes that residue's place.
    """
    fixed = {p.residue: p.delta for p in c.static}
    taken: dict[int, int] = {}
    if c.n_terminal and sequence[0] not in fixed:
        taken[0] = c.n_terminal.delta
    if c.c_terminal and sequence[-1] not in fixed and len(sequence) - 1 not in taken:
        taken[len(sequence) - 1] = c.c_terminal.delta
    wanted = Counter((p.residue, p.delta) for p in c.variable)
    total = Counter(p.residue for p in c.variable)
    base = mass_of(sequence) + sum(fixed.get(r, 0) for r in sequence) + sum(taken.values()) + sum(p.delta for p in (c.n_bond, c.c_bond) if p)
    free = [i for i, r in enumerate(sequence) if r in total and r not in fixed and i not in taken]
    room = Counter(sequence[i] for i in free)
    everywhere = tuple(sorted({(p.residue, p.delta) for p in c.static}))

    def place(k: int, left: Counter, open_: Counter, mods: dict[int, int]) -> Iterator[dict[int, int]]:
        if not any(left.values()):
            yield dict(mods)
            return
        if k == len(free):
            return
        i, r = free[k], sequence[free[k]]
        open_[r] -= 1
        if sum(n for (x, _), n in left.items() if x == r) <= open_[r]:  # enough places behind this one
            yield from place(k + 1, left, open_, mods)
        for (x, delta), n in list(left.items()):
            if x == r and n:
                left[x, delta] -= 1
                mods[i] = delta
                yield from place(k + 1, left, open_, mods)
                del mods[i]
                left[x, delta] += 1
        open_[r] += 1

    if any(total[r] > room[r] for r in total):
        return
    mass = base + sum(p.delta for p in c.variable)
    for mods in place(0, wanted, room, {}):
        yield render(sequence, taken | mods, c.n_bond and c.n_bond.delta, c.c_bond and c.c_bond.delta, everywhere), mass
