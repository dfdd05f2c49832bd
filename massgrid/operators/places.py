"""Digests by places: a peptide is a start and a length, its mass one subtraction of prefix sums.

A task lays the residues of a protein out as bytes. Prefix sums of their masses give the mass of any stretch, and the next
residue without a known mass ends it, so masses need no strings at all. Where strings are wanted, each once for a
protein, its suffixes are sorted by their first residues (twelve to a 60-bit word) and the common prefix of neighbours is
read from the words: a suffix is the first with a stretch of some length if that is longer than what it
shares with its neighbour. So no peptide is compared, hashed or shuffled to find the distinct ones.

Proteins are independent: nothing is shuffled, rows leave in batches of bounded size, and a lost task repeats its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from massgrid.functions.chemistry import CANONICAL, MASS, WATER

#: Residues in a word of 60 bits, and words that hold the longest peptide.
WORD, WORDS = 12, 5
#: Rows of a batch that leaves a task.
FLUSH = 1 << 18
#: Residues that are laid out at once, for each number of fragments in a peptide.
LAID_OUT = 3 << 20
MASSES = np.zeros(256, np.int64)
for _letter, _mass in MASS.items():
    MASSES[ord(_letter)] = _mass
CUT = np.zeros(256, bool)
CUT[[ord("K"), ord("R")]] = True


class Places:
    """The residues of one protein, with prefix sums of masses and the furthest end of a peptide from each place."""

    def __init__(self, residues: np.ndarray, known: np.ndarray, longest: int):
        self.residues, self.n = residues, len(residues)
        self.codes = np.where(known[residues], residues & 31, 0)
        self.sums = np.concatenate([[0], np.cumsum(MASSES[residues])])
        bad = np.append(np.flatnonzero(~known[residues]), self.n)
        self._classes: tuple[np.ndarray, np.ndarray] | None = None
        self.reach = np.minimum(bad[np.searchsorted(bad, np.arange(self.n))] - np.arange(self.n), longest)

    def masses(self, start: np.ndarray, size: int) -> np.ndarray:
        return self.sums[start + size] - self.sums[start] + WATER

    def cuts(self, everywhere: bool) -> np.ndarray:
        """Places where a fragment begins or ends: 0, after K or R but before P, and the end."""
        if everywhere:
            return np.arange(self.n + 1)
        inside = np.flatnonzero(CUT[self.residues[:-1]] & (self.residues[1:] != ord("P"))) + 1
        return np.concatenate([[0], inside, [self.n]])

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(rank of every suffix, residues it shares with the one before it in order)."""
        if self._classes is None:
            self._classes = self._ordered()
        return self._classes

    def _ordered(self) -> tuple[np.ndarray, np.ndarray]:
        codes = np.zeros(self.n + WORD * (WORDS + 1), np.uint64)
        codes[: self.n] = self.codes
        shifted = lambda x, k, by: (x[:-by] << np.uint64(k)) | x[by:]
        four = shifted(shifted(codes, 5, 1), 10, 2)
        eight = shifted(four, 20, 4)
        twelve = (eight[: len(four) - 8] << np.uint64(20)) | four[8:]
        words = [twelve[WORD * k : WORD * k + self.n] for k in range(WORDS)]
        order = np.lexsort(words[::-1])
        rank, shared = np.empty(self.n, np.int64), np.zeros(self.n, np.int64)
        rank[order] = np.arange(self.n)
        at = np.arange(1, self.n)
        for word in words:
            differ = word[order[at]] ^ word[order[at - 1]]
            high = (differ >> np.uint64(30)).astype(np.float64)
            bits = np.where(high > 0, np.frexp(high)[1] + 30, np.frexp((differ & np.uint64((1 << 30) - 1)).astype(np.float64))[1])
            shared[at] += (5 * WORD - bits) // 5
            at = at[differ == 0]
        return rank, shared


def spans(places: Places, shortest: int, longest: int, missed: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of fragments that a digest by cut sites alone gives; a peptide may come twice."""
    begin, sizes, cuts = [], [], places.cuts(False)
    for k in range(1, min(missed + 1, len(cuts) - 1) + 1):
        begin.append(cuts[:-k])
        sizes.append(cuts[k:] - cuts[:-k])
    begin, sizes = np.concatenate(begin), np.concatenate(sizes)
    fit = (sizes >= shortest) & (sizes <= longest)
    begin, sizes = begin[fit], sizes[fit]
    fit = places.reach[begin] >= sizes
    return begin[fit], sizes[fit]


def free_spans(places: Places, shortest: int, longest: int, missed: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of all stretches with a cut at one end, by the longest ones from each cut and to each cut."""
    cuts = places.cuts(False)
    reach = np.append(places.reach, 0)
    last = np.minimum(cuts[np.minimum(np.arange(len(cuts)) + missed + 1, len(cuts) - 1)] - cuts, reach[cuts])
    first = np.minimum(cuts - cuts[np.maximum(np.arange(len(cuts)) - missed - 1, 0)], longest)
    room = np.maximum(np.concatenate([last, first]) - shortest + 1, 0)
    sizes = shortest + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    at = np.repeat(np.concatenate([cuts, cuts]), room)
    at[room[: len(cuts)].sum() :] -= sizes[room[: len(cuts)].sum() :]
    fit = reach[at] >= sizes
    return at[fit], sizes[fit]


def starts(places: Places, shortest: int, longest: int, missed: int, everywhere: bool, semi: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of all peptides of a protein, for each length; a start may come twice."""
    if everywhere:
        for size in range(shortest, longest + 1):
            yield size, np.flatnonzero(places.reach >= size)
        return
    cuts = places.cuts(False)
    if semi:  # stretches of fewer fragments lie within the longest ones from the same start or to the same end
        last = cuts[np.minimum(np.arange(len(cuts)) + missed + 1, len(cuts) - 1)] - cuts
        first = cuts - cuts[np.maximum(np.arange(len(cuts)) - missed - 1, 0)]
        for size in range(shortest, longest + 1):
            at = np.concatenate([cuts[last >= size], cuts[first >= size] - size])
            yield size, at[places.reach[at] >= size] if len(at) else at
        return
    begin, sizes = spans(places, shortest, longest, missed)
    for size in np.unique(sizes).tolist():
        yield size, begin[sizes == size]


def distinct_starts(places: Places, how: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """The same with one start for each different peptide."""
    rank, shared = places.classes()
    everywhere = how[3]
    fresh = shared[rank]
    for size, at in starts(places, *how):
        if everywhere:
            # a neighbour that shares so many residues has them all, so it reaches as far
            yield size, at[fresh[at] < size]
        elif len(at):
            label = np.cumsum(shared < size)[rank[at]]
            yield size, at[np.unique(label, return_index=True)[1]]


def windowed(masses: np.ndarray, windows: np.ndarray | None) -> np.ndarray:
    """Whether each mass lies in one of the windows (low, high), which are sorted and don't overlap; all do if there are none."""
    if windows is None:
        return np.ones(len(masses), bool)
    at = np.searchsorted(windows[:, 0], masses, side="right") - 1
    return (at >= 0) & (masses <= np.append(windows[:, 1], -1)[at])


def by_cuts(residues: np.ndarray, rows: np.ndarray, known: np.ndarray, protease, windows: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, peptide, mass) of a digest by cut sites alone, of many proteins at once: rows are where each begins, and the end.

    Only peptides within the windows are made as strings, by which those of one protein are told apart.
    """
    cut = np.zeros(len(residues) + 1, bool)
    cut[1:-1] = CUT[residues[:-1]] & (residues[1:] != ord("P"))
    cut[rows] = True
    cuts = np.flatnonzero(cut)
    row = np.searchsorted(rows, cuts, side="right") - 1
    end = np.append(rows, len(residues))[row + 1]
    sums, bad = (np.concatenate([[0], np.cumsum(x)]) for x in (MASSES[residues], ~known[residues]))
    found = []
    for k in range(1, min(protease.most_missed + 1, len(cuts) - 1) + 1):
        first, last = cuts[:-k], cuts[k:]
        fit = np.flatnonzero((last - first >= protease.shortest) & (last - first <= protease.longest) & (last <= end[:-k]) & (bad[last] == bad[first]))
        mass = sums[last[fit]] - sums[first[fit]] + WATER
        near = windowed(mass, windows)
        found.append((row[:-k][fit][near], first[fit][near], (last - first)[fit][near], mass[near]))
    of, begin, size, mass = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
    ends = np.concatenate([[0], np.cumsum(size)])
    data = residues[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
    text = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    told = pa.table([pa.array(of), text, pa.array(mass)], names=["of", "text", "mass"]).group_by(["of", "text", "mass"], use_threads=False).aggregate([]).combine_chunks()
    return told["of"].to_numpy(), pa.concat_arrays(told["text"].chunks) if len(told) else text, told["mass"].to_numpy()


def _laid_out(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, residues, rows) of runs of rows of a batch, of about `most` residues; a longer protein stands alone."""
    text = batch.column(batch.schema.names.index("sequence")).fill_null("").cast(pa.large_string())
    if not len(text):
        return
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data, i = np.frombuffer(text.buffers()[2] or b"", np.uint8), 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        if ends[j] > ends[i]:
            yield i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def _proteins(batch: pa.RecordBatch, longest: int, letters: str) -> Iterator[tuple[int, Places]]:
    known = np.zeros(256, bool)
    known[np.frombuffer(letters.encode(), np.uint8)] = True
    column = batch.column(batch.schema.names.index("sequence")).fill_null("")
    for i, text in enumerate(column):
        residues = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
        if len(residues):
            yield i, Places(residues, known, longest)


def _how(protease) -> tuple:
    return protease.shortest, protease.longest, protease.most_missed, protease.rule == "unspecific", protease.semi


def peptides(proteins: DataFrame, protease, windows: list[tuple[int, int]] | None = None) -> DataFrame:
    """(protein_id, sequence, mass, and what the protein has besides): each different peptide of each protein.

    windows: only masses within one of them; sorted, without overlaps. Peptides of other masses are never made.
    """
    near = None if windows is None else np.array(windows, np.int64).reshape(-1, 2)
    how, letters = _how(protease), CANONICAL + "X" * protease.keep_unknown
    kept = [f for f in proteins.schema.fields if f.name not in ("id", "sequence")]

    def packed(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        of = pa.array(np.repeat([i for i, _, _, _ in held], [len(at) for _, _, _, at in held]))
        size = np.repeat([s for _, _, s, _ in held], [len(at) for _, _, _, at in held])
        data = np.concatenate([p.residues[(at[:, None] + np.arange(s))].ravel() for _, p, s, at in held])
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        text = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data))
        masses = pa.array(np.concatenate([p.masses(at, s) for _, p, s, at in held]))
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([batch.column(names.index("id")).take(of), text, masses, *(batch.column(names.index(f.name)).take(of) for f in kept)], names=["protein_id", "sequence", "mass", *(f.name for f in kept)])

    def run_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(256, bool)
        known[np.frombuffer(letters.encode(), np.uint8)] = True
        for batch in batches:
            names = batch.schema.names
            for i, residues, rows in _laid_out(batch, LAID_OUT // (min(protease.most_missed, protease.longest) + 1)):
                of, text, masses = by_cuts(residues, rows, known, protease, near)
                for k in range(0, len(of), FLUSH):
                    own = pa.array(of[k : k + FLUSH] + i)
                    yield pa.RecordBatch.from_arrays([batch.column(names.index("id")).take(own), text[k : k + FLUSH], pa.array(masses[k : k + FLUSH]), *(batch.column(names.index(f.name)).take(own) for f in kept)], names=["protein_id", "sequence", "mass", *(f.name for f in kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for i, places in _proteins(batch, protease.longest, letters):
                for size, every in distinct_starts(places, how):
                    every = every[windowed(places.masses(every, size), near)] if near is not None else every
                    for at in np.split(every, range(FLUSH, len(every), FLUSH)) if len(every) else ():
                        held.append((i, places, size, at))
                        rows += len(at)
                        if rows >= FLUSH:
                            yield packed(batch, held)
                            held, rows = [], 0
            if held:
                yield packed(batch, held)

    schema = ", ".join([f"protein_id {proteins.schema['id'].dataType.simpleString()}", "sequence string", "mass long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    return proteins.select("id", "sequence", *(f.name for f in kept)).mapInArrow(run if protease.semi or protease.rule == "unspecific" else run_cuts, schema)


def masses(proteins: DataFrame, protease) -> DataFrame:
    """(protein_id, mass): the different masses of each protein's peptides, without making one of them."""
    how, letters = _how(protease), CANONICAL + "X" * protease.keep_unknown
    every = None if protease.rule == "unspecific" else free_spans if protease.semi else spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, rows = [], [], 0
            for i, places in _proteins(batch, protease.longest, letters):
                found = [places.masses(at, size) for size, at in ([every(places, *how[:3])[::-1]] if every else starts(places, *how))]
                if found:
                    held.append(np.unique(np.concatenate(found)))
                    ids.append(i)
                    rows += len(held[-1])
                if rows >= FLUSH:
                    yield _masses(batch, ids, held)
                    ids, held, rows = [], [], 0
            if held:
                yield _masses(batch, ids, held)

    rows = proteins.select("id", "sequence")
    return rows.mapInArrow(run, f"protein_id {rows.schema['id'].dataType.simpleString()}, mass long")


SUMS = ("n", "total", "residues", "ends")


def summary(places: Places, how: tuple) -> dict | None:
    """Numbers that all different peptides of a protein add to, its lightest and heaviest, and its first and last by name.

    Of one length the first by name starts the first suffix in order, so only one of each length is made to be compared.
    Sums of a length are taken in two halves, so they are exact for any length of a protein.
    """
    out, names, bounds = dict.fromkeys(SUMS, 0), [], []
    rank, _ = places.classes()
    for size, at in distinct_starts(places, how):
        if not len(at):
            continue
        masses, order = places.masses(at, size), rank[at]
        out["n"] += len(at)
        out["residues"] += size * len(at)
        out["total"] += (int((masses >> 32).sum()) << 32) + int((masses & 0xFFFFFFFF).sum())
        out["ends"] += int((masses % 1000003 * places.residues[at]).sum()) + int(places.residues[at + size - 1].sum(dtype=np.int64))
        names += [places.residues[a : a + size].tobytes() for a in (at[order.argmin()], at[order.argmax()])]
        bounds += [int(masses.min()), int(masses.max())]
    return out | {"lightest": min(bounds), "heaviest": max(bounds), "first": min(names).decode(), "last": max(names).decode()} if names else None


def summaries(proteins: DataFrame, protease) -> DataFrame:
    """(protein_id, n, total, residues, ends, lightest, heaviest, first, last) of each protein that has peptides, without rows of peptides.

    `ends` is the sum of mass % 1000003 times the first residue's code, and the last one's code.
    """
    how, letters = _how(protease), CANONICAL + "X" * protease.keep_unknown
    kinds = {"total": pa.decimal128(38, 0), "first": pa.string(), "last": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, x) for i, places in _proteins(batch, protease.longest, letters) if (x := summary(places, how))]
            columns = [pa.array([Decimal(x[c]) if c == "total" else x[c] for _, x in found], kinds.get(c, pa.int64())) for c in (*SUMS, "lightest", "heaviest", "first", "last")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *columns], names=["protein_id", *SUMS, "lightest", "heaviest", "first", "last"])

    rows = proteins.select("id", "sequence")
    return rows.mapInArrow(run, f"protein_id {rows.schema['id'].dataType.simpleString()}, n long, total decimal(38,0), residues long, ends long, lightest long, heaviest long, first string, last string")


def _masses(batch: pa.RecordBatch, ids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    of = pa.array(np.repeat(ids, [len(x) for x in held]))
    return pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.concatenate(held))], names=["protein_id", "mass"])
