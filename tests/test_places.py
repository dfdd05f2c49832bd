"""Digests by places against plain string work."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from massgrid.functions.chemistry import CANONICAL, mass_of
from massgrid.operators import places
from massgrid.operators.digest import Protease, digest, digest_masses

KINDS = [Protease("unspecific", 6, 50), Protease("unspecific", 1, 3), Protease("semi-trypsin", 6, 50, 2), Protease("semi-trypsin", 2, 9, 0), Protease("trypsin", 6, 50, 2), Protease("trypsin", 1, 50), Protease("semi-unspecific", 3, 5), Protease("semi-trypsin", 4, 12, 1, keep_unknown=True)]


def plain(sequence, p):
    """Distinct peptides by slicing strings."""
    n = len(sequence)
    if p.rule == "unspecific":
        spans = {(a, a + k) for a in range(n) for k in range(p.shortest, p.longest + 1) if a + k <= n}
    else:
        cuts = [0, *(i + 1 for i in range(n - 1) if sequence[i] in "KR" and sequence[i + 1] != "P"), n] if n else [0]
        windows = [(cuts[i], cuts[j]) for i in range(len(cuts)) for j in range(i + 1, min(i + p.most_missed + 2, len(cuts)))]
        spans = set(windows)
        if p.semi:
            spans = {s for a, b in windows for k in range(p.shortest, min(p.longest, b - a) + 1) for s in ((a, a + k), (b - k, b))}
    letters = set(CANONICAL + "X" * p.keep_unknown)
    return {sequence[a:b] for a, b in spans if p.shortest <= b - a <= p.longest and set(sequence[a:b]) <= letters}


def of_places(sequence, p, distinct):
    known = np.zeros(256, bool)
    known[np.frombuffer((CANONICAL + "X" * p.keep_unknown).encode(), np.uint8)] = True
    if not sequence:
        return []
    own = places.Places(np.frombuffer(sequence.encode(), np.uint8), known, p.longest)
    found = (places.distinct_starts if distinct else places.starts)(own, *([places._how(p)] if distinct else places._how(p)))
    return [(sequence[a : a + k], m) for k, at in found for a, m in zip(at.tolist(), own.masses(at, k).tolist())]


@settings(max_examples=150, deadline=None)
@given(st.text("AKRPMXBa", max_size=90), st.integers(0, 3), st.sampled_from(KINDS))
def test_peptides_and_masses(text, repeats, p):
    sequence = text * (repeats + 1)  # repeats share long prefixes
    want = plain(sequence, p)
    got = of_places(sequence, p, True)
    assert len(got) == len(want) and {s for s, _ in got} == want
    assert all(m == mass_of(s) for s, m in got)
    assert {s for s, _ in of_places(sequence, p, False)} == want


PROTEINS = ["", None, "MK", "AKRPMXBa" * 30, "ACDEFGHIKLMNPQRSTVWY" * 7, "K" * 200, "ünknøwn MAKER", "PEPTIDEK" * 3 + "X" + "PEPTIDEK"]


@pytest.mark.parametrize("p", KINDS, ids=str)
def test_frames(spark, p, monkeypatch):
    """Each protein's peptides and masses as rows, with what the protein has besides; empty and null proteins have none."""
    monkeypatch.setattr(places, "FLUSH", 50)
    proteins = spark.createDataFrame([(i, s, [f"g{i}"], 7) for i, s in enumerate(PROTEINS)], "id long, sequence string, genes array<string>, mass2 int")
    rows = digest(proteins, p).collect()
    want = {(i, s) for i, text in enumerate(PROTEINS) for s in plain(text or "", p)}
    assert len(rows) == len(want) and {(r.protein_id, r.sequence) for r in rows} == want
    assert all(r.mass == mass_of(r.sequence) and r.genes == [f"g{r.protein_id}"] and r.mass2 == 7 for r in rows)
    masses = [tuple(r) for r in digest_masses(proteins, p).collect()]
    assert len(masses) == len(set(masses)) and set(masses) == {(i, mass_of(s)) for i, s in want}
    assert digest(proteins.limit(0), p).isEmpty() and digest_masses(proteins.limit(0), p).isEmpty()


def test_masses_need_no_strings(spark):
    """The plan of a digest of masses has no peptide, neither made nor carried."""
    plan = digest_masses(spark.range(1).selectExpr("id", "'MAKER' as sequence"), KINDS[2])._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "substr" not in plan and "Exchange" not in plan and "MapInArrow" in plan
