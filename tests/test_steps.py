"""Steps that many queries share: only what a query asks for is made, shuffled or expanded."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import SMALL, same_rows
from pyspark.sql import functions as F

from massgrid import catalog
from massgrid.engine import Engine
from massgrid.functions.chemistry import mass_of
from massgrid.operators import build, places, search, targets
from massgrid.operators.digest import Protease, digest, merged
from massgrid.plans.ptm import BOND_N, STATIC, TERMINUS_N, VARIABLE, Ptm


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("protease", [Protease("trypsin", 6, 50, 2), Protease("trypsin", 1, 20)])
def test_proteins_are_digested_at_once(protease):
    """Runs of proteins of any size give what a plain digest of each gives, empty, null and foreign residues included."""
    rng, known = random.Random(5), np.zeros(256, bool)
    known[np.frombuffer(places.CANONICAL.encode(), np.uint8)] = True
    texts = ["".join(rng.choices("ACDKRPGBXéM", k=rng.randint(0, 80))) or None for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["sequence"]).slice(3)
    want = set()
    for i, text in enumerate(texts[3:]):
        cut = [x for x in re.split(r"(?<=[KR])(?!P)", text or "") if x]
        runs = {"".join(cut[a:b]) for a in range(len(cut)) for b in range(a + 1, min(len(cut), a + 1 + protease.most_missed) + 1)}
        want |= {(i, s, mass_of(s)) for s in runs if protease.shortest <= len(s) <= protease.longest and set(s) <= set(places.CANONICAL)}
    for most in (17, 1000, 1 << 20):
        got = [(i + of, s, m) for i, data, rows in places._laid_out(batch, most) for of, s, m in zip(*(x.tolist() for x in places.by_cuts(data, rows, known, protease)), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("name", ["trypsin", "semi-trypsin", "unspecific"])
def test_peptides_outside_the_windows_are_not_made(spark, name):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, "".join(rng.choices("ACDEKR", k=60))) for i in range(20)], "id long, sequence string")
    windows = [(9 * 10**11, 10**12), (95 * 10**10, 11 * 10**11), (13 * 10**11, 13 * 10**11 + 10**9), (5, 4)]
    assert merged(windows) == [(9 * 10**11, 11 * 10**11), (13 * 10**11, 13 * 10**11 + 10**9)]
    protease = Protease(name, 6, 12, 2)
    every = {tuple(r) for r in digest(rows, protease).collect()}
    near = [tuple(r) for r in digest(rows, protease, windows).collect()]
    assert len(near) == len(set(near)) and set(near) == {r for r in every if any(a <= r[2] <= b for a, b in windows)} and 0 < len(near) < len(every)
    assert digest(rows, protease, []).isEmpty()
    assert "Filter" not in plan_of(digest(rows, protease, windows))


def test_searches_make_only_what_they_can_match(spark, duck, monkeypatch):
    asked = []
    made = catalog.digest
    monkeypatch.setattr(catalog, "digest", lambda proteins, protease, masses=None: asked.append(masses) or made(proteins, protease, masses))
    for name in ("q_search_terminal", "q_terminal_conditions", "q_search_reviewed", "q_peptide_show", "q_fasta"):
        asked.clear()
        same_rows(catalog.QUERIES[name](spark, SMALL), duck, catalog.ORACLES[name])
        assert asked and all(asked), name
    assert asked == [search.mass_windows(catalog.ONE)]


def test_a_derived_build_answers_as_a_table_does(spark):
    """Lookups in a build that is not stored make no list of proteins that they don't return, and answer as a table does."""
    rng = random.Random(7)
    rows = [(i, f"P{i}", "".join(rng.choices("ACDEKR", k=50)), 1 + i % 3, i % 2 == 0, ["g"]) for i in range(60)]
    rows += [(90 + i, f"Q{i}", rows[4][2], 5, True, []) for i in range(3)]
    proteins = spark.createDataFrame(rows, "id long, accession string, sequence string, taxonomy_id int, is_reviewed boolean, genes array<string>")
    none = spark.createDataFrame([], "id int")
    derived = Engine.derived(spark, proteins, none, none, Protease("trypsin", 6, 50, 1))
    table = Engine(spark, proteins, derived.peptides, none, none, derived.protease)
    seen = [r.sequence for r in table.peptides.select("sequence").limit(3).collect()]
    want = [(s, s in seen) for s in [*seen, "WWWWWW"]]
    for e in (derived, table):
        assert sorted(map(tuple, e.peptides_exist(*seen, "WWWWWW", seen[0]).collect())) == sorted(want)
        assert e.peptide_exists(seen[0]) and not e.peptide_exists("WWWWWW")
    assert "collect" not in plan_of(derived.peptides_exist(*seen))
    assert derived.peptide(seen[0]).collect() == table.peptide(seen[0]).collect()
    for accession in ("p4", "Q1", "none"):
        assert derived.protein_full(accession).collect() == table.protein_full(accession).collect()
    assert [len(r.protein_ids) >= 4 for r in derived.protein_peptides("P4").collect()].count(True) > 0
    # the digest of all proteins is filtered before its only shuffle
    lines = plan_of(derived.protein_peptides("P4")).splitlines()
    assert [x for x in lines if "Join" in x and "BroadcastHashJoin" in x] and not [x for x in lines if "SortMergeJoin" in x]


def test_forms_are_made_only_where_there_are_some(spark, monkeypatch):
    """Peptides without a residue to modify don't reach Python, and conditions are enumerated by what they ask for alone."""
    rng = random.Random(8)
    sequences = sorted({"".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=9)) for _ in range(300)} | {"AAAAAAAAK"})
    oxidation, acetyl = Ptm.of("o", "M", 15.994915, VARIABLE), Ptm.of("n", "M", 42.010565, VARIABLE, TERMINUS_N)
    bond = Ptm.of("b", "X", 42.010565, VARIABLE, BOND_N)
    table = spark.createDataFrame([(s,) for s in sequences], "sequence string")
    for ptms in ([oxidation], [oxidation, acetyl], [bond], [Ptm.of("c", "C", 57.021464, STATIC), oxidation]):
        forms = targets.forms_of(ptms, 1)
        rows = table.select("sequence", targets.can_change(ptms).alias("can"), forms("sequence").alias("forms"), forms(F.lit(None).cast("string")).alias("none")).collect()
        assert all(r.can == (len(r.forms) > 1) and r.none is None for r in rows) and any(r.can for r in rows)
    calls = []
    made = targets.conditions
    monkeypatch.setattr(targets, "conditions", lambda *a: calls.append(1) or made(*a))
    targets.forms_of([oxidation], 1).func(pd.Series(sequences))
    assert len(calls) <= 4


def test_lists_of_one_protein_are_not_sorted(spark):
    """A peptide of one protein needs no work on its lists, and has the same lists."""
    rows = [(1, 5, True), (2, 5, False), (3, 6, False)]
    whole = spark.createDataFrame([(10, "A", *r) for r in rows] + [(20, "B", *rows[0])] + [(30, "C", *r) for r in (rows[2], rows[2])], "mass long, sequence string, protein_id long, taxonomy_id int, is_reviewed boolean")
    made = build.aggregate(whole)
    assert plan_of(made).count("CASE WHEN (size(pairs") == 3
    assert {r.sequence: tuple(r)[2:] for r in made.collect()} == {"A": ([1, 2, 3], [6], [5], True, True), "B": ([1], [5], [], True, False), "C": ([3], [6], [], False, True)}


def test_peptides_of_a_mass_are_counted_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, "AB"), (1, "BA"), (1, "AB"), (2, "AA"), (2, "AA")], "mass long, sequence string")
    made = build.peptide_counts(rows)
    assert plan_of(made).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, made.collect())) == [(1, 2), (2, 1)]
