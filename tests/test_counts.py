"""Numbers of peptidoforms without making them, targets' forms by key, and records by their places."""

import random

import pytest
from helpers import SMALL

from massgrid import catalog
from massgrid.functions import chemistry as chem
from massgrid.functions.proforma import expand
from massgrid.operators import search, targets
from massgrid.plans.ptm import ANYWHERE, BOND_C, BOND_N, STATIC, TERMINUS_C, TERMINUS_N, VARIABLE, Plan, Ptm, PtmSet, conditions, mass_bounds
from massgrid.sources import uniprot

SETS = {
    "two on one residue": [Ptm.of("a", "M", 15.994915, VARIABLE), Ptm.of("b", "M", 31.98983, VARIABLE), Ptm.of("c", "C", 57.021464, STATIC)],
    "ends": [Ptm.of("a", "M", 15.994915, VARIABLE), Ptm.of("b", "S", 79.966331, VARIABLE), Ptm.of("n", "M", 42.010565, VARIABLE, TERMINUS_N), Ptm.of("k", "K", 14.01565, VARIABLE, TERMINUS_C)],
    "bonds": [Ptm.of("a", "S", 79.966331, VARIABLE), Ptm.of("n", "X", 42.010565, VARIABLE, BOND_N), Ptm.of("c", "X", -0.984016, VARIABLE, BOND_C)],
    "an end like a variable one": [Ptm.of("a", "M", 15.994915, VARIABLE), Ptm.of("n", "M", 15.994915, VARIABLE, TERMINUS_N)],
}


def peptides(seed=1):
    rng = random.Random(seed)
    made = {"".join(rng.choices("MSCKAG", k=rng.randint(6, 12))) for _ in range(400)}
    return [(s, chem.mass_of(s)) for s in sorted(made)]


@pytest.mark.parametrize("name", SETS)
def test_totals_are_the_numbers_of_expanded_forms(spark, name):
    rows, ptms = peptides(), SETS[name]
    table = spark.createDataFrame(rows, "sequence string, mass long")
    masses = sorted({m + d for _, m in rows[::40] for d in (0, ptms[0].delta, 2 * ptms[0].delta)}) + [1]
    plan = Plan.of(masses, ptms, (20, 20), 3)
    assert plan.forms_overlap() == (name == "an end like a variable one")
    forms = search.peptidoforms(search.match(table, plan), plan, distinct=False).dropDuplicates(["query_mass", "proforma"])
    want = {r.query_mass: r["count"] for r in forms.groupBy("query_mass").count().collect()}
    got = {r.query_mass: r.peptidoforms for r in search.totals(table, plan).collect()}
    assert set(got) == set(masses) and {m: n for m, n in got.items() if n} == want and sum(want.values()) > len(masses)


@pytest.mark.parametrize("name", SETS)
def test_forms_of_targets_are_those_of_all_conditions(spark, name):
    ptms, rows = SETS[name], peptides(2)[:60]
    roles = PtmSet(ptms)
    table = spark.createDataFrame(rows, "sequence string, mass long")
    for r in table.select("sequence", targets.forms_of(ptms, 2)("sequence").alias("f")).collect():
        mass = chem.mass_of(r.sequence)
        top = mass + sum(abs(p.delta) for p in ptms) * len(r.sequence)
        want = {r.sequence: mass}
        for c in conditions(roles, top, *mass_bounds(top, roles, 1), 2):
            if c.matches(r.sequence):
                want.update(expand(r.sequence, c))
        assert {x.proforma: x.mass for x in r.f} == want


def test_condition_counts(spark):
    masses = spark.createDataFrame([(839403366202,), (1,), (2 * 10**12,)], "query_mass long")
    ptms = [Ptm.of("o", "M", 15.994915, VARIABLE, ANYWHERE)]
    got = {r.query_mass: r.n for r in search.condition_counts(masses, ptms).collect()}
    assert got == {m: len(Plan.of([m], ptms).conditions) for m in got} and len(got) == 3


def test_records_by_their_places(spark, tmp_path):
    """Several files, small splits, blank lines, characters of two bytes, a last record without an end."""
    rng = random.Random(4)
    texts = {}
    for f in range(3):
        whole = ""
        for i in range(40):
            name = f"Q{f}{i:03d}"
            record = f"ID   {name}_é    Reviewed;  9 AA.\nAC   {name}; X1;\nSQ   SEQUENCE   9 AA;\n     " + "".join(rng.choices("ACDEFGHIK", k=rng.randint(5, 60))) + "\n//\n"
            texts[name] = record
            whole += "\n" * (i % 3) + record
        (tmp_path / f"f {f}.txt").write_bytes((whole + ("" if f else "ID   CUT\nAC   CUT;\n")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        index = uniprot.record_index(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.accession for r in index} == set(texts) and len(index) == len(texts)
    rows = spark.createDataFrame(index)
    got = uniprot.read_records(rows).collect()
    assert {r.accession: r.value for r in got} == texts
    assert all(r.bytes == len(texts[r.accession].encode()) for r in got)
    one = uniprot.read_records(rows.where("accession = 'Q1007'")).collect()
    assert [(r.value, r.bytes) for r in one] == [(texts["Q1007"], len(texts["Q1007"].encode()))]
    scanned = {uniprot.fields(r.value)["AC"].split(";")[0] for r in uniprot.scan(spark, str(tmp_path)).collect()}
    assert scanned == set(texts)


def test_queries_read_tables(spark):
    """The plan of every query has a scan of a file, given or derived."""
    for name in ("q_amino_acids", "q_charges", "q_ptm_conditions", "q_terminal_conditions", "q_condition_count"):
        assert "FileScan" in catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SETS)
def test_a_table_of_masses_is_answered_as_a_plan_is(spark, name):
    """Conditions made in the tasks and put together again give the forms of conditions planned on the driver."""
    rows, ptms = peptides(3), SETS[name]
    table = spark.createDataFrame(rows, "sequence string, mass long")
    masses = sorted({m + d for _, m in rows[::20] for d in (0, ptms[0].delta)})
    want = {(r.proforma, r.form_mass) for r in search.search(table, Plan.of(masses, ptms, (20, 20), 2)).collect()}
    asked = spark.createDataFrame([(m,) for m in [*masses, *masses, None]], "mass long")
    got = [(r.proforma, r.form_mass) for r in search.search_table(asked, table, ptms, (20, 20)).collect()]
    assert set(got) == want and len(got) == len(want) > 10


def test_answers_are_remembered_over_batches_and_restarts(spark, tmp_path):
    from massgrid.streaming.searches import search_stream

    rows, ptms = peptides(4), SETS["bonds"]
    table = spark.createDataFrame(rows, "sequence string, mass long")
    masses = [m for _, m in rows[:60]]
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for part in (masses[:30], masses[20:50], masses[:10], masses[40:]):
        spark.createDataFrame([(m,) for m in part], "mass long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("mass long").parquet(source)
        search_stream(stream, table, out, marks, ptms, (20, 20)).awaitTermination()
    got = [r.proforma for r in spark.read.parquet(out).collect()]
    want = {r.proforma for r in search.search(table, Plan.of(masses, ptms, (20, 20), 2)).collect()}
    assert set(got) == want and len(got) == len(want)


def test_pairs_are_estimated_from_a_sample(spark):
    """Few of many proteins are digested, the interval is as narrow as asked for, and the truth is near; few proteins are counted."""
    from massgrid.operators.build import estimated_pairs
    from massgrid.operators.digest import Protease, digest_masses

    rng, p = random.Random(8), Protease("trypsin", 6, 50, 1)
    rows = [(i, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(30, 300)))) for i in range(6000)]
    proteins = spark.createDataFrame([*rows, (6000, ""), (6001, None)], "id long, sequence string").repartition(8)
    got, exact = estimated_pairs(proteins, p).first(), digest_masses(proteins, p).count()
    assert got.proteins == 6002 and 256 <= got.sampled < 3000
    assert got.high - got.mean <= 0.05 * got.mean and abs(got.pairs - exact) <= 0.08 * exact
    few = estimated_pairs(proteins.where("id % 50 = 1"), p).first()
    assert few.sampled == few.proteins == 121 and few.low == few.mean == few.high
    assert estimated_pairs(proteins.where("id < 0"), p).first().pairs == 0


def test_few_long_proteins_do_not_mislead_the_estimate(spark):
    """Twelve of 6,012 proteins have a quarter of the pairs, so a sample of equal chances mostly sees none of them."""
    from massgrid.operators.build import estimated_pairs
    from massgrid.operators.digest import Protease, digest_masses

    rng, p = random.Random(9), Protease("trypsin", 6, 50, 1)
    sizes = [rng.randint(40, 80) for _ in range(6000)] + [10_000] * 12
    proteins = spark.createDataFrame([(i, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=n))) for i, n in enumerate(sizes)], "id long, sequence string").repartition(8)
    exact = digest_masses(proteins, p).count()
    for shift in (0, 10_000, 20_000):
        got = estimated_pairs(proteins.selectExpr(f"id + {shift} as id", "sequence"), p).first()
        assert got.sampled < 3000 and abs(got.pairs - exact) <= 0.05 * exact
        assert got.low * 6012 <= exact <= got.high * 6012 and got.high - got.mean <= 0.05 * got.mean
    # a row that is there twice is one protein of the digest, drawn or counted
    twice = proteins.union(proteins)
    assert abs(estimated_pairs(twice, p).first().pairs - exact) <= 0.05 * exact
    assert estimated_pairs(twice.where("id < 100"), p).first().pairs == digest_masses(proteins.where("id < 100"), p).count()


def test_stream_plans_a_mass_once(spark, tmp_path):
    """Many copies of two masses, in one batch and in a later one after a restart, are two masses to plan and join."""
    from massgrid.functions.chemistry import mass_of
    from massgrid.streaming.searches import search_stream

    table = spark.createDataFrame([(mass_of(s), s) for s in ("PEPTIDEK", "MAKERS")], "mass long, sequence string")
    source, out, marks = (str(tmp_path / x) for x in ("masses", "out", "marks"))
    kept = []
    for _ in range(2):
        spark.createDataFrame([(mass_of(s),) for s in ("PEPTIDEK", "MAKERS")] * 3000, "mass long").coalesce(1).write.mode("append").parquet(source)
        stream = search_stream(spark.readStream.schema("mass long").parquet(source), table, out, marks, (), (1, 1))
        stream.awaitTermination()
        kept += [sorted(s.numRowsTotal for s in p.stateOperators) for p in stream.recentProgress if p.numInputRows]
    assert kept == [[2, 2], [2, 2]]
    assert sorted(r.sequence for r in spark.read.parquet(out).collect()) == ["MAKERS", "PEPTIDEK"]
