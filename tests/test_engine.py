import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from massgrid.engine import Engine
from massgrid.functions.chemistry import mass_of, peptide_mass, to_float
from massgrid.operators import build, search, targets
from massgrid.operators.digest import Protease, digest
from massgrid.plans.ptm import STATIC, VARIABLE, Plan, Ptm
from massgrid.sources import files, store, uniprot

# Fixed value: the sequence of human leptin.
LEPTIN = "MHWGTLCGFLWLWPYLFYVQAVPIQKVQDDTKTLIKTIVTRINDISHTQSVSSKQKVTGLDFIPGLHPILTLSKMDQTLAVYQQILTSMPSRNVIQISNDLENLRDLLHVLAFSKSCHLPWASGLETLDSLGGVLEASGYSTEVVALSRLQGSLQDMLWQLDLSPGC"
SHORT = Protease("trypsin", 6, 50, 0)


@pytest.fixture(scope="module")
def proteins(spark):
    rows = [(1, "A1", LEPTIN, 2000, True, ["LEP", "OB"]), (2, "A2", LEPTIN, 2000, True, ["LEP"]), (3, "B1", LEPTIN[1:], 2001, False, []), (4, "E", "", 2001, False, []), (5, "X", "AXAAAAAAK", 2001, False, [])]
    return spark.createDataFrame(rows, "id long, accession string, sequence string, taxonomy_id int, is_reviewed boolean, genes array<string>")


@pytest.fixture(scope="module")
def engine(spark, proteins, tmp_path_factory):
    taxa = spark.createDataFrame([(1, 1, "root", 1), (10, 1, "Genus", 2), (2000, 10, "Homo one", 3), (2001, 10, "Homo two", 3), (2002, 2001, "strain", 1)], "id int, parent_id int, scientific_name string, rank_id int")
    ranks = spark.createDataFrame([(1, "no rank"), (2, "genus"), (3, "species")], "id int, name string")
    path = str(tmp_path_factory.mktemp("built") / "peptides")
    return Engine.built(spark, proteins, taxa, ranks, SHORT, path)


def whole(name, low, high, missed=None):
    """Peptides of leptin by plain Python."""
    cuts = [i + 1 for i, c in enumerate(LEPTIN[:-1]) if c in "KR" and LEPTIN[i + 1] != "P"]
    ends = [0, *cuts, len(LEPTIN)]
    spans = {(ends[i], ends[j]) for i in range(len(ends)) for j in range(i + 1, min(i + 2 + missed, len(ends)))}
    if name == "trypsin":
        return {LEPTIN[a:b] for a, b in spans if low <= b - a <= high}
    return {s for a, b in spans for n in range(low, min(high, b - a) + 1) for s in (LEPTIN[a : a + n], LEPTIN[b - n : b])}


def test_digests(spark):
    one = spark.createDataFrame([(1, LEPTIN)], "id long, sequence string")
    got = lambda p: {r.sequence for r in digest(one, p).collect()}
    full, semi, free = got(Protease("trypsin", 6, 50, 2)), got(Protease("semi-trypsin", 6, 50, 2)), got(Protease("unspecific", 6, 50))
    assert full == whole("trypsin", 6, 50, 2) and len(full) == 27
    assert semi == whole("semi", 6, 50, 2) and len(semi) == 687
    assert len(free) == 6300 and full <= free
    windows = digest(one, Protease("trypsin", 6, 50, 2), (10**12, 2 * 10**12))
    assert all(10**12 <= r.mass <= 2 * 10**12 and r.mass == mass_of(r.sequence) for r in windows.collect())
    for bad in (("chymo",), ("trypsin", 0), ("trypsin", 9, 6), ("trypsin", 6, 51)):
        with pytest.raises(ValueError):
            Protease(*bad)


def test_unknown_residues(spark):
    rows = spark.createDataFrame([(1, "AXAAAAAAK"), (2, "ABAAAAAAK")], "id long, sequence string")
    assert digest(rows, SHORT).isEmpty()
    kept = digest(rows, Protease("trypsin", 6, 50, 0, keep_unknown=True)).collect()
    assert [r.sequence for r in kept] == ["AXAAAAAAK"]
    assert rows.select(peptide_mass(F.col("sequence")).alias("m")).first().m == mass_of("AXAAAAAAK")


def test_uniqueness(engine):
    rows = {r.sequence: r for r in engine.peptides.collect()}
    first = LEPTIN[: LEPTIN.index("K") + 1]
    assert rows[first].protein_ids == [1, 2] and rows[first].non_unique_taxonomy_ids == [2000] and rows[first].unique_taxonomy_ids == []
    assert rows[first[1:]].unique_taxonomy_ids == [2001] and rows[first[1:]].is_trembl and not rows[first[1:]].is_swiss_prot
    other = rows["VTGLDFIPGLHPILTLSK"]
    assert other.protein_ids == [1, 2, 3] and other.unique_taxonomy_ids == [2001] and other.is_swiss_prot and other.is_trembl
    assert other.aa_counts[0] == 0 and other.aa_counts[ord("L") - 65] == 4
    assert {r.key: r.value for r in engine.stats().collect()} == {"proteins": 5, "peptides": len(rows), "masses": len({r.mass for r in rows.values()})}


def test_lookups(engine, spark):
    assert engine.peptide_exists("VTGLDFIPGLHPILTLSK") and not engine.peptide_exists("AAAAAAK")
    found = engine.peptide("VTGLDFIPGLHPILTLSK").first()
    assert [p.accession for p in found.proteins] == ["A1", "A2", "B1"]
    assert engine.protein("a1").count() == 1 and engine.protein_by_gene("OB").count() == 1
    assert [r.accession for r in engine.search_proteins("lep").collect()] == ["A1", "A2"]
    with pytest.raises(ValueError):
        engine.search_proteins("a")
    masses = [r.mass for r in engine.protein_peptides("A1").collect()]
    assert masses == sorted(masses) and masses and engine.protein_peptides("E").isEmpty()
    ids = spark.createDataFrame([(1,), (1,), (99,)], "id long")
    assert [tuple(r) for r in engine.resolve_protein_ids(ids).collect()] == [(1, "A1")]
    assert {r.id for r in engine.sub_species(1).collect()} == {2000, 2001}
    assert engine.sub_species(2002).isEmpty()
    assert engine.search_taxonomies("homo").count() == 2 and engine.search_taxonomies("10").first().scientific_name == "Genus"
    assert engine.taxonomy(2000).first()["rank"] == "species"


def test_search_is_sound_and_complete(engine):
    ptms = [Ptm.of("c", "C", 57.021464, STATIC), Ptm.of("m", "M", 15.994915, VARIABLE)]
    table = engine.peptides.collect()
    masses = [to_float(r.mass + 57021464000 * r.sequence.count("C")) for r in table]
    plan = Plan.of([int(m * 1e9) for m in masses], ptms, (5, 5), 2)
    want = {(k, r.sequence) for k, c in enumerate(plan.conditions) for r in table if plan.window(c)[0] <= r.mass <= plan.window(c)[1] and c.matches(r.sequence)}
    assert len(plan.conditions) > search.MOST_LITERAL
    got = {(r.cond_id, r.sequence) for r in search.match(engine.peptides, plan).collect()}
    assert got == want and want
    few = Plan(plan.query_mass[:9], plan.conditions[:9], plan.ppm)
    assert {(r.cond_id, r.sequence) for r in search.match(engine.peptides, few).collect()} == {x for x in want if x[0] < 9}
    forms = engine.search(masses, ptms, (5, 5), 2).collect()
    assert len({f.proforma for f in forms}) == len(forms)
    assert engine.search(masses[0], taxa=[10]).count() == engine.search(masses[0]).count()
    assert engine.search(masses[0], taxa=[2002]).isEmpty()
    assert engine.condition_count(839.403366202, ptms, 2) == len(Plan.of([839403366202], ptms, most_variable=2).conditions)


def test_layout(engine, spark, tmp_path):
    ranges = build.partition_ranges(engine.peptides, 3).collect()
    assert sum(r.n for r in ranges) == engine.peptides.count()
    assert build.tiling_faults(spark.createDataFrame(ranges)).isEmpty()
    fixed = spark.createDataFrame([(13, 400, 500), (12, 200, 300), (10, 100, 200), (11, 200, 200)], "partition long, lo long, hi long")
    asked = spark.createDataFrame([(150,), (200,), (250,), (350,)], "mass long")
    assert sorted(map(tuple, build.partitions_of(asked, fixed).collect())) == [(150, 10), (200, 10), (200, 11), (200, 12), (250, 12)]
    plan = engine.peptides.where(search.windows(Plan.of([10**12]))).select("sequence")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(mass)" in plan and "GreaterThanOrEqual(mass" in plan


def test_targets(engine):
    rows = engine.srm_prm_targets(["A1", "B1"], [10], "2,3", [Ptm.of("m", "M", 15.994915, VARIABLE)]).collect()
    assert {r.charge for r in rows} == {2, 3} and any("[+15.994915]" in r.proforma for r in rows)
    assert {r.protein for r in rows} <= {"A1 (LEP, OB)", "A2 (LEP)", "B1"}
    assert targets.charges("2-4") == [2, 3, 4] and targets.charges("2,4,3,2") == [2, 3, 4] and targets.charges(" 2 ") == [2]
    for bad in ("", "abc", "4-2", "2,abc", "300"):
        with pytest.raises(ValueError):
            targets.charges(bad)
    for layout in files.LAYOUTS:
        engine_rows = engine.srm_prm_targets(["B1"], [10], "2")
        assert files.targets_tsv(engine_rows, layout, "Homo two (2001)", 27.0).columns == files.LAYOUTS[layout]


RECORD = """ID   X_HUMAN                 Reviewed;         10 AA.
AC   P99999; Q00000;
GN   Name=cmoB {ECO:1, ECO:2}; Synonyms=yecP;
GN   OrderedLocusNames=b1871, JW1860;
OX   NCBI_TaxID=83333 {ECO:1};
CC   -!- ALTERNATIVE PRODUCTS:
CC       Event=Alternative splicing; Named isoforms=2;
CC       Name=1;
CC         IsoId=P99999-1; Sequence=Displayed;
CC       Name=2;
CC         IsoId=P99999-2; Sequence=VSP_1;
FT   VAR_SEQ         3..5
FT                   /note="Missing (in isoform
FT                   2)"
FT                   /id="VSP_1"
SQ   SEQUENCE   10 AA;
     ACDEFGHIKL
//
"""


def test_uniprot(spark, tmp_path):
    (tmp_path / "a.txt").write_text(RECORD + "\n" + RECORD.replace("P99999", "P11111") + RECORD[: RECORD.index("FT ")])
    rows = uniprot.proteins(uniprot.scan(spark, str(tmp_path / "*.txt"))).collect()
    assert [(r.accession, r.sequence) for r in rows] == [("P99999", "ACDEFGHIKL"), ("P99999-2", "ACGHIKL"), ("P11111", "ACDEFGHIKL"), ("P11111-2", "ACGHIKL")]
    assert rows[0].genes == ["cmoB", "yecP", "b1871", "JW1860"] and rows[0].taxonomy_id == 83333 and rows[0].is_reviewed
    record = uniprot.from_bytes(RECORD.encode())
    assert uniprot.write(record) + "\n" == RECORD
    with pytest.raises(uniprot.RecordError):
        uniprot.fields("ID   x\nZZ   y")
    with pytest.raises(uniprot.RecordError):
        uniprot.from_bytes(b"AC   x\n//\n")
    features = uniprot.features("VAR_SEQ         <2..3\n                /note=\"DEF -> G H (in x)\"\nVARIANT         ?\nINIT_MET        P1-2:1")
    assert features[0].start == ("before", 2) and features[0].operation() == ("replace", "DEF", "GH")
    assert features[1].start == ("unknown", None) and features[2].isoform == "P1-2"
    make = lambda a, b, note: uniprot.features(f"VAR_SEQ         {a}..{b}\n                /note=\"{note}\"")
    assert uniprot.edited("ACDEFG", make(2, 3, "CD -> WW")) == "AWWEFG"
    for bad in (make(2, 3, "XX -> W"), make(5, 9, "Missing"), make(2, 3, "Missing") + make(3, 4, "Missing")):
        with pytest.raises(uniprot.RecordError):
            uniprot.edited("ACDEFG", bad)


def test_files(spark, tmp_path, engine, proteins):
    (tmp_path / "p.tsv").write_text("name\tamino_acid\tmass_delta\tmod_type\tposition\nMod0\tC\t57.021464\tStatic\tAnywhere\nMod1\tM\t15.994915\tVariable\tAnywhere\n")
    assert [p.delta for p in files.read_ptms(spark, str(tmp_path / "p.tsv"))] == [57021464000, 15994915000]
    (tmp_path / "m.txt").write_text("839.403366202\n\n420.708959567 2\n")
    masses = [r.mass for r in files.read_masses(spark, str(tmp_path / "m.txt")).collect()]
    assert abs(masses[0] - 839403366202) < 2 and abs(masses[1] - masses[0]) < 10_000
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n5\t|\t1\t|\tspecies\t|\n7\t|\t6\t|\tspecies\t|\n")
    (tmp_path / "names").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n5\t|\tFive\t|\t\t|\tscientific name\t|\n5\t|\tV\t|\t\t|\tsynonym\t|\n")
    taxa, ranks = files.read_taxonomy(spark, str(tmp_path / "nodes"), str(tmp_path / "names"))
    assert {r.id: r.scientific_name for r in taxa.collect()} == {1: "root", 5: "Five", 7: None} and ranks.count() == 2
    assert [r.id for r in files.orphans(taxa).collect()] == [7]
    config = files.read_config(files.config_text(SHORT, [(1, 2, 3)], "c"))
    assert config["protease"] == SHORT and config["partitions"] == [(1, 2, 3)]
    forms = spark.createDataFrame([("BBB", 2_500_000_000), ("AAA", 1_000_000_000)], "proforma string, form_mass long")
    assert [r.value for r in files.fasta(forms).collect()] == [">mdb|0|1\nAAA", ">mdb|1|2.5\nBBB"]
    out = files.peptides_tsv(engine.peptides, proteins)
    files.write_tsv(out, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == engine.peptides.count()
    assert files.json_lines(out).first().value.startswith("{")


def test_stream_of_masses(engine, spark, tmp_path):
    from massgrid.functions.display import peptide_text
    from massgrid.streaming.searches import search_stream

    wanted = [r.mass for r in engine.peptides.limit(3).collect()]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(m,) for m in wanted], "mass long").write.parquet(source)
    stream = spark.readStream.schema("mass long").parquet(source)
    search_stream(stream, engine.peptides, out, str(tmp_path / "marks"), ppm=(1, 1)).awaitTermination()
    found = spark.read.parquet(out)
    assert {r.mass for r in found.collect()} == set(wanted)
    assert engine.peptides.select(peptide_text().alias("t")).first().t.count("\n") == 6


def test_stored_build(engine, spark, proteins, tmp_path):
    path = str(tmp_path / "build")
    made = Engine.stored(path, proteins, engine.taxa, engine.ranks, SHORT, "all of it")
    again = Engine.opened(spark, path)
    for e in (made, again):
        assert e.protease == SHORT and e.configuration()["comment"] == "all of it"
        assert sorted(map(str, e.peptides.collect())) == sorted(map(str, engine.peptides.collect()))
        assert e.proteins.count() == 5 and e.taxonomy_by_name("Homo one").first().id == 2000
    ranges = again.configuration()["partitions"]
    assert sum(n for _, _, n in ranges) == engine.peptides.count()
    assert all(rows.isEmpty() for rows in again.faults().values())
    stats = store.read_stats(spark, path)
    assert stats["proteins"] == 5 and stats["peptides"] == engine.peptides.count() and stats["protein_bytes"] == proteins.agg(F.sum(build.protein_bytes())).first()[0]
    store.write_stats(spark.createDataFrame([("peptides", 1), ("more", 2)], "key string, value long"), path)
    assert store.read_stats(spark, path) == stats | {"peptides": 1, "more": 2}
    store.append_proteins(spark.createDataFrame([(9, "N", "AAAAAAAK", 2001, False, ["g"])], proteins.schema), path)
    assert Engine.opened(spark, path).protein_range(3, 10).select("id").orderBy("id").collect() == [(3,), (4,), (5,), (9,)]
    broken = Engine.opened(spark, path)
    broken.proteins = broken.proteins.where("id <> 1")
    broken.taxa = broken.taxa.where("id <> 10")
    assert {k for k, rows in broken.faults().items() if not rows.isEmpty()} == {"associations", "orphans"}
    with pytest.raises(ValueError):
        engine.configuration()


def test_more_calls(engine, spark, proteins, tmp_path):
    full = engine.protein_full("a1").first()
    assert [p.sequence for p in full.peptides] == [r.sequence for r in engine.protein_peptides("A1").collect()] and full.peptides
    assert engine.protein_full("E").first().peptides == []
    rows = engine.search_proteins_digested("lep").collect()
    assert [r.accession for r in rows] == ["A1", "A2"] and [p.mass for p in rows[0].peptides] == [p.mass for p in full.peptides]
    peptide = full.peptides[0]
    asked = {"mass": to_float(peptide.mass) + 1e-9, "modifications": [{"name": "m", "amino_acid": "M", "mass_delta": 15.994915, "mod_type": "Variable", "position": "Anywhere"}], "lower_mass_tolerance_ppm": 5, "upper_mass_tolerance_ppm": 5, "taxonomy_ids": [10], "is_reviewed": True}
    payload = base64.urlsafe_b64encode(json.dumps(asked).encode()).decode().rstrip("=")
    assert peptide.sequence in {r.proforma for r in engine.search_url(payload).collect()}
    assert engine.search_url(base64.b64encode(json.dumps(asked | {"taxonomy_ids": [2002]}).encode()).decode()).isEmpty()
    engine.search_to_fasta(str(tmp_path / "f"), [asked["mass"]], ppm=(5, 5))
    lines = [r.value for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert lines[0].startswith(">mdb|0|") and peptide.sequence in lines
    took = engine.search_performance([asked["mass"], 1.0], ppm=(5, 5)).first()
    assert took.masses == 2 and took.peptidoforms == (len(lines) // 2) and took.seconds >= took.longest > 0
    forms = spark.createDataFrame([("B", 2), ("A", 2), ("C", 1)], "proforma string, form_mass long")
    assert [r.value for r in files.text_lines(forms).collect()] == ["", "C", "A", "B"]


def test_many_taxa_by_joins(engine, spark):
    for wanted in ([2000], [2001], [2000, 2001], [7], []):
        taxa = spark.createDataFrame([(i,) for i in wanted], "id int")
        one, any_ = search.of_taxa(engine.peptides, taxa, unique=True), search.of_taxa(engine.peptides, taxa)
        assert sorted(one.select("sequence").collect()) == sorted(engine.peptides.where(search.in_one_taxon(wanted)).select("sequence").collect())
        assert sorted(any_.select("sequence").collect()) == sorted(engine.peptides.where(search.in_taxa(wanted)).select("sequence").collect())


def test_loaded_ids(spark, tmp_path):
    (tmp_path / "a.txt").write_text(RECORD + RECORD.replace("P99999", "A11111"))
    rows = uniprot.proteins(uniprot.scan(spark, str(tmp_path / "a.txt")))
    assert [(r.id - uniprot.FIRST_ID, r.accession) for r in uniprot.loaded(rows).orderBy("id").collect()] == [(0, "A11111"), (1, "A11111-2"), (2, "P99999"), (3, "P99999-2")]
    counts = uniprot.load_counts(rows).first()
    assert counts.proteins == 4 and counts.bytes == rows.agg(F.sum(build.protein_bytes())).first()[0]


def test_one_shuffle_for_the_peptide_table(proteins):
    plan = build.aggregate(digest(proteins.drop("accession", "genes"), SHORT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_proteins(spark):
    """Places in several chunks, and a peptide that comes in two of them."""
    rng = random.Random(2)
    long = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(700))
    long += long[100:120]
    got = digest(spark.createDataFrame([(1, long), (2, "AAAAA")], "id long, sequence string"), Protease("unspecific", 6, 9)).collect()
    want = {long[i : i + n] for n in range(6, 10) for i in range(len(long) - n + 1)}
    assert sorted(r.sequence for r in got) == sorted(want) and all(r.mass == mass_of(r.sequence) for r in got)
