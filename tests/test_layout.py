"""What prunes a stored build: mass ranges, bitmaps of taxa, trigrams, and the walk of the tree."""

import random

import pytest
from pyspark.sql import functions as F

from massgrid.engine import Engine
from massgrid.functions.chemistry import mass_of
from massgrid.operators import layout, search, taxonomy
from massgrid.operators.digest import Protease
from massgrid.plans.ptm import Plan
from massgrid.sources import store

SHORT = Protease("trypsin", 2, 50, 1)
SCHEMA = "id long, accession string, sequence string, taxonomy_id int, is_reviewed boolean, genes array<string>"


def parts_of(frame):
    """Folders of the partition column that a scan lists, from its files."""
    return {f.split("partition=")[1].split("/")[0] if "partition=" in f else f.split("block=")[1].split("/")[0] for f in frame.inputFiles()}


def scanned(frame):
    """Files that the scans of an executed plan have read, by the scans' own count."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numFiles").value()
        kids = [*(node.children().apply(i) for i in range(node.children().size()))]
        todo += [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else kids
    return total


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, f"P{i:05d}", "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(20, 120))), 10 + i % 40, i % 3 == 0, [f"gene{i % 7}", "x" * (i % 3)]) for i in range(400)]
    taxa = spark.createDataFrame([(1, 1, "root", 1), *((i, 1 if i < 13 else 10 + (i - 10) // 4, f"taxon {i}", 3 if i > 20 else 2) for i in range(10, 50))], "id int, parent_id int, scientific_name string, rank_id int")
    ranks = spark.createDataFrame([(1, "no rank"), (2, "genus"), (3, "species")], "id int, name string")
    path = str(tmp_path_factory.mktemp("build") / "b")
    return Engine.stored(path, spark.createDataFrame(rows, SCHEMA), taxa, ranks, SHORT, range_rows=100, block_rows=20)


def test_mass_ranges_are_disjoint_and_even(built):
    ranges = sorted((r.lo, r.hi, r.n) for r in built.ranges.collect())
    assert len(ranges) > 20 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert sum(n for *_, n in ranges) == built.peptides.count() and max(n for *_, n in ranges) < 400
    assert built.configuration()["partitions"] == ranges and all(f.isEmpty() for f in built.faults().values())


def test_a_search_reads_only_the_ranges_it_needs(built):
    """30 masses, more than a predicate holds: the same answer as from the whole table, and few files."""
    masses = [r.mass for r in built.peptides.orderBy("mass").limit(30).collect()]
    plan = Plan.of(masses, (), (5, 5))
    got = built.search_plan(plan, resolve=False)
    want = search.search(built.peptides, plan, resolve=False)
    rows = lambda f: sorted((r.mass, r.sequence) for r in f.collect())
    assert rows(got) == rows(want) and len(rows(got)) >= 30
    every = len(parts_of(built.ranged))
    assert scanned(layout.pruned(built.ranged, plan, built.ranges)) <= 3 < every == scanned(built.ranged)
    assert layout.pruned(built.ranged, Plan.of([1], (), (1, 1)), built.ranges).isEmpty()


def test_windows_at_the_edges_of_ranges(built):
    """A window that ends where a range begins, or lies between two, meets just those it touches."""
    ranges = sorted((r.lo, r.hi, r.partition) for r in built.ranges.collect())
    windows = built.spark.createDataFrame([(ranges[3][1], ranges[4][0]), (ranges[7][1] + 1, ranges[8][0] - 1), (ranges[9][0] - 1, ranges[9][0])], "lo long, hi long")
    assert {r.partition for r in layout.touched_by(windows, built.ranges).collect()} == {ranges[3][2], ranges[4][2], ranges[9][2]}


def test_bitmaps_of_taxa(built, spark):
    """The same peptides as by joins, for any of the taxa and for one alone; nothing is shuffled."""
    rows = lambda f: sorted((r.mass, r.sequence) for r in f.collect())
    for ids in ([10], [12, 13, 49, 7777], list(range(10, 50)), []):
        taxa = spark.createDataFrame([(i,) for i in ids], "id int")
        bitmap = layout.bitmap_of(taxa)
        for unique in (False, True):
            assert rows(layout.of_bitmap(built.peptides, bitmap, unique)) == rows(search.of_taxa(built.peptides, taxa, unique))
    plan = layout.of_bitmap(built.peptides, bitmap)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert layout.bitmap_of(spark.createDataFrame([(5,), (layout.MOST_TAXON + 1,)], "id long")) is None
    assert layout.bitmap_of(spark.createDataFrame([(-5,)], "id long")) is None


def test_taxa_beyond_a_bitmap_are_joined(built, spark, monkeypatch):
    plan = Plan.of([r.mass for r in built.peptides.limit(40).collect()], (), (5, 5))
    taxa = spark.createDataFrame([(i,) for i in range(10, 30)], "id int")
    rows = lambda f: sorted((r.mass, r.sequence) for r in f.collect())
    want = rows(built.search_plan(plan, taxa, resolve=False))
    monkeypatch.setattr(layout, "MOST_TAXON", 20)
    assert want and rows(built.search_plan(plan, taxa, resolve=False)) == want


def test_ranges_without_the_taxa_are_not_read(built, spark):
    """A taxon that few mass ranges hold, given wide windows."""
    rare = built.ranged.select("partition", F.explode(F.concat("unique_taxonomy_ids", "non_unique_taxonomy_ids")).alias("id"))
    taxon = rare.groupBy("id").agg(F.countDistinct("partition").alias("n")).orderBy("n").first().id
    wide = Plan.of([6_000_000_000_000], (), (999_999, 999_999))
    bitmap = layout.bitmap_of(spark.createDataFrame([(taxon,)], "id int"))
    near = layout.pruned(built.ranged, wide, built.ranges, bitmap)
    bearing = built.ranged.where(F.array_contains(F.concat("unique_taxonomy_ids", "non_unique_taxonomy_ids"), taxon))
    assert scanned(near) == bearing.select("partition").distinct().count() < len(parts_of(built.ranged))


@pytest.mark.parametrize("terms", [("p0001",), ("GENE3",), ("ene1", "P00399"), ("p%9",), ("p__01", "gene5 xx"), ("nothing",), ("x\\%y",), ("e3 x",)])
def test_names_by_trigrams(built, terms):
    rows = lambda f: [(r.id, r.accession) for r in f.collect()]
    assert rows(built.search_proteins(*terms)) == rows(search.find_proteins(built.proteins, *terms))


def test_few_blocks_are_read_for_a_name(built):
    near = layout.candidates(built.grams, ("p00123",))
    assert [tuple(r) for r in near.select("id").collect()] == [(123,)]
    assert layout.candidates(built.grams, ("p%9",)) is None and layout.grams_of("a%bcde_fg") == {"bcd", "cde"}


def test_appended_proteins_are_found(built, spark, tmp_path):
    path = str(tmp_path / "more")
    store.write(path, built.proteins.limit(50), built.taxa.drop("first", "last"), built.ranks, SHORT, range_rows=50, block_rows=10)
    store.append_proteins(spark.createDataFrame([(9000, "NEWONE", "MAKER", 10, True, ["fresh"])], SCHEMA), path)
    again = Engine.opened(spark, path)
    assert [r.id for r in again.search_proteins("resh").collect()] == [9000] == [r.id for r in again.search_proteins("newo").collect()]


def test_the_walk_of_a_deep_tree(spark):
    """A tree of 40 levels and a bush, an orphan and a second root: places nest as the tree does."""
    rng = random.Random(3)
    parents = {1: 1, **{i: i - 1 for i in range(2, 41)}}
    for i in range(41, 200):
        parents[i] = rng.choice(list(parents))
    parents |= {500: 499, 600: 600, 601: 600}
    taxa = spark.createDataFrame([(i, p, f"t{i}", 1) for i, p in parents.items()], "id int, parent_id int, scientific_name string, rank_id int")

    def above(i):
        return {i} | (above(parents[i]) if parents[i] != i and parents[i] in parents else set())

    tree = taxonomy.nested(taxa)
    places = {r.id: (r["first"], r["last"]) for r in tree.collect()}
    assert sorted(f for f, _ in places.values()) == list(range(len(parents)))
    for root in (1, 20, 40, 77, 500, 600, 601):
        below = {i for i in parents if root in above(i)}
        assert {i for i, (f, _) in places.items() if places[root][0] <= f <= places[root][1]} == below
        assert {r.id for r in taxonomy.subtree(tree, [root]).collect()} == below == {r.id for r in taxonomy.subtree(taxa, [root]).collect()}
    assert taxonomy.subtree(tree, [12345]).isEmpty() and taxonomy.subtree(taxa, []).isEmpty()


def test_circles_are_refused(spark):
    taxa = spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, 2)], "id int, parent_id int")
    with pytest.raises(ValueError, match="above itself"):
        taxonomy.nested(taxa)


def test_lookups_of_a_stored_build(built):
    s = built.peptides.first().sequence
    assert built.peptide_exists(s) and built.peptide(s).first().mass == mass_of(s)


def test_ranges_grow_before_there_are_more(spark, tmp_path, monkeypatch):
    """Many rows in small ranges are few folders with larger ranges, in order and whole; full ranges are as many as there are."""
    number = layout.range_number
    assert [number(n, 1000) for n in (0, 1000, 1001, 512_000, 600_000, 76_800_000, 150_000_000)] == [1, 1, 2, 512, 512, 512, 1000]
    assert number(1_000_000, 200_000) == 5 and number(10**9, 200_000) == 5000
    monkeypatch.setattr(layout, "MOST_RANGES", 6)
    path = str(tmp_path / "ranges")
    layout.write_ranges(spark.range(1000).selectExpr("id as mass"), path, "mass", ["mass"], "partition", 10)
    spans = [tuple(r) for r in spark.read.parquet(path).groupBy("partition").agg(F.min("mass"), F.max("mass"), F.count("*")).orderBy("partition").collect()]
    assert len(spans) <= 6 and sum(s[3] for s in spans) == 1000
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
