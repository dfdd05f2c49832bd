"""Mass searches: conditions joined with peptides over mass buckets, filters, and lookups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massgrid.functions.proforma import expand
from massgrid.operators.digest import merged
from massgrid.plans.ptm import ANYWHERE, BOND_C, BOND_N, STATIC, TERMINUS_C, TERMINUS_N, Condition, Plan, Ptm

#: Width of a bucket, 1 Dalton. A window meets all buckets that it touches, two as a rule.
BUCKET = 1_000_000_000
#: Up to so many conditions become one predicate, which reaches the scan; beyond it they become a joined table.
MOST_LITERAL = 24


def reviewed(flag: bool | None) -> Column:
    """None: all; True: SwissProt; False: TrEMBL, which is not the complement, as a peptide may be in both."""
    return F.lit(True) if flag is None else F.col("is_swiss_prot" if flag else "is_trembl")


def in_taxa(ids: list[int]) -> Column:
    """In a protein of one of the taxa, whether unique there or not."""
    wanted = F.array(*(F.lit(i) for i in ids)).cast("array<int>")
    return F.arrays_overlap("unique_taxonomy_ids", wanted) | F.arrays_overlap("non_unique_taxonomy_ids", wanted)


def in_one_taxon(ids: list[int]) -> Column:
    """Unique in exactly one of the taxa."""
    return F.size(F.array_intersect(F.col("unique_taxonomy_ids"), F.array(*(F.lit(i) for i in ids)).cast("array<int>"))) == 1


def of_taxa(peptides: DataFrame, taxa: DataFrame, unique: bool = False) -> DataFrame:
    """Peptides of a protein of one of the taxa (id); unique: unique in exactly one of them. By joins, for any number of taxa."""
    bearers = F.col("unique_taxonomy_ids") if unique else F.concat("unique_taxonomy_ids", "non_unique_taxonomy_ids")
    borne = peptides.select("mass", "sequence", F.explode(bearers).alias("id")).join(taxa.select(F.col("id").cast("int").alias("id")).distinct(), "id", "left_semi")
    hits = borne.groupBy("mass", "sequence").agg(F.count("*").alias("n"))
    return peptides.join(hits.where("n = 1") if unique else hits, ["mass", "sequence"], "left_semi")


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _count(letter: Column) -> Column:
    return F.length("sequence") - F.length(F.replace(F.col("sequence"), letter))


def matches(plan: Plan, k: int) -> Column:
    """One condition as a predicate of literals."""
    c = plan.conditions[k]
    tests = [F.col("mass").between(*plan.window(c))]
    tests += [_count(F.lit(r)) == n for r, n in c.exact().items()] + [_count(F.lit(r)) >= n for r, n in c.least().items()]
    tests += [F.col("sequence").startswith(c.n_terminal.residue)] if c.n_terminal else []
    tests += [F.col("sequence").endswith(c.c_terminal.residue)] if c.c_terminal else []
    return every(tests)


def mass_windows(plan: Plan) -> list[tuple[int, int]]:
    """The plan's mass windows, merged; a digest that is given them makes no other peptide."""
    return merged(plan.window(c) for c in plan.conditions)


def windows(plan: Plan) -> Column:
    """Any of the plan's mass windows, merged: what partition pruning and row-group statistics can use."""
    return reduce(lambda a, b: a | b, (F.col("mass").between(*w) for w in mass_windows(plan)), F.lit(False))


def match(peptides: DataFrame, plan: Plan) -> DataFrame:
    """Rows of peptides (mass, sequence, ...) with cond_id and query_mass, one for each condition that they meet."""
    spark = peptides.sparkSession
    if len(plan.conditions) <= MOST_LITERAL:
        hits = F.array_compact(F.array(*(F.when(matches(plan, k), F.lit(k)) for k in range(len(plan.conditions))))) if plan.conditions else F.array().cast("array<int>")
        masses = F.array(*(F.lit(m) for m in plan.query_mass)).cast("array<long>")
        found = peptides.where(windows(plan)).withColumn("cond_id", F.explode(hits))
        return found.withColumn("query_mass", F.element_at(masses, F.col("cond_id") + 1))
    # the planner bounds the conditions (MOST_CONDITIONS a mass); Spark broadcasts them or not by their size
    return joined(peptides, plan.frame(spark), ["cond_id", "query_mass"])


def joined(peptides: DataFrame, table: DataFrame, named: list[str]) -> DataFrame:
    """Rows of peptides with the named columns of each condition of a table that they meet: equal buckets, then the tests."""
    table = table.withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {BUCKET}"), F.expr(f"hi div {BUCKET}"))))
    ready = peptides.withColumn("bucket", F.expr(f"mass div {BUCKET}"))
    tests = every(
        [
            F.col("p.mass").between(F.col("c.lo"), F.col("c.hi")),
            F.forall(F.map_entries("c.exact"), lambda e: _count(e["key"]) == e["value"]),
            F.forall(F.map_entries("c.least"), lambda e: _count(e["key"]) >= e["value"]),
            F.col("c.starts").isNull() | F.expr("startswith(p.sequence, c.starts)"),
            F.col("c.ends").isNull() | F.expr("endswith(p.sequence, c.ends)"),
        ]
    )
    both = table.alias("c").join(ready.alias("p"), (F.col("p.bucket") == F.col("c.bucket")) & tests)
    return both.select(*(F.col(f"p.{c}") for c in peptides.columns), *(f"c.{c}" for c in named))


PLANNED = "query_mass long, lo long, hi long, exact map<string,int>, least map<string,int>, starts string, ends string, uses array<int>"


def planned(masses: DataFrame, ptms: list[Ptm], ppm: tuple[int, int] = (10, 10), most_variable: int = 2, shortest: int = 6) -> DataFrame:
    """The conditions of masses (column mass) that stand in a table or arrive as a stream, made in the tasks.

    `uses` numbers the modifications of a condition, from which it is put together again where its forms are made.
    """
    ptms = list(ptms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for mass in frame["mass"]:
                plan = Plan.of([mass], ptms, ppm, most_variable, shortest)
                for c in plan.conditions:
                    uses = [ptms.index(p) for p in (*c.static, *c.variable, c.n_terminal, c.c_terminal, c.n_bond, c.c_bond) if p]
                    rows.append((mass, *plan.window(c), c.exact(), c.least(), c.n_terminal and c.n_terminal.residue, c.c_terminal and c.c_terminal.residue, uses))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PLANNED.split(", ")])

    return masses.select(F.col("mass").cast("long").alias("mass")).where("mass is not null").mapInPandas(run, PLANNED)


def forms_by_use(matched: DataFrame, ptms: list[Ptm]) -> DataFrame:
    """(mass, sequence, proforma, form_mass): every placement of the modifications that `uses` numbers."""
    ptms = list(ptms)
    places = ("n_terminal", "c_terminal", "n_bond", "c_bond")

    def condition(uses) -> Condition:
        own = [ptms[i] for i in uses]
        free = [p for p in own if p.position == ANYWHERE]
        ends = {place: p for place, at in zip(places, (TERMINUS_N, TERMINUS_C, BOND_N, BOND_C)) for p in own if p.position == at}
        return Condition(0, tuple(p for p in free if p.kind == STATIC), tuple(p for p in free if p.kind != STATIC), **ends)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(q, s, text, m) for q, s, uses in zip(frame["mass"], frame["sequence"], frame["uses"], strict=True) for text, m in expand(s, condition(uses))]
            yield pd.DataFrame(rows, columns=["mass", "sequence", "proforma", "form_mass"])

    return matched.select("mass", "sequence", "uses").mapInPandas(run, "mass long, sequence string, proforma string, form_mass long")


def search_table(masses: DataFrame, peptides: DataFrame, ptms: list[Ptm] = (), ppm: tuple[int, int] = (10, 10), most_variable: int = 2, shortest: int = 6) -> DataFrame:
    """Each different peptidoform of all masses of a table or stream once; nothing is planned on the driver.

    A mass is planned and joined once, however often it comes: its forms are the same. Forms are told apart by 128 bits of
    their text. In a stream masses and forms are the state, so a form that an earlier batch, even one before a restart, has
    answered does not come again; the state grows with the different masses and the forms that were answered.
    """
    asked = masses.select(F.col("mass").cast("long").alias("mass")).dropDuplicates(["mass"])
    found = forms_by_use(joined(peptides.select("mass", "sequence"), planned(asked, ptms, ppm, most_variable, shortest), ["uses"]), ptms)
    keyed = found.select("mass", "sequence", "proforma", "form_mass", F.xxhash64("proforma").alias("_a"), F.xxhash64(F.lit("second"), "proforma").alias("_b"))
    return keyed.dropDuplicates(["_a", "_b"]).drop("_a", "_b")


def condition_counts(masses: DataFrame, ptms: list[Ptm], most_variable: int = 2, shortest: int = 6) -> DataFrame:
    """(query_mass, n): how many conditions each mass has. Planned in the tasks, so any number of masses will do."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["n"] = [len(Plan.of([m], ptms, most_variable=most_variable, shortest=shortest).conditions) for m in frame["query_mass"]]
            yield frame

    return masses.select("query_mass").mapInPandas(run, "query_mass long, n long")


def form_counts(matched: DataFrame, plan: Plan) -> DataFrame:
    """Adds n_forms: how many peptidoforms a matched row has under its condition, without making one of them.

    Modifications of a residue choose among its free places, those that no modification of an end takes: a product of
    binomials. Conditions of one mass give different forms unless two roles of the plan's modifications agree in residue
    and delta; see forms_overlap.
    """
    table = matched.sparkSession.createDataFrame([(i, c.n_terminal and c.n_terminal.residue, c.c_terminal and c.c_terminal.residue, c.choices()) for i, c in enumerate(plan.conditions)], "cond_id int, _n string, _c string, _choices array<struct<residue:string,n:int,before:int>>")
    both = matched.join(table, "cond_id")  # Spark broadcasts the conditions or not by their size
    room = lambda x: _count(x["residue"]) - F.coalesce((F.col("_n") == x["residue"]).cast("int"), F.lit(0)) - F.coalesce((F.col("_c") == x["residue"]).cast("int"), F.lit(0)) - x["before"]
    binomial = lambda m, n: F.aggregate(F.sequence(F.lit(1), n), F.lit(1).cast("long"), lambda a, i: F.call_function("div", a * (m - n + i), i))
    return both.withColumn("n_forms", F.aggregate("_choices", F.lit(1).cast("long"), lambda a, x: a * binomial(room(x), x["n"]))).drop("_n", "_c", "_choices")


def totals(peptides: DataFrame, plan: Plan) -> DataFrame:
    """(query_mass, peptidoforms) of all masses of a plan, those without any included: one job, and no form is made."""
    if plan.forms_overlap():
        counts = peptidoforms(match(peptides, plan), plan, distinct=False).dropDuplicates(["query_mass", "proforma"]).groupBy("query_mass").agg(F.count("*").alias("peptidoforms"))
    else:
        counts = form_counts(match(peptides, plan), plan).groupBy("query_mass").agg(F.sum("n_forms").alias("peptidoforms"))
    asked = peptides.sparkSession.createDataFrame([(m,) for m in dict.fromkeys(plan.query_mass)], "query_mass long")
    return asked.join(counts, "query_mass", "left").select("query_mass", F.coalesce("peptidoforms", F.lit(0)).alias("peptidoforms"))


FORM = "proforma string, form_mass long"


def peptidoforms(matched: DataFrame, plan: Plan, distinct: bool = True) -> DataFrame:
    """Adds (proforma, form_mass): every placement of the condition's modifications; distinct: each text once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            forms = [list(expand(s, plan.conditions[c])) for s, c in zip(frame["sequence"], frame["cond_id"], strict=True)]
            out = frame.loc[frame.index.repeat([len(f) for f in forms])].reset_index(drop=True)
            out["proforma"] = [t for f in forms for t, _ in f]
            out["form_mass"] = pd.Series([m for f in forms for _, m in f], dtype="int64")
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matched.schema.fields)
    out = matched.mapInPandas(run, f"{schema}, {FORM}")
    return out.dropDuplicates(["proforma"]) if distinct else out


def search(peptides: DataFrame, plan: Plan, taxa: list[int] | DataFrame | None = None, is_reviewed: bool | None = None, resolve: bool = True, distinct: bool = True, ranges: DataFrame | None = None) -> DataFrame:
    """The search: conditions, taxa and review status, then peptidoforms, or each peptide once if resolve is off.

    ranges: of peptides that are stored by mass ranges, so that only those that the windows and taxa need are read.
    Taxa in a table become a bitmap and a filter; only if their numbers are too great for one are they joined, and then
    with what the conditions leave.
    """
    from massgrid.operators import layout  # which imports this module

    bitmap = layout.bitmap_of(taxa) if isinstance(taxa, DataFrame) else None
    rows = layout.pruned(peptides, plan, ranges, bitmap).drop("partition") if ranges is not None else peptides
    rows = rows.where(reviewed(is_reviewed)) if is_reviewed is not None else rows
    if bitmap is not None:
        rows = layout.of_bitmap(rows, bitmap)
    elif isinstance(taxa, list):
        rows = rows.where(in_taxa(taxa))
    found = match(rows, plan)
    if isinstance(taxa, DataFrame) and bitmap is None:
        kept = of_taxa(found.dropDuplicates(["mass", "sequence"]), taxa).select("mass", "sequence")
        found = found.join(kept, ["mass", "sequence"], "left_semi")
    return peptidoforms(found, plan, distinct) if resolve else found.dropDuplicates(["mass", "sequence"])


def lookup(peptides: DataFrame, sequence: str, mass: int) -> DataFrame:
    """One peptide; the mass lets the scan skip row groups."""
    return peptides.where((F.col("mass") == mass) & (F.col("sequence") == sequence)).limit(1)


def proteins_of(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(sequence, and the proteins' columns but their sequence) for each protein of each peptide."""
    links = peptides.select("sequence", F.explode("protein_ids").alias("id"))
    return links.join(proteins.drop("sequence"), "id")


def names_match(terms: tuple[str, ...], least: int = 3) -> Column:
    """Accession or a gene contains one of the terms, in any case."""
    if not terms or any(len(t.encode()) < least for t in terms):
        raise ValueError(f"search terms need {least} bytes or more")
    genes = F.array_join("genes", " ")
    return reduce(lambda a, b: a | b, (F.col("accession").ilike(f"%{t}%") | genes.ilike(f"%{t}%") for t in terms))


def find_proteins(proteins: DataFrame, *terms: str, least: int = 3) -> DataFrame:
    """Proteins whose accession or a gene contains one of the terms, in any case; reviewed ones first. Reads all."""
    return proteins.where(names_match(terms, least)).orderBy(F.desc("is_reviewed"), "accession")


def resolve(ids: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """(id, name) of the ids that the table has."""
    return ids.select("id").distinct().join(table.select(F.col(key).alias("id"), name), "id")


def page(rows: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """Rows number * size to (number + 1) * size - 1 in the order; takes the top rows only, not a full sort's output."""
    return rows.orderBy(*order).limit((number + 1) * size).offset(number * size)
