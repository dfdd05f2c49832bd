"""Every query of the peptide engine by name, with its SQL for DuckDB.

Queries run over whole tables. Lists leave as sorted, comma-joined text, and counts as bigint, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid import views
from massgrid.engine import Engine
from massgrid.functions import chemistry as chem
from massgrid.functions.codecs import compact_size, decode_ids, decode_sequence, encode_ids, encode_sequence
from massgrid.functions.display import protein_text, taxon_text
from massgrid.functions.hydrophobicity import hydrophobicity
from massgrid.operators import build, search, targets, taxonomy
from massgrid.operators.digest import Protease, digest, digest_masses, digest_summaries, fragments, missed_cleavages
from massgrid.plans.ptm import ANYWHERE, BOND_C, BOND_N, STATIC, TERMINUS_C, TERMINUS_N, VARIABLE, Plan, Ptm
from massgrid.shared import scratch, written
from massgrid.sources import files, store, uniprot
from massgrid.streaming.searches import search_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TRYPSIN = Protease("trypsin", 6, 50, 2)
SEMI = Protease("semi-trypsin", 6, 50, 2)
UNSPECIFIC = Protease("unspecific", 6, 50)
#: Masses in Dalton of peptides that many of the derived proteins have.
MASSES = [chem.to_int(m) for m in (641.276903295, 716.34531724, 745.397018485, 761.355547605, 799.346045535, 1153.547598965, 3233.40933428, 3745.68002995)]
PPM = (20, 20)
CARBAMIDOMETHYL = Ptm.of("carbamidomethylation", "C", 57.021464, STATIC)
OXIDATION = Ptm.of("oxidation", "M", 15.994915, VARIABLE)
PHOSPHO = Ptm.of("phosphorylation", "S", 79.966331, VARIABLE)
PYRO_GLU = Ptm.of("pyro-glu", "E", -18.010565, VARIABLE, TERMINUS_N)
METHYL_K = Ptm.of("methylation", "R", 14.01565, VARIABLE, TERMINUS_C)
ACETYL = Ptm.of("acetylation", "X", 42.010565, VARIABLE, BOND_N)
AMIDE = Ptm.of("amidation", "X", -0.984016, VARIABLE, BOND_C)
BASE = views.digest_sql(TRYPSIN)
PEPTIDES = f"{BASE},\n{views.PEPTIDES_SQL}"
TREE = "with recursive " + views.TAXA_SQL
RANKED = "select t.id, parent_id, scientific_name, rank_id, r.name as rank from taxa t join ranks r on r.id = t.rank_id"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def joined(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def joined_sql(column: str) -> str:
    return f"array_to_string(cast({column} as varchar[]), ',') as {column}"


def digested(spark: SparkSession, sf_dir: str, protease: Protease = TRYPSIN, masses: list[tuple[int, int]] | None = None) -> DataFrame:
    return digest(views.proteins(spark, sf_dir), protease, masses)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the derived tables; its peptides are the plan that makes them."""
    return Engine.derived(spark, views.proteins(spark, sf_dir), views.taxa(spark, sf_dir), views.ranks(spark), TRYPSIN)


def peptide_table(spark: SparkSession, sf_dir: str, masses: list[tuple[int, int]] | None = None) -> DataFrame:
    """The peptide table; with windows of masses only what lies within them is made."""
    return build.aggregate(digested(spark, sf_dir, TRYPSIN, masses).drop("genes", "accession"))


# --- digestion ------------------------------------------------------------------------------------------------------


@query("q_trypsin_full", f"with {views.PROTEINS_SQL},\n{views.FRAGMENTS_SQL}\nselect id, count(*) as n, cast(max(p - a) as bigint) as longest, cast(sum((p - a) * (p - a)) as bigint) as squares from cuts group by id")
def _(spark, sf_dir):
    rows = views.proteins(spark, sf_dir).where("sequence <> ''").select("id", F.explode(fragments(F.col("sequence"), TRYPSIN)).alias("s"))
    size = F.length("s").cast("long")
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.sum(size * size).alias("squares"))


@query("q_trypsin_mc2", f"{BASE} select protein_id, sequence, mass from digest")
def _(spark, sf_dir):
    return digested(spark, sf_dir).select("protein_id", "sequence", "mass")


def plain_sql(mass: str) -> str:
    """A scaled mass in Dalton without trailing zeros."""
    return f"regexp_replace(cast({mass} // 1000000000 as varchar) || '.' || lpad(cast({mass} % 1000000000 as varchar), 9, '0'), '[.]?0+$', '')"


PER_PROTEIN = "select protein_id, count(*) as n, cast(sum(mass) as decimal(38, 0)) as total, min(sequence) as first, max(sequence) as last from digest group by protein_id"


@query("q_semi_trypsin", f"{views.digest_sql(SEMI)} {PER_PROTEIN}")
def _(spark, sf_dir):
    rows = digest_summaries(views.proteins(spark, sf_dir), SEMI)
    return rows.groupBy("protein_id").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"))


#: Numbers that all peptides of a protein add to: how many, their masses and lengths, and their ends.
ENDS = "cast(sum(mass % 1000003 * ascii(substr(sequence, 1, 1)) + ascii(substr(sequence, length(sequence), 1))) as bigint) as ends"


@query("q_unspecific", f"{views.digest_sql(UNSPECIFIC)} select protein_id, count(*) as n, cast(sum(mass) as bigint) as total, min(mass) as lightest, max(mass) as heaviest, cast(sum(length(sequence)) as bigint) as residues, {ENDS} from digest group by protein_id")
def _(spark, sf_dir):
    rows = digest_summaries(views.proteins(spark, sf_dir), UNSPECIFIC)
    return rows.groupBy("protein_id").agg(F.sum("n").alias("n"), F.sum("total").cast("long").alias("total"), F.min("lightest").alias("lightest"), F.max("heaviest").alias("heaviest"), F.sum("residues").alias("residues"), F.sum("ends").alias("ends"))


@query("q_missed_cleavages", f"{BASE}, inner_sites as (select sequence, cast(len(list_filter(range(1, length(sequence) + 1), lambda i: sequence[i] in ('K', 'R') and sequence[i + 1] <> 'P')) as bigint) as missed from (select distinct sequence from digest)) select missed, count(*) as n from inner_sites group by missed")
def _(spark, sf_dir):
    return digested(spark, sf_dir).select("sequence").distinct().groupBy(missed_cleavages(F.col("sequence"), TRYPSIN).alias("missed")).agg(F.count("*").alias("n"))


# --- chemistry ------------------------------------------------------------------------------------------------------


@query("q_residue_counts", f"with {views.PROTEINS_SQL} select id, array_to_string(list_transform(range(0, 26), lambda i: cast(length(sequence) - length(replace(sequence, chr(cast(i + 65 as int)), '')) as varchar)), ',') as counts from proteins")
def _(spark, sf_dir):
    counts = F.array(*(chem.count_of(F.col("sequence"), chem.code_letter(i)).cast("string") for i in range(26)))
    return views.proteins(spark, sf_dir).select("id", F.array_join(counts, ",").alias("counts"))


@query("q_peptide_mass", f"{BASE} select sequence, any_value(mass) as mass, any_value(mass) / 1e9 as dalton from digest group by sequence")
def _(spark, sf_dir):
    rows = digested(spark, sf_dir).select("sequence", "mass").distinct()
    return rows.select("sequence", "mass", chem.float_mass(F.col("mass")).alias("dalton"))


MZ = f"(mass / 1e9 + charge * {chem.PROTON}e0) / charge"


@query("q_mz_conversion", f"{BASE} select mass, charge, cast(floor({MZ} * 1e5) as bigint) as mz5, cast(round((({MZ}) * charge - charge * {chem.PROTON}e0) * 1e5) as bigint) as back5 from (select distinct mass from digest), (select unnest([1, 2, 3]) as charge)")
def _(spark, sf_dir):
    rows = digested(spark, sf_dir).select("mass").distinct().withColumn("charge", F.explode(F.array(*(F.lit(c) for c in targets.charges("1-3")))))
    mz = chem.dalton_to_mz(chem.float_mass(F.col("mass")), F.col("charge"))
    return rows.select("mass", "charge", F.floor(mz * 1e5).cast("long").alias("mz5"), F.round(chem.mz_to_dalton(mz, F.col("charge")) * 1e5).cast("long").alias("back5"))


@query("q_ppm_window", f"{BASE} select distinct mass, mass - mass // 1000000 * 10 as lo, mass + mass // 1000000 * 5 as hi from digest")
def _(spark, sf_dir):
    lo, hi = chem.ppm_window(F.col("mass"), 10, 5)
    return digested(spark, sf_dir).select("mass").distinct().select("mass", lo.alias("lo"), hi.alias("hi"))


#: Atoms of C, H, N, O, S and Se in each residue, from which the SQL takes the masses.
ATOMS = "A 3 5 1 1 0 0, C 3 5 1 1 1 0, D 4 5 1 3 0 0, E 5 7 1 3 0 0, F 9 9 1 1 0 0, G 2 3 1 1 0 0, H 6 7 3 1 0 0, I 6 11 1 1 0 0, K 6 12 2 1 0 0, L 6 11 1 1 0 0, M 5 9 1 1 1 0, N 4 6 2 2 0 0, O 12 19 3 2 0 0, P 5 7 1 1 0 0, Q 5 8 2 2 0 0, R 6 12 4 1 0 0, S 3 5 1 2 0 0, T 4 7 1 2 0 0, U 3 5 1 1 0 1, V 5 9 1 1 0 0, W 11 10 2 1 0 0, X 0 0 0 0 0 0, Y 9 9 1 2 0 0"
RESIDUES_SQL = f"""with {views.PROTEINS_SQL}, atoms as (select string_split(unnest(string_split('{ATOMS}', ', ')), ' ') as a),
  masses as (select a[1] as code, cast(floor(cast(a[2]::int * 12 + a[3]::int * 1.007825035 + a[4]::int * 14.003074 + a[5]::int * 15.99491463 + a[6]::int * 31.9720707 + a[7]::int * 79.9165196 as double) * 1e9) as bigint) as mono_mass from atoms),
  letters as (select c, count(*) as n from (select unnest(string_split(sequence, '')) as c from proteins) group by c)
select code, mono_mass, code not in ('O', 'U', 'X') as is_canonical, coalesce(n, 0) as n from masses left join letters on c = code"""


@query("q_amino_acids", RESIDUES_SQL)
def _(spark, sf_dir):
    """Each amino acid with how often the proteins have it."""
    counts = views.proteins(spark, sf_dir).agg(*(F.coalesce(F.sum(chem.count_of(F.col("sequence"), c)), F.lit(0)).alias(c) for c in chem.MASS))
    found = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in chem.MASS))).alias("x")).select("x.*")
    return chem.amino_acids(spark).join(found, "code").select("code", "mono_mass", "is_canonical", "n")


@query("q_compact_size", f"{BASE} select distinct sequence, sequence as back, cast((6 + 5 * length(sequence) + 7) // 8 as bigint) as bytes, cast(length(sequence) // 4 as int) as first from digest")
def _(spark, sf_dir):
    """Every peptide through the packed encoding and back, the bytes it took and the first byte, which begins with the length."""

    def run(frames):
        for f in frames:
            data = [encode_sequence(x) for x in f["sequence"]]
            yield f.assign(back=[decode_sequence(d) for d in data], bytes=[compact_size(len(x)) for x in f["sequence"]], first=[d[0] >> 4 for d in data])

    return digested(spark, sf_dir).select("sequence").distinct().mapInPandas(run, "sequence string, back string, bytes long, first int")


@query("q_protein_id_codec")
def _(spark, sf_dir):
    """Ids of every mass through the codec and back; bytes and how many came back unchanged."""

    def run(frames):
        for f in frames:
            data = [encode_ids(list(x)) for x in f["protein_ids"]]
            yield f.assign(bytes=[len(d) for d in data], same=[decode_ids(d) == list(x) for d, x in zip(data, f["protein_ids"], strict=True)])[["mass", "bytes", "same"]]

    return build.mass_index(digest_masses(views.proteins(spark, sf_dir), TRYPSIN)).mapInPandas(run, "mass long, bytes long, same boolean")


@query("q_hydrophobicity")
def _(spark, sf_dir):
    return digested(spark, sf_dir, Protease("trypsin", 6, 50, 0)).select("sequence").distinct().withColumn("score", F.round(hydrophobicity("sequence"), 6))


# --- peptide table --------------------------------------------------------------------------------------------------


@query("q_peptides_agg", f"{PEPTIDES} select mass, sequence, {joined_sql('protein_ids')}, is_swiss_prot, is_trembl from peptides")
def _(spark, sf_dir):
    return peptide_table(spark, sf_dir).select("mass", "sequence", joined("protein_ids"), "is_swiss_prot", "is_trembl")


@query("q_unique_taxa", f"{PEPTIDES} select sequence, {joined_sql('unique_taxonomy_ids')}, {joined_sql('non_unique_taxonomy_ids')} from peptides")
def _(spark, sf_dir):
    return peptide_table(spark, sf_dir).select("sequence", joined("unique_taxonomy_ids"), joined("non_unique_taxonomy_ids"))


@query("q_mass_index", f"{BASE}, ids as (select mass, list_sort(list(distinct protein_id)) as protein_ids from digest group by mass) select mass, {joined_sql('protein_ids')} from ids")
def _(spark, sf_dir):
    return build.mass_index(digest_masses(views.proteins(spark, sf_dir), TRYPSIN)).select("mass", joined("protein_ids"))


@query("q_semi_masses", f"{views.digest_sql(SEMI)} select mass, count(distinct protein_id) as proteins from digest group by mass")
def _(spark, sf_dir):
    return digest_masses(views.proteins(spark, sf_dir), SEMI).groupBy("mass").agg(F.count("*").alias("proteins"))


RANGES = """counted as (select mass, count(distinct sequence) as n from digest group by mass),
tiled as (select mass, n, cast(coalesce(sum(n) over (order by mass rows between unbounded preceding and 1 preceding), 0) // 5000 as bigint) as partition from counted),
ranges as (select partition, min(mass) as lo, max(mass) as hi, cast(sum(n) as bigint) as n from tiled group by partition)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.tiled(written(build.peptide_counts(digested(spark, sf_dir)), "mass-counts"), 5000)


@query("q_partition_ranges", f"{BASE}, {RANGES} select * from ranges")
def _(spark, sf_dir):
    return ranges(spark, sf_dir)


#: Ranges with faults: every third reaches into the one before it, and every seventh is missing.
FAULTY = "select partition, case when partition % 3 = 1 then lo - 5000000000 else lo end as lo, hi, n from ranges where partition % 7 <> 3"


def faulty(ranges: DataFrame) -> DataFrame:
    moved = F.when(F.col("partition") % 3 == 1, F.col("lo") - 5_000_000_000).otherwise(F.col("lo"))
    return ranges.withColumn("lo", moved).where("partition % 7 <> 3")


@query("q_range_tiling_check", f"{BASE}, {RANGES}, faulty as ({FAULTY}) select partition, lo, hi, before from (select *, lag(hi) over (order by lo, hi) as before from faulty) where before >= lo")
def _(spark, sf_dir):
    return build.tiling_faults(faulty(ranges(spark, sf_dir)))


@query("q_unassigned_masses", f"{BASE}, {RANGES}, faulty as ({FAULTY}) select mass, n as peptides from counted c where not exists (select 1 from faulty f where c.mass between f.lo and f.hi)")
def _(spark, sf_dir):
    counts = written(build.peptide_counts(digested(spark, sf_dir)), "mass-counts")
    return build.unheld(counts, faulty(build.tiled(counts, 5000)))


@query("q_pairs_per_protein", f"{BASE}, borne as (select distinct mass, protein_id from digest) select (select count(*) from proteins) as proteins, (select count(*) from borne) as pairs, (select count(*) from borne) / (select count(*) from proteins) as mean")
def _(spark, sf_dir):
    return build.pairs_per_protein(digested(spark, sf_dir), views.proteins(spark, sf_dir))


@query("q_pairs_estimated", f"{BASE} select (select count(*) from proteins) as proteins, (select count(*) from (select distinct mass, protein_id from digest)) as pairs, true as near")
def _(spark, sf_dir):
    """The number of pairs, counted, and whether the estimate from a sample is within 5 % of it."""
    proteins = views.proteins(spark, sf_dir)
    counted = build.pairs_per_protein(digest_masses(proteins, TRYPSIN), proteins).select("proteins", "pairs")
    guess = build.estimated_pairs(proteins, TRYPSIN).select(F.col("pairs").alias("guess"))
    return counted.crossJoin(guess).select("proteins", "pairs", (F.abs(F.col("guess") - F.col("pairs")) <= 0.05 * F.col("pairs")).alias("near"))  # one row each


@query("q_partition_lookup", f"{BASE}, {RANGES} select mass, partition from (select distinct mass from digest) join ranges on mass between lo and hi")
def _(spark, sf_dir):
    counts = written(build.peptide_counts(digested(spark, sf_dir)), "mass-counts")
    return build.partitions_of(counts.select("mass"), build.tiled(counts, 5000)).select("mass", "partition")


@query("q_stats", f"{BASE} select 'proteins' as key, (select count(*) from proteins) as value union all select 'peptides', count(distinct sequence) from digest union all select 'masses', count(distinct mass) from digest")
def _(spark, sf_dir):
    proteins = views.proteins(spark, sf_dir)
    return build.stats(proteins, digest(proteins, TRYPSIN).select("mass", "sequence").distinct())


@query(
    "q_condition_merge",
    f"""{BASE}, windows as (select distinct mass // 100000000000 as partition, sequence[1] as signature, mass - mass // 1000000 * 50 as lo, mass + mass // 1000000 * 50 as hi from digest),
    marked as (select *, max(hi) over w as reach from windows window w as (partition by partition, signature order by lo, hi rows between unbounded preceding and 1 preceding)),
    islands as (select *, sum(case when reach is null or reach < lo then 1 else 0 end) over (partition by partition, signature order by lo, hi rows unbounded preceding) as island from marked)
    select partition, signature, min(lo) as lo, max(hi) as hi, count(*) as members from islands group by partition, signature, island""",
)
def _(spark, sf_dir):
    lo, hi = chem.ppm_window(F.col("mass"), 50, 50)
    rows = digested(spark, sf_dir).select(F.expr("mass div 100000000000").alias("partition"), F.substring("sequence", 1, 1).alias("signature"), lo.alias("lo"), hi.alias("hi")).distinct()
    return build.touching_windows(rows)


@query("q_mass_summary", f"{BASE} select n, round(mean, 3) as mean, round(deviation, 3) as deviation, least, most from (select count(*) as n, avg(mass / 1e9) as mean, stddev_pop(mass / 1e9) as deviation, min(mass / 1e9) as least, max(mass / 1e9) as most from (select distinct mass, sequence from digest))")
def _(spark, sf_dir):
    rows = digested(spark, sf_dir).select("mass", "sequence").distinct()
    return chem.summary(rows, chem.float_mass(F.col("mass"))).select("n", F.round("mean", 3).alias("mean"), F.round("deviation", 3).alias("deviation"), "least", "most")


@query("q_row_bytes", f"{PEPTIDES} select sequence, cast(16 + (5 * length(sequence) + 6 + 7) // 8 + 26 + 4 * (len(protein_ids) + len(unique_taxonomy_ids) + len(non_unique_taxonomy_ids)) + 1 as bigint) as bytes from peptides")
def _(spark, sf_dir):
    return peptide_table(spark, sf_dir).select("sequence", chem.row_bytes().alias("bytes"))


@query("q_taxonomy_text", f"{TREE} select t.id, scientific_name || ' (' || r.name || '), id ' || t.id || ', parent ' || parent_id as text from taxa t join ranks r on r.id = t.rank_id")
def _(spark, sf_dir):
    return taxonomy.ranked(views.taxa(spark, sf_dir), views.ranks(spark)).select("id", taxon_text().alias("text"))


@query("q_protein_text", f"""with {views.PROTEINS_SQL} select id, accession || chr(10) || 'taxon: ' || taxonomy_id || chr(10) || 'genes: ' || array_to_string(genes, ', ') || chr(10) || case when is_reviewed then 'reviewed' else 'not reviewed' end || chr(10) ||
  array_to_string(list_transform(range(0, greatest((length(sequence) + 59) // 60, 1)), lambda i: substr(sequence, cast(60 * i + 1 as int), 60)), chr(10)) as text from proteins""")
def _(spark, sf_dir):
    return views.proteins(spark, sf_dir).select("id", protein_text().alias("text"))


# --- taxonomy -------------------------------------------------------------------------------------------------------


@query("q_taxonomy_by_id", f"{TREE} {RANKED} where t.id = 1003")
def _(spark, sf_dir):
    return taxonomy.by_id(views.taxa(spark, sf_dir), views.ranks(spark), 1003)


@query("q_taxonomy_search", f"{TREE} {RANKED} where scientific_name ilike '%nation_1%' or scientific_name ilike '%merica%'")
def _(spark, sf_dir):
    taxa, ranks = views.taxa(spark, sf_dir), views.ranks(spark)
    return taxonomy.search(taxa, ranks, "nation_1").union(taxonomy.search(taxa, ranks, "merica"))


@query("q_taxonomy_by_name", f"{TREE} {RANKED} where scientific_name = 'NATION_7'")
def _(spark, sf_dir):
    return taxonomy.by_name(views.taxa(spark, sf_dir), views.ranks(spark), "NATION_7")


def below_sql(roots: str) -> str:
    return f"{TREE}, below as (select id from taxa where id in ({roots}) union select t.id from taxa t join below b on t.parent_id = b.id)"


@query("q_sub_species", f"{below_sql('101')} {RANKED} where r.name = 'species' and t.id in (select id from below)")
def _(spark, sf_dir):
    return taxonomy.species(views.taxa(spark, sf_dir), views.ranks(spark), [101])


@query("q_species_union", f"{below_sql('102, 103, 1002')} {RANKED} where r.name = 'species' and t.id in (select id from below)")
def _(spark, sf_dir):
    return taxonomy.species(views.taxa(spark, sf_dir), views.ranks(spark), [102, 103, 1002])


@query("q_resolve_taxonomy_ids", f"with {views.PROTEINS_SQL}, {views.TAXA_SQL} select distinct t.id, scientific_name from proteins p join taxa t on t.id = p.taxonomy_id")
def _(spark, sf_dir):
    return search.resolve(views.proteins(spark, sf_dir).select(F.col("taxonomy_id").alias("id")), views.taxa(spark, sf_dir), "id", "scientific_name")


# --- proteins and peptides ------------------------------------------------------------------------------------------

GENES = "array_to_string(genes, ' ')"
SHALLOW = f"select id, accession, length(sequence) as residues, taxonomy_id, is_reviewed, {GENES} as genes from proteins"


def shallow(rows: DataFrame) -> DataFrame:
    return rows.select("id", "accession", F.length("sequence").cast("long").alias("residues"), "taxonomy_id", "is_reviewed", F.array_join("genes", " ").alias("genes"))


@query("q_resolve_protein_ids", f"{BASE} select distinct protein_id as id, accession from digest")
def _(spark, sf_dir):
    return search.resolve(digested(spark, sf_dir).select(F.col("protein_id").alias("id")), views.proteins(spark, sf_dir), "id", "accession")


@query("q_protein_by_accession", f"with {views.PROTEINS_SQL} {SHALLOW} where accession = 'D42'")
def _(spark, sf_dir):
    return shallow(engine(spark, sf_dir).protein("d42"))


@query("q_protein_by_gene", f"with {views.PROTEINS_SQL} {SHALLOW} where list_contains(genes, 'src7')")
def _(spark, sf_dir):
    return shallow(engine(spark, sf_dir).protein_by_gene("src7"))


@query("q_protein_range", f"with {views.PROTEINS_SQL} {SHALLOW} where id >= 100 and id < 140")
def _(spark, sf_dir):
    return shallow(engine(spark, sf_dir).protein_range(100, 140))


@query("q_protein_bytes", f"with {views.PROTEINS_SQL} select id, cast(9 + (16 + 5 * length(sequence) + 7) // 8 + strlen(accession) + coalesce(list_sum(list_transform(genes, lambda g: strlen(g))), 0) as bigint) as bytes from proteins")
def _(spark, sf_dir):
    return views.proteins(spark, sf_dir).select("id", build.protein_bytes().alias("bytes"))


@query("q_protein_search", f"with {views.PROTEINS_SQL} {SHALLOW} where accession ilike '%d12%' or {GENES} ilike '%d12%' or accession ilike '%SRC1 %' or {GENES} ilike '%SRC1 %'")
def _(spark, sf_dir):
    return shallow(search.find_proteins(views.proteins(spark, sf_dir), "d12", "SRC1 "))


@query("q_protein_label", f"with {views.PROTEINS_SQL} select id, accession || ' (' || array_to_string(genes, ', ') || ')' as label from proteins")
def _(spark, sf_dir):
    return views.proteins(spark, sf_dir).select("id", targets.label().alias("label"))


@query("q_protein_peptides", f"{PEPTIDES} select mass, sequence, {joined_sql('protein_ids')} from peptides where sequence in (select sequence from digest where accession = 'D42')")
def _(spark, sf_dir):
    proteins = views.proteins(spark, sf_dir)
    own = digest(proteins.where("accession = 'D42'").select("id", "sequence"), TRYPSIN).select("mass", "sequence")
    all_ = digest(proteins, TRYPSIN).drop("genes", "accession").join(F.broadcast(own), ["mass", "sequence"], "left_semi")  # one protein's
    return build.aggregate(all_).select("mass", "sequence", joined("protein_ids")).orderBy("mass", "sequence")


@query("q_peptide_proteins", f"{BASE} select d.sequence, accession, taxonomy_id, is_reviewed from digest d where sequence = 'INERTHANEA'")
def _(spark, sf_dir):
    found = search.lookup(peptide_table(spark, sf_dir, chem.windows_of("INERTHANEA")), "INERTHANEA", chem.mass_of("INERTHANEA"))
    return search.proteins_of(found, views.proteins(spark, sf_dir)).select("sequence", "accession", "taxonomy_id", "is_reviewed")


@query("q_peptide_show", f"{PEPTIDES} select mass, sequence, {joined_sql('protein_ids')}, {joined_sql('unique_taxonomy_ids')}, is_swiss_prot, is_trembl from peptides where sequence = 'THANEA'")
def _(spark, sf_dir):
    return search.lookup(peptide_table(spark, sf_dir, chem.windows_of("THANEA")), "THANEA", chem.mass_of("THANEA")).select("mass", "sequence", joined("protein_ids"), joined("unique_taxonomy_ids"), "is_swiss_prot", "is_trembl")


@query("q_peptide_exists", f"{BASE} select s as sequence, s in (select sequence from digest) as found from (values ('THANEA'), ('WWWWWWK')) as t(s)")
def _(spark, sf_dir):
    return engine(spark, sf_dir).peptides_exist("THANEA", "WWWWWWK")


DIGESTS = "cast(len(peptides) as bigint) as n, cast(list_sum(list_transform(peptides, lambda x: x.mass)) as decimal(38, 0)) as total, peptides[1].sequence as first"


def digests(rows: DataFrame) -> DataFrame:
    total = F.aggregate("peptides", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["mass"]).cast("decimal(38,0)"))
    return rows.select("accession", F.size("peptides").cast("long").alias("n"), F.when(F.size("peptides") > 0, total).alias("total"), F.get("peptides", 0)["sequence"].alias("first"))


@query("q_protein_full", f"{PEPTIDES}, own as (select list(struct_pack(mass := p.mass, sequence := p.sequence) order by p.mass, p.sequence) as peptides from peptides p where sequence in (select sequence from digest where accession = 'D42')) select 'D42' as accession, {DIGESTS} from own")
def _(spark, sf_dir):
    return digests(engine(spark, sf_dir).protein_full("D42"))


@query("q_protein_search_digests", f"{BASE}, lists as (select accession, list(struct_pack(mass := mass, sequence := sequence) order by mass, sequence) as peptides from digest group by accession) select p.accession, coalesce(n, 0) as n, total, first from proteins p left join (select accession, {DIGESTS} from lists) using (accession) where p.accession ilike '%d12%' or {GENES} ilike '%d12%'")
def _(spark, sf_dir):
    return digests(engine(spark, sf_dir).search_proteins_digested("d12"))


# --- mass searches --------------------------------------------------------------------------------------------------


def hits(spark: SparkSession, sf_dir: str, plan: Plan) -> DataFrame:
    """The filter comes before the aggregation, so only hits are shuffled."""
    found = search.match(digested(spark, sf_dir, TRYPSIN, search.mass_windows(plan)).select("protein_id", "sequence", "mass"), plan)
    return found.groupBy("cond_id", "query_mass", "mass", "sequence").agg(F.countDistinct("protein_id").alias("n_proteins"))


def conditions_sql(masses: list[int], ptms: list[Ptm], ppm: tuple[int, int], most: int = 2, shortest: int = 6) -> str:
    """CTE conds (cond_id, query_mass, mass, lo, hi, fixed, free, starts, ends): every combination of numbers of modifications,
    made in SQL; for one modification of each role at most. A number above 0 must leave the mass of the shortest peptide.
    """
    role = {(p.kind if p.position == ANYWHERE else p.position): p for p in ptms}
    delta = lambda r: role[r].delta if r in role else 0
    counts = lambda r, top: f"range(0, {top + 1 if r in role else 1})"
    least = shortest * chem.MASS["G"]
    static = f"len(range(0, 1 + (q - {least}) // {delta(STATIC)}))" if STATIC in role else "1"
    return f"""asked as (select unnest(range(0, {len(masses)})) as k, unnest({masses!r}) as q),
flags as (
  select *, q - fixed * {delta(STATIC)} - free * {delta(VARIABLE)} as middle, unnest({counts(TERMINUS_N, 1)}) as nt from (
    select *, unnest({counts(VARIABLE, most)}) as free from (select k, q, unnest(range(0, {static})) as fixed from asked))),
ends as (
  select *, unnest({counts(BOND_C, 1)}) as cb from (select *, unnest({counts(BOND_N, 1)}) as nb from (select *, unnest({counts(TERMINUS_C, 1)}) as ct from flags where free = 0 or middle >= {least}))),
conds as (
  select *, mass - mass // 1000000 * {ppm[0]} as lo, mass + mass // 1000000 * {ppm[1]} as hi from (
    select cast(row_number() over (order by k, cb, nb, ct, nt, fixed, free) - 1 as int) as cond_id, cast(q as bigint) as query_mass,
      cast(middle - nt * {delta(TERMINUS_N)} - ct * {delta(TERMINUS_C)} - nb * {delta(BOND_N)} - cb * {delta(BOND_C)} as bigint) as mass, fixed, free, nt = 1 as starts, ct = 1 as ends from ends))"""


def tests_sql(ptms: list[Ptm]) -> str:
    """What a peptide x must have for a condition c."""
    role = {(p.kind if p.position == ANYWHERE else p.position): p.residue for p in ptms}
    number = lambda r: f"length(x.sequence) - length(replace(x.sequence, '{r}', ''))"
    tests = ["x.mass between c.lo and c.hi"]
    tests += [f"{number(role[STATIC])} = c.fixed"] if STATIC in role else []
    needed = [(role[r], n) for r, n in ((VARIABLE, "c.free"), (TERMINUS_N, "cast(c.starts as int)"), (TERMINUS_C, "cast(c.ends as int)")) if r in role]
    tests += [f"{number(r)} >= {' + '.join(n for x, n in needed if x == r)}" for r in dict.fromkeys(r for r, _ in needed)]
    tests += [f"(not c.starts or x.sequence[1] = '{role[TERMINUS_N]}')"] if TERMINUS_N in role else []
    tests += [f"(not c.ends or x.sequence[-1] = '{role[TERMINUS_C]}')"] if TERMINUS_C in role else []
    return " and ".join(tests)


#: Masses, modifications, tolerance and most variable modifications of each search.
ASKED = {
    "q_search_plain": (MASSES[-1:], [], PPM, 2),
    "q_search_static": ([m + CARBAMIDOMETHYL.delta for m in MASSES], [CARBAMIDOMETHYL], (100, 100), 2),
    "q_search_variable": (MASSES[4:6], [CARBAMIDOMETHYL, OXIDATION], PPM, 2),
    "q_search_terminal": (MASSES[:6], [PYRO_GLU, METHYL_K], PPM, 2),
    "q_search_bonds": ([MASSES[0] + ACETYL.delta, MASSES[5] + AMIDE.delta], [ACETYL, AMIDE], PPM, 2),
    "q_search_batch": ([chem.to_int(600.3 + 1.0005 * k) for k in range(500)], [OXIDATION], PPM, 1),
}
SEARCHES = {name: Plan.of(*asked) for name, asked in ASKED.items()}
for _name, (_masses, _ptms, _ppm, _most) in ASKED.items():
    QUERIES[_name] = lambda spark, sf_dir, plan=SEARCHES[_name]: hits(spark, sf_dir, plan).drop("cond_id")
    ORACLES[_name] = f"{BASE}, {conditions_sql(_masses, _ptms, _ppm, _most)} select query_mass, x.mass, sequence, count(distinct protein_id) as n_proteins from digest x join conds c on {tests_sql(_ptms)} group by cond_id, query_mass, x.mass, sequence"


def met(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The conditions of a search, with the number of peptides that meet each, none included."""
    plan = SEARCHES[name]
    found = search.match(digested(spark, sf_dir, TRYPSIN, search.mass_windows(plan)).select("sequence", "mass"), plan).groupBy("cond_id").agg(F.count_distinct("sequence").alias("n"))
    return plan.frame(spark).join(found, "cond_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def met_sql(name: str) -> str:
    return f"{BASE}, {conditions_sql(*ASKED[name])}, counted as (select cond_id, count(distinct sequence) as n from digest x join conds c on {tests_sql(ASKED[name][1])} group by cond_id), met as (select c.*, coalesce(n, 0) as n from conds c left join counted using (cond_id))"


@query("q_ptm_conditions", f"{met_sql('q_search_variable')} select mass, 'occurrences of ''C'' == ' || fixed || case when free > 0 then ', occurrences of ''M'' >= ' || free else '' end as signature, n from met")
def _(spark, sf_dir):
    return met(spark, sf_dir, "q_search_variable").select("mass", "signature", "n")


@query("q_terminal_conditions", f"{met_sql('q_search_terminal')} select query_mass, mass, starts, ends, n from met")
def _(spark, sf_dir):
    rows = met(spark, sf_dir, "q_search_terminal")
    return rows.select("query_mass", "mass", F.col("starts").isNotNull().alias("starts"), F.col("ends").isNotNull().alias("ends"), "n")


#: Whole Daltons at which there are peptides, up to 3000.
DALTONS = "select distinct mass div 1000000000 * 1000000000 as q from digest where mass < 3000000000000"
DALTONS_SQL = conditions_sql([0], [CARBAMIDOMETHYL, OXIDATION], PPM, 2).replace("asked as (select unnest(range(0, 1)) as k, unnest([0]) as q)", f"asked as (select row_number() over (order by q) as k, q from ({DALTONS.replace(' div ', ' // ')}))")


@query("q_condition_count", f"{BASE}, {DALTONS_SQL} select query_mass, count(*) as n from conds group by query_mass")
def _(spark, sf_dir):
    """How many conditions a search for each Dalton with peptides has; planned on the executors."""
    masses = digest_masses(views.proteins(spark, sf_dir), TRYPSIN).selectExpr("mass div 1000000000 * 1000000000 as query_mass").where("query_mass < 3000000000000").distinct()
    return search.condition_counts(masses, [CARBAMIDOMETHYL, OXIDATION], 2, TRYPSIN.shortest)


SHOWN = f"mass, sequence, {joined_sql('protein_ids')}"
WIDE = Plan.of(MASSES, (), (500, 500))
WIDE_SQL = " or ".join(f"mass between {lo} and {hi}" for lo, hi in (WIDE.window(c) for c in WIDE.conditions))


def filtered(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return search.search(peptide_table(spark, sf_dir, search.mass_windows(WIDE)), WIDE, resolve=False, **how).select("mass", "sequence", joined("protein_ids"))


@query("q_search_reviewed", f"{PEPTIDES} select {SHOWN} from peptides where is_swiss_prot and ({WIDE_SQL})")
def _(spark, sf_dir):
    return filtered(spark, sf_dir, is_reviewed=True)


@query("q_search_trembl", f"{PEPTIDES} select {SHOWN} from peptides where is_trembl and ({WIDE_SQL})")
def _(spark, sf_dir):
    return filtered(spark, sf_dir, is_reviewed=False)


@query("q_search_taxonomy", f"{PEPTIDES}, {views.TAXA_SQL}, below as (select id from taxa where id = 101 union select t.id from taxa t join below b on t.parent_id = b.id) select {SHOWN} from peptides where ({WIDE_SQL}) and list_has_any(list_concat(unique_taxonomy_ids, non_unique_taxonomy_ids), (select list(cast(id as int)) from below where id >= 1000))")
def _(spark, sf_dir):
    return filtered(spark, sf_dir, taxa=taxonomy.species(views.taxa(spark, sf_dir), views.ranks(spark), [101]))


ONE, TWO = (Plan.of(MASSES[:6], [OXIDATION], (2000, 2000), n) for n in (1, 2))


def forms(spark: SparkSession, sf_dir: str, plan: Plan, distinct: bool) -> DataFrame:
    found = search.match(digested(spark, sf_dir, TRYPSIN, search.mass_windows(plan)).select("sequence", "mass").distinct(), plan)
    return search.peptidoforms(found, plan, distinct)


def forms_sql(plan: Plan, most: int) -> str:
    """Placements of up to two oxidations by unnesting positions; the plan has conditions with 0, 1, .. of them."""
    mark = f"[+{OXIDATION.delta / chem.SCALE:.6f}]"
    parts = []
    for q, c in zip(plan.query_mass, plan.conditions, strict=True):
        lo, hi = plan.window(c)
        k = len(c.variable)
        source = f"(select distinct sequence, mass from digest where mass between {lo} and {hi})"
        spots = f"(select sequence, mass, unnest(list_filter(range(1, length(sequence) + 1), lambda i: sequence[i] = 'M')) as i from {source})"
        head = f"select cast({q} as bigint) as query_mass, x.sequence, x.mass + {k * OXIDATION.delta} as form_mass, "
        if k == 0:
            parts.append(f"{head} x.sequence as proforma from {source} x")
        elif k == 1:
            parts.append(f"{head} substr(x.sequence, 1, i) || '{mark}' || substr(x.sequence, i + 1) as proforma from {spots} x")
        else:
            parts.append(f"{head} substr(x.sequence, 1, x.i) || '{mark}' || substr(x.sequence, x.i + 1, y.i - x.i) || '{mark}' || substr(x.sequence, y.i + 1) as proforma from {spots} x join {spots} y on x.sequence = y.sequence and x.i < y.i")
    return f"{BASE}, forms as ({' union all '.join(parts)})"


@query("q_peptidoforms_one_mod", f"{forms_sql(ONE, 1)} select query_mass, sequence, proforma, form_mass from forms")
def _(spark, sf_dir):
    return forms(spark, sf_dir, ONE, False).select("query_mass", "sequence", "proforma", "form_mass")


@query("q_peptidoforms_two_mods", f"{forms_sql(TWO, 2)} select query_mass, sequence, proforma, form_mass from forms")
def _(spark, sf_dir):
    return forms(spark, sf_dir, TWO, False).select("query_mass", "sequence", "proforma", "form_mass")


#: Masses of events, many of them alike or so close that their windows overlap.
EVENT_MASS = "650300000000 + event_id % 1000 * 1000500000 + user_id % 3 * 1000"
EVENTS_SQL = conditions_sql([0], [OXIDATION], PPM, 1).replace("asked as (select unnest(range(0, 1)) as k, unnest([0]) as q)", f"asked as (select row_number() over (order by q) as k, q from (select distinct {EVENT_MASS} as q from events))")
ONE_MARK = f"[+{OXIDATION.delta / chem.SCALE:.6f}]"


@query(
    "q_search_stream",
    f"""{BASE}, {EVENTS_SQL}, found as (select distinct x.mass, sequence, free from digest x join conds c on {tests_sql([OXIDATION])})
select mass, sequence, sequence as proforma, mass as form_mass from found where free = 0 union all
select mass, sequence, substr(sequence, 1, i) || '{ONE_MARK}' || substr(sequence, i + 1), mass + {OXIDATION.delta} from (select *, unnest(list_filter(range(1, length(sequence) + 1), lambda i: sequence[i] = 'M')) as i from found where free = 1)""",
)
def _(spark, sf_dir):
    """Masses of all events as a stream in several batches with a restart between them: each form is answered once."""
    base, answers = scratch(spark, "stream"), scratch(spark, "answers")
    stored = written(digested(spark, sf_dir).select("mass", "sequence").distinct(), "peptides")
    masses = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{EVENT_MASS} as mass")
    for half in (0, 1):
        masses.where(F.col("event_id") % 2 == half).select("mass").repartition(2).write.mode("append").parquet(f"{base}/masses")
        arriving = spark.readStream.schema("mass long").option("maxFilesPerTrigger", 1).parquet(f"{base}/masses")
        search_stream(arriving, stored, answers, f"{base}/marks", [OXIDATION], PPM, 1).awaitTermination()
    return spark.read.schema("mass long, sequence string, proforma string, form_mass long").parquet(answers)


@query("q_search_totals", f"{forms_sql(TWO, 2)}, asked as (select cast(unnest({list(dict.fromkeys(TWO.query_mass))}) as bigint) as query_mass) select query_mass, count(proforma) as peptidoforms from asked left join forms using (query_mass) group by query_mass")
def _(spark, sf_dir):
    """How many peptidoforms each mass has, without making them."""
    return search.totals(digested(spark, sf_dir, TRYPSIN, search.mass_windows(TWO)).select("sequence", "mass").distinct(), TWO)


@query("q_distinct_peptidoforms", f"{forms_sql(TWO, 2)} select distinct sequence, proforma, form_mass from forms")
def _(spark, sf_dir):
    return forms(spark, sf_dir, TWO, True).select("sequence", "proforma", "form_mass")


# --- assay targets, sinks -------------------------------------------------------------------------------------------

SPECIES = [1000, 1001, 1002, 1003, 1004]


SPECS = ("2", "2,4,3,2", "2-4", "1-3")
CHARGES_SQL = f"""specs as (select unnest({list(SPECS)!r}) as spec), listed as (
  select distinct spec, unnest(case when contains(spec, '-') then range(split_part(spec, '-', 1)::int, split_part(spec, '-', 2)::int + 1) else list_transform(string_split(spec, ','), lambda x: x::bigint) end) as charge from specs)"""


@query("q_charges", f"{BASE}, {CHARGES_SQL} select spec, cast(charge as int) as charge, count(*) as n from listed, (select distinct mass from digest) where {MZ} between 400 and 1600 group by spec, charge")
def _(spark, sf_dir):
    """How many masses can be seen at each charge that a text asks for, in an instrument's range."""
    asked = F.array(*(F.struct(F.lit(s).alias("spec"), F.lit(c).alias("charge")) for s in SPECS for c in targets.charges(s)))
    rows = digest_masses(views.proteins(spark, sf_dir), TRYPSIN).select("mass").distinct().select("mass", F.explode(asked).alias("x")).select("mass", "x.spec", "x.charge")
    return rows.where(chem.dalton_to_mz(chem.float_mass(F.col("mass")), F.col("charge")).between(400, 1600)).groupBy("spec", "charge").agg(F.count("*").alias("n"))


@query(
    "q_srm_targets",
    f"""{PEPTIDES}, u as (select mass, sequence, unnest(protein_ids) as id from peptides where len(list_intersect(unique_taxonomy_ids, {[*SPECIES]})) = 1)
    select accession || ' (' || array_to_string(genes, ', ') || ')' as protein, u.sequence, charge, cast(floor({MZ} * 1e5) as bigint) as mz5 from u join proteins using (id), (select unnest([2, 3]) as charge)""",
)
def _(spark, sf_dir):
    out = targets.targets(peptide_table(spark, sf_dir), views.proteins(spark, sf_dir), SPECIES, "2-3")
    return out.select("protein", "sequence", "charge", F.floor(F.col("mz") * 1e5).cast("long").alias("mz5"))


MARK = f"[+{OXIDATION.delta / chem.SCALE:.6f}]"
SRM = f"""{PEPTIDES}, u as (select mass, sequence, unnest(protein_ids) as id from peptides where len(list_intersect(unique_taxonomy_ids, {[*SPECIES]})) = 1),
  shapes as (
    select sequence, sequence as proforma, mass from u union
    select sequence, substr(sequence, 1, i) || '{MARK}' || substr(sequence, i + 1), mass + {OXIDATION.delta} from (select sequence, mass, unnest(list_filter(range(1, length(sequence) + 1), lambda i: sequence[i] = 'M')) as i from u)),
  rows as (select accession || ' (' || array_to_string(genes, ', ') || ')' as protein, u.sequence, s.proforma, s.mass, charge from u join proteins using (id) join shapes s on s.sequence = u.sequence, (select unnest([2, 3]) as charge))"""


def srm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.targets(peptide_table(spark, sf_dir), views.proteins(spark, sf_dir), spark.createDataFrame([(i,) for i in SPECIES], "id int"), "2-3", [OXIDATION], 1)


@query("q_srm_targets_ptm", f"{SRM} select protein, sequence, proforma, charge, cast(floor({MZ} * 1e5) as bigint) as mz5 from rows")
def _(spark, sf_dir):
    return srm(spark, sf_dir).select("protein", "sequence", "proforma", "charge", F.floor(F.col("mz") * 1e5).cast("long").alias("mz5"))


def layout_sql(layout: str, **known: str) -> str:
    return f"{SRM} select {', '.join(known.get(c, chr(39) * 2) + f' as {chr(34)}{c}{chr(34)}' for c in files.LAYOUTS[layout] if c != 'Mass [m/z]')} from rows"


@query("q_targets_thermo", layout_sql("thermo", **{"Compound": "proforma", "Species": "'Five species'", "CS [z]": "cast(charge as varchar)", "NCE": "'27.0'", "Accession": "protein"}))
def _(spark, sf_dir):
    """Masses are left out here, as engines write decimals differently; q_srm_targets_ptm compares them."""
    return files.targets_tsv(srm(spark, sf_dir), "thermo", "Five species", 27.0).drop("Mass [m/z]")


@query("q_targets_bruker", layout_sql("bruker", **{"Charge": "cast(charge as varchar)", "CE [eV]": "'27.0'", "External ID": "proforma", "Description": "'Species: Five species'", "Accession": "protein"}))
def _(spark, sf_dir):
    return files.targets_tsv(srm(spark, sf_dir), "bruker", "Five species", 27.0).drop("Mass [m/z]")


@query("q_fasta", f"{forms_sql(ONE, 1)}, d as (select distinct proforma, form_mass from forms) select '>mdb|' || cast(row_number() over (order by form_mass, proforma) - 1 as varchar) || chr(10) || proforma as value from d")
def _(spark, sf_dir):
    return files.fasta(forms(spark, sf_dir, ONE, True), with_mass=False)


@query(
    "q_tsv",
    f"""{PEPTIDES} select {plain_sql('mass')} as mass, sequence, array_to_string(list_sort(list_transform(protein_ids, lambda i: 'D' || i)), ',') as proteins, is_swiss_prot, is_trembl, {joined_sql('unique_taxonomy_ids')}, {joined_sql('non_unique_taxonomy_ids')} from peptides""",
)
def _(spark, sf_dir):
    return files.peptides_tsv(build.aggregate(digested(spark, sf_dir).drop("genes"), names=True), views.proteins(spark, sf_dir))


@query("q_fasta_mass", f"{forms_sql(ONE, 1)}, d as (select distinct proforma, form_mass from forms) select '>mdb|' || cast(row_number() over (order by form_mass, proforma) - 1 as varchar) || '|' || {plain_sql('form_mass')} || chr(10) || proforma as value from d")
def _(spark, sf_dir):
    return files.fasta(forms(spark, sf_dir, ONE, True))


@query("q_text", f"{forms_sql(ONE, 1)}, d as (select distinct proforma from forms) select '' as value union all select proforma from d")
def _(spark, sf_dir):
    return files.text_lines(forms(spark, sf_dir, ONE, True))


JSON = """'{"mass":' || mass || ',"sequence":"' || sequence || '","protein_ids":[' || array_to_string(cast(protein_ids as varchar[]), ',') || '],"is_swiss_prot":' || is_swiss_prot || '}'"""


@query("q_json", f"{PEPTIDES} select {JSON} as value from peptides")
def _(spark, sf_dir):
    return files.json_lines(peptide_table(spark, sf_dir).select("mass", "sequence", "protein_ids", "is_swiss_prot"))


@query("q_page", f"{BASE} select distinct mass, sequence from digest order by mass, sequence limit 50 offset 100")
def _(spark, sf_dir):
    return search.page(digested(spark, sf_dir).select("mass", "sequence").distinct(), 2, 50, "mass", "sequence")


# --- sources and stored builds --------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value) a UniProt record of each protein of 20 residues or more, with an isoform that lacks 3 to 5 and has WW for 8."""
    p = views.proteins(spark, sf_dir).where("length(sequence) >= 20")
    lines = [
        F.format_string("ID   %s_TEST                 %s;         %d AA.", "accession", F.when(F.col("is_reviewed"), "Reviewed").otherwise("Unreviewed"), F.length("sequence")),
        F.format_string("AC   %s; Z%d;", "accession", "id"),
        F.format_string("GN   Name=%s {ECO:1, ECO:2}; Synonyms=%s;", F.coalesce(F.get("genes", 0), F.lit("a")), F.coalesce(F.get("genes", 1), F.lit("b"))),
        F.format_string("OX   NCBI_TaxID=%d {ECO:1};", "taxonomy_id"),
        F.lit("CC   -!- ALTERNATIVE PRODUCTS:\nCC       Event=Alternative splicing; Named isoforms=3;\nCC       Name=1;"),
        F.format_string("CC         IsoId=%s-1; Sequence=Displayed;\nCC       Name=2;\nCC         IsoId=%s-2, %s-9; Sequence=VSP_1, VSP_2;\nCC       Name=3;\nCC         IsoId=%s-3; Sequence=External;", *["accession"] * 4),
        F.lit('FT   VAR_SEQ         3..5\nFT                   /note="Missing (in isoform\nFT                   2)"\nFT                   /id="VSP_1"'),
        F.format_string('FT   VAR_SEQ         8\nFT                   /note="%s -> W W (in isoform 2)"\nFT                   /id="VSP_2"', F.substring("sequence", 8, 1)),
        F.format_string("SQ   SEQUENCE   %d AA;", F.length("sequence")),
        F.concat(F.lit("     "), F.regexp_replace(F.regexp_replace("sequence", "(.{60})(?=.)", "$1\n     "), "([A-Z]{10})(?=[A-Z])", "$1 ")),
    ]
    return p.select(F.concat_ws("\n", *lines).alias("value"))


ISOFORMS = f"""with {views.PROTEINS_SQL}, long as (select * from proteins where length(sequence) >= 20), variants as (
  select accession, sequence, taxonomy_id, is_reviewed, genes from long union all
  select accession || '-2', substr(sequence, 1, 2) || substr(sequence, 6, 2) || 'WW' || substr(sequence, 9), taxonomy_id, is_reviewed, genes from long)"""
LOADED = "accession, sequence, taxonomy_id, is_reviewed, coalesce(genes[1], 'a') || ' ' || coalesce(genes[2], 'b') as genes"


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as compressed text files, scanned and parsed again."""
    path = scratch(spark, "records")
    records(spark, sf_dir).write.option("lineSep", uniprot.RECORD_END).option("compression", "gzip").text(path)
    return uniprot.proteins(uniprot.scan(spark, path))


@query("q_uniprot_load", f"{ISOFORMS} select {LOADED} from variants")
def _(spark, sf_dir):
    return loaded(spark, sf_dir).select("accession", "sequence", "taxonomy_id", "is_reviewed", F.array_join("genes", " ").alias("genes"))


@query("q_uniprot_indexed", f"with {views.PROTEINS_SQL} select accession, sequence, is_reviewed from proteins where length(sequence) >= 20")
def _(spark, sf_dir):
    """Records written as plain text, indexed by their places, and each fetched by its range of bytes."""
    path = scratch(spark, "plain-records")
    records(spark, sf_dir).write.option("lineSep", uniprot.RECORD_END).text(path)
    rows = uniprot.read_records(uniprot.record_index(spark, path))
    body = F.regexp_extract("value", r"(?s)\nSQ [^\n]*\n(.*)\n//\n$", 1)
    return rows.select("accession", F.regexp_replace(body, r"\s", "").alias("sequence"), F.col("value").contains(" Reviewed;").alias("is_reviewed"))


@query("q_uniprot_ids", f"{ISOFORMS} select row_number() over (order by encode(accession)) - 1 + {uniprot.FIRST_ID} as id, accession from variants")
def _(spark, sf_dir):
    return uniprot.loaded(loaded(spark, sf_dir)).select("id", "accession")


@query("q_uniprot_rewritten", f"with {views.PROTEINS_SQL} select accession, true as same from proteins where length(sequence) >= 20")
def _(spark, sf_dir):
    """Records through the parser and the writer and back."""

    def run(frames):
        for f in frames:
            parsed = [uniprot.fields(r) for r in f["value"]]
            same = [uniprot.write(x).removesuffix("\n//") == r and uniprot.from_bytes((r + uniprot.RECORD_END).encode()) == x for x, r in zip(parsed, f["value"], strict=True)]
            yield f.assign(accession=[uniprot.accession(x["AC"]) for x in parsed], same=same)[["accession", "same"]]

    return records(spark, sf_dir).mapInPandas(run, "accession string, same boolean")


@query("q_taxonomy_dump", f"{TREE} {RANKED}")
def _(spark, sf_dir):
    """The tree as a dump's files, read again; synonyms in it are left out."""
    ranked, path = taxonomy.ranked(views.taxa(spark, sf_dir), views.ranks(spark)), scratch(spark, "dump")
    end = lambda *fields: F.concat(F.concat_ws("\t|\t", *(f.cast("string") for f in fields)), F.lit("\t|")).alias("value")
    ranked.select(end(F.col("id"), F.col("parent_id"), F.col("rank"))).write.text(f"{path}/nodes")
    names = ranked.select(end(F.col("id"), F.col("scientific_name"), F.lit(""), F.lit("scientific name")))
    names.union(ranked.select(end(F.col("id"), F.lit("other"), F.lit(""), F.lit("synonym")))).write.text(f"{path}/names")
    taxa, ranks = files.read_taxonomy(spark, f"{path}/nodes", f"{path}/names")
    back = taxonomy.ranked(taxa, ranks)  # ranks get numbers of their own
    return back.drop("rank_id").join(F.broadcast(views.ranks(spark).select(F.col("id").alias("rank_id"), F.col("name").alias("rank"))), "rank").select("id", "parent_id", "scientific_name", "rank_id", "rank")


@query("q_masses_file", f"{BASE} select distinct mass // 1000 as mass from digest")
def _(spark, sf_dir):
    """Masses as text in Dalton, read again, in millionths of a Dalton."""
    path = scratch(spark, "masses")
    masses = digested(spark, sf_dir).select("mass").distinct()
    masses.select(F.format_string("%d.%09d5", F.expr("mass div 1000000000"), F.expr("mass % 1000000000")).alias("value")).write.text(path)
    return files.read_masses(spark, path).select(F.expr("mass div 1000").alias("mass")).distinct()


STORED = Protease("trypsin", 6, 50, 0)


_BUILDS: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> Engine:
    """A whole build on disk, opened again; made once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILDS:
        path = scratch(spark, "build")
        # small ranges and blocks, so that small tables have many
        store.write(path, views.proteins(spark, sf_dir), views.taxa(spark, sf_dir), views.ranks(spark), STORED, range_rows=1000, block_rows=50)
        _BUILDS[key] = path
    return Engine.opened(spark, _BUILDS[key])


#: 500 masses, four Dalton apart.
FAR_APART = [chem.to_int(650.3 + 4.002 * k) for k in range(500)]
STORED_PEPTIDES = f"{views.digest_sql(STORED)},\n{views.PEPTIDES_SQL}"
FAR_SQL = f"{conditions_sql(FAR_APART, [OXIDATION], PPM, 1)}, found as (select distinct x.* from peptides x join conds c on {tests_sql([OXIDATION])})"
BELOW_SQL = f"{views.TAXA_SQL}, below as (select id from taxa where id = 101 union select t.id from taxa t join below b on t.parent_id = b.id)"


@query("q_search_stored", f"{STORED_PEPTIDES}, {FAR_SQL} select {SHOWN} from found")
def _(spark, sf_dir):
    """500 masses in a stored build: only the mass ranges that their windows meet are read."""
    return stored(spark, sf_dir).search_plan(Plan.of(FAR_APART, [OXIDATION], PPM, 1), resolve=False).select("mass", "sequence", joined("protein_ids"))


@query("q_search_stored_taxa", f"{STORED_PEPTIDES}, {FAR_SQL}, {BELOW_SQL} select {SHOWN} from found where list_has_any(list_concat(unique_taxonomy_ids, non_unique_taxonomy_ids), (select list(cast(id as int)) from below where id >= 1000))")
def _(spark, sf_dir):
    """The same in the species below a taxon: a range of the stored tree, then a bitmap."""
    e = stored(spark, sf_dir)
    return e.search_plan(Plan.of(FAR_APART, [OXIDATION], PPM, 1), e.sub_species(101), resolve=False).select("mass", "sequence", joined("protein_ids"))


@query("q_protein_search_stored", ORACLES["q_protein_search"])
def _(spark, sf_dir):
    """By trigrams of the stored names; only blocks of proteins with a candidate are read."""
    return shallow(stored(spark, sf_dir).search_proteins("d12", "SRC1 "))


@query("q_taxa_nested", f"{TREE}, paths as (select id, [id] as path from taxa where id = parent_id union all select t.id, list_append(p.path, t.id) from taxa t join paths p on t.parent_id = p.id where t.id <> t.parent_id), walk as (select id, path, row_number() over (order by path) - 1 as first from paths) select w.id, w.first, w.first + (select count(*) from paths p where list_contains(p.path, w.id)) - 1 as last from walk w")
def _(spark, sf_dir):
    return taxonomy.nested(views.taxa(spark, sf_dir)).select("id", "first", "last")


@query("q_build_stored", f"{views.digest_sql(STORED)},\n{views.PEPTIDES_SQL} select {SHOWN}, is_swiss_prot from peptides")
def _(spark, sf_dir):
    return stored(spark, sf_dir).peptides.select("mass", "sequence", joined("protein_ids"), "is_swiss_prot")


@query(
    "q_build_stats",
    f"""{views.digest_sql(STORED)},\n{views.PEPTIDES_SQL} select 'proteins' as key, (select count(*) from proteins) as value union all select 'peptides', (select count(*) from peptides) union all select 'masses', (select count(distinct mass) from peptides)
    union all select 'protein_bytes', (select cast(sum(9 + (16 + 5 * length(sequence) + 7) // 8 + strlen(accession) + coalesce(list_sum(list_transform(genes, lambda g: strlen(g))), 0)) as bigint) from proteins)
    union all select 'peptide_bytes', (select cast(sum(16 + (5 * length(sequence) + 6 + 7) // 8 + 26 + 4 * (len(protein_ids) + len(unique_taxonomy_ids) + len(non_unique_taxonomy_ids)) + 1) as bigint) from peptides)""",
)
def _(spark, sf_dir):
    return spark.createDataFrame(sorted(store.read_stats(spark, stored(spark, sf_dir).path).items()), "key string, value long")


@query("q_build_faults", f"{views.digest_sql(STORED)},\n{views.PEPTIDES_SQL} select 'associations' as kind, (select count(*) from (select unnest(protein_ids) as id from peptides) where id % 10 = 3) as n union all select 'orphans', 0 union all select 'overlaps', 0 union all select 'unassigned', 0")
def _(spark, sf_dir):
    """Every tenth protein is taken out of an opened build: its peptides' associations are missing."""
    e = stored(spark, sf_dir)
    e.proteins = e.proteins.where("id % 10 <> 3")
    return spark.createDataFrame([(k, v.count()) for k, v in sorted(e.faults().items())], "kind string, n long")
