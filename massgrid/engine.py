"""The engine's functions: what its service and command line offer, each as a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid.functions.chemistry import amino_acids, mass_of, windows_of
from massgrid.functions.display import search_payload
from massgrid.functions.hydrophobicity import score
from massgrid.operators import build, layout, search, targets, taxonomy
from massgrid.operators.digest import Protease, digest
from massgrid.plans.ptm import Plan, Ptm
from massgrid.sources import store
from massgrid.sources.files import fasta, mass_from, orphans, write_text


@dataclass
class Engine:
    """Tables of one build. peptides may be the stored table or the plan that makes it; a derived one is made anew by each
    function that needs it, and only as far as that needs it.

    A stored build also has its peptides by mass range, its proteins by block, and the tables that prune them.
    """

    spark: SparkSession
    proteins: DataFrame
    peptides: DataFrame
    taxa: DataFrame
    ranks: DataFrame
    protease: Protease = Protease()
    path: str | None = None
    ranged: DataFrame | None = None
    blocked: DataFrame | None = None
    ranges: DataFrame | None = None
    grams: DataFrame | None = None
    is_derived: bool = False

    @classmethod
    def derived(cls, spark: SparkSession, proteins: DataFrame, taxa: DataFrame, ranks: DataFrame, protease: Protease = Protease()) -> Engine:
        """Nothing is stored: peptides are the plan that makes them."""
        made = build.aggregate(digest(proteins.select("id", "sequence", "taxonomy_id", "is_reviewed"), protease))
        return cls(spark, proteins, made, taxa, ranks, protease, is_derived=True)

    def _digested(self, masses: list[tuple[int, int]] | None = None) -> DataFrame:
        return digest(self.proteins.select("id", "sequence", "taxonomy_id", "is_reviewed"), self.protease, masses)

    def _near(self, *sequences: str) -> DataFrame:
        """Peptides that have the mass of one of the sequences; of a derived build only those are made."""
        if self.is_derived:
            return build.aggregate(self._digested(windows_of(*sequences)))
        return self.peptides.where(F.col("mass").isin([mass_of(s) for s in sequences]))

    @classmethod
    def built(cls, spark: SparkSession, proteins: DataFrame, taxa: DataFrame, ranks: DataFrame, protease: Protease = Protease(), path: str | None = None) -> Engine:
        """Digest and aggregate; with a path the peptide table is stored there, sorted by mass, and read again."""
        table = build.peptides(proteins, protease)
        if path:
            build.write_peptides(table, path)
            table = spark.read.parquet(path)
        return cls(spark, proteins, table, taxa, ranks, protease)

    @classmethod
    def stored(cls, path: str, proteins: DataFrame, taxa: DataFrame, ranks: DataFrame, protease: Protease = Protease(), comment: str = "", range_rows: int = store.RANGE_ROWS, block_rows: int = layout.BLOCK) -> Engine:
        """Make a whole build under a path, and open it."""
        store.write(path, proteins, taxa, ranks, protease, comment, range_rows, block_rows)
        return cls.opened(proteins.sparkSession, path)

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Engine:
        """A stored build."""
        tables, config = store.read(spark, path)
        proteins, peptides = tables["proteins"].drop("block"), tables["peptides"].drop("partition")
        return cls(spark, proteins, peptides, tables["taxa"], tables["ranks"], config["protease"], path, tables["peptides"], tables["proteins"], tables["ranges"], tables["grams"])

    def configuration(self) -> dict:
        """Version, comment, protease and mass ranges of a stored build."""
        if self.path is None:
            raise ValueError("this build is not stored")
        return store.read(self.spark, self.path)[1]

    def faults(self) -> dict[str, DataFrame]:
        """What is wrong with a build, by kind; all are empty if it is sound: ranges that overlap, masses that no range
        holds, protein ids without a protein, taxa without a parent.
        """
        ranges = self.spark.createDataFrame([(i, *r) for i, r in enumerate(self.configuration()["partitions"])], "partition long, lo long, hi long, n long")
        return {
            "overlaps": build.tiling_faults(ranges),
            "unassigned": build.unassigned(self.peptides, ranges),
            "associations": store.missing_associations(self.proteins, self.peptides),
            "orphans": orphans(self.taxa),
        }

    def peptide(self, sequence: str) -> DataFrame:
        """The peptide, and its proteins as a list of structs."""
        found = search.lookup(self._near(sequence), sequence, mass_of(sequence))
        owners = search.proteins_of(found, self.proteins).groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("id", "accession", "taxonomy_id", "is_reviewed", "genes"))).alias("proteins"))
        return found.join(owners, "sequence", "left")

    def peptide_exists(self, sequence: str) -> bool:
        return not search.lookup(self._near(sequence), sequence, mass_of(sequence)).isEmpty()

    def peptides_exist(self, *sequences: str) -> DataFrame:
        """(sequence, found) of each different sequence, in one job; of a derived build no list of proteins is made."""
        rows = self._digested(windows_of(*sequences)) if self.is_derived else self._near(*sequences)
        there = rows.where(F.col("sequence").isin(list(sequences))).select("sequence", F.lit(True).alias("found")).distinct()
        asked = self.spark.createDataFrame([(s,) for s in dict.fromkeys(sequences)], "sequence string")
        return asked.join(there, "sequence", "left").select("sequence", F.coalesce("found", F.lit(False)).alias("found"))

    def search(self, masses, ptms: list[Ptm] = (), ppm: tuple[int, int] = (10, 10), most_variable: int = 3, taxa: list[int] | None = None, is_reviewed: bool | None = None, resolve: bool = True, distinct: bool = True, expand_taxa: bool = True) -> DataFrame:
        """One mass or many: Dalton, or (m/z, charge). Taxa stand for the species below them unless told otherwise."""
        many = masses if isinstance(masses, list) else [masses]
        plan = Plan.of([mass_from(m) for m in many], ptms, ppm, most_variable, self.protease.shortest)
        if taxa is not None and expand_taxa:
            taxa = taxonomy.species(self.taxa, self.ranks, taxa)
        return self.search_plan(plan, taxa, is_reviewed, resolve, distinct)

    def search_plan(self, plan: Plan, taxa: DataFrame | list[int] | None = None, is_reviewed: bool | None = None, resolve: bool = True, distinct: bool = True) -> DataFrame:
        """The same for a plan; a stored build reads only the mass ranges that its windows and the taxa need."""
        return search.search(self.peptides if self.ranged is None else self.ranged, plan, taxa, is_reviewed, resolve, distinct, self.ranges)

    def search_url(self, payload: str) -> DataFrame:
        """A search whose arguments stand in a URL: mass or masses, modifications, tolerances, taxa, review status."""
        asked = search_payload(payload)
        ptms = [Ptm.of(p["name"], p["amino_acid"], p["mass_delta"], p["mod_type"], p["position"]) for p in asked.get("modifications", ())]
        ppm = (asked.get("lower_mass_tolerance_ppm", 10), asked.get("upper_mass_tolerance_ppm", 10))
        return self.search(asked["mass"], ptms, ppm, asked.get("max_variable_modifications", 3), asked.get("taxonomy_ids"), asked.get("is_reviewed"), asked.get("resolve_modifications", True))

    def search_to_fasta(self, path: str, masses, with_mass: bool = True, **how) -> None:
        """The search's peptidoforms as FASTA text files under a path."""
        write_text(fasta(self.search(masses, **how), with_mass), path)

    def search_totals(self, masses: list, ptms: list[Ptm] = (), ppm: tuple[int, int] = (10, 10), most_variable: int = 3) -> DataFrame:
        """(query_mass, peptidoforms) of each different mass: counted in one job, without making the peptidoforms."""
        plan = Plan.of(dict.fromkeys(mass_from(m) for m in masses), ptms, ppm, most_variable, self.protease.shortest)
        rows = self.peptides if self.ranged is None else layout.pruned(self.ranged, plan, self.ranges).drop("partition")
        return search.totals(rows, plan)

    def search_performance(self, masses: list, **how) -> DataFrame:
        """(masses, peptidoforms, seconds, longest): one search after another, and their totals; for numbers alone see search_totals."""
        found, took = 0, []
        for mass in masses:
            start = time.perf_counter()
            found += self.search(mass, **how).count()
            took.append(time.perf_counter() - start)
        return self.spark.createDataFrame([(len(masses), found, sum(took), max(took, default=0.0))], "masses long, peptidoforms long, seconds double, longest double")

    def condition_count(self, mass: float, ptms: list[Ptm], most_variable: int = 3) -> int:
        return len(Plan.of([mass_from(mass)], ptms, most_variable=most_variable, shortest=self.protease.shortest).conditions)

    def protein(self, accession: str) -> DataFrame:
        return self.proteins.where(F.col("accession") == accession.upper()).limit(1)

    def protein_peptides(self, accession: str) -> DataFrame:
        """Full records of a protein's peptides by mass; none for a protein without."""
        own = digest(self.protein(accession).select("id", "sequence"), self.protease).select("mass", "sequence")
        if self.is_derived:  # one protein's peptides go to all tasks, so that no other peptide is shuffled
            return build.aggregate(self._digested().join(F.broadcast(own), ["mass", "sequence"], "left_semi")).orderBy("mass", "sequence")
        return self.peptides.join(own, ["mass", "sequence"], "left_semi").orderBy("mass", "sequence")

    def protein_full(self, accession: str) -> DataFrame:
        """The protein with the records of all its peptides, by mass, as a list of structs; an empty list if it has none."""
        mine = self.protein_peptides(accession).agg(F.array_sort(F.collect_list(F.struct("mass", "sequence", "protein_ids", "unique_taxonomy_ids", "non_unique_taxonomy_ids", "is_swiss_prot", "is_trembl"))).alias("peptides"))
        return self.protein(accession).crossJoin(mine)  # one row each

    def protein_range(self, start: int, end: int) -> DataFrame:
        """Proteins with start <= id < end."""
        return self.proteins.where((F.col("id") >= start) & (F.col("id") < end))

    def protein_by_gene(self, gene: str) -> DataFrame:
        return self.proteins.where(F.array_contains("genes", gene))

    def search_proteins(self, *terms: str) -> DataFrame:
        """Proteins by part of an accession or gene; a stored build looks them up by trigrams."""
        if self.grams is None:
            return search.find_proteins(self.proteins, *terms)
        return layout.find_indexed(self.blocked, self.grams, *terms).select(*self.proteins.columns)

    def search_proteins_digested(self, *terms: str) -> DataFrame:
        """The proteins found, reviewed ones first, each with its distinct peptides by mass."""
        found = self.search_proteins(*terms)
        made = digest(found.select("id", "sequence"), self.protease).groupBy("protein_id").agg(F.array_sort(F.collect_list(F.struct("mass", "sequence"))).alias("peptides"))
        listed = found.join(made.withColumnRenamed("protein_id", "id"), "id", "left").withColumn("peptides", F.coalesce("peptides", F.array().cast("array<struct<mass:long,sequence:string>>")))
        return listed.orderBy(F.desc("is_reviewed"), "accession")

    def resolve_protein_ids(self, ids: DataFrame) -> DataFrame:
        return search.resolve(ids, self.proteins, "id", "accession")

    def taxonomy(self, taxon: int) -> DataFrame:
        return taxonomy.by_id(self.taxa, self.ranks, taxon)

    def sub_species(self, *roots: int) -> DataFrame:
        return taxonomy.species(self.taxa, self.ranks, list(roots))

    def search_taxonomies(self, query: str) -> DataFrame:
        return taxonomy.search(self.taxa, self.ranks, query)

    def resolve_taxonomy_ids(self, ids: DataFrame) -> DataFrame:
        return search.resolve(ids, self.taxa, "id", "scientific_name")

    def amino_acids(self) -> DataFrame:
        return amino_acids(self.spark)

    def hydrophobicity(self, sequence: str) -> float:
        return score(sequence)

    def srm_prm_targets(self, accessions: list[str], taxa: list[int], charges: str = "2-3", ptms: list[Ptm] | None = None, most_variable: int = 2) -> DataFrame:
        """Targets of the given proteins that are unique in the species below the taxa."""
        own = self.proteins.where(F.col("accession").isin([a.upper() for a in accessions]))
        species = taxonomy.species(self.taxa, self.ranks, taxa)
        mine = self.peptides.join(digest(own.select("id", "sequence"), self.protease).select("mass", "sequence").distinct(), ["mass", "sequence"], "left_semi")
        return targets.targets(mine, own, species, charges, ptms, most_variable)

    def stats(self) -> DataFrame:
        return build.stats(self.proteins, self.peptides)

    def taxonomy_by_name(self, name: str) -> DataFrame:
        return taxonomy.by_name(self.taxa, self.ranks, name)

    def partition_ranges(self) -> DataFrame:
        return build.partition_ranges(self.peptides)
