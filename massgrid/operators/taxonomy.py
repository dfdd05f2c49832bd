"""The taxonomy tree: lookups, searches and subtrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.shared import written
from massgrid.sources.files import numbered

SPECIES = "species"


def ranked(taxa: DataFrame, ranks: DataFrame) -> DataFrame:
    """Taxa with the names of their ranks, of which there are a few dozen."""
    return taxa.join(F.broadcast(ranks.select(F.col("id").alias("rank_id"), F.col("name").alias("rank"))), "rank_id").select("id", "parent_id", "scientific_name", "rank_id", "rank")


def by_id(taxa: DataFrame, ranks: DataFrame, taxon: int) -> DataFrame:
    return ranked(taxa.where(F.col("id") == taxon), ranks)


def by_name(taxa: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    return ranked(taxa.where(F.col("scientific_name") == name), ranks)


def search(taxa: DataFrame, ranks: DataFrame, query: str) -> DataFrame:
    """By id if the query is a number, else by part of the name in any case; % and _ are wildcards."""
    if query.strip().lstrip("-").isdigit():
        return by_id(taxa, ranks, int(query))
    return ranked(taxa.where(F.col("scientific_name").ilike(f"%{query}%")), ranks)


def root_paths(taxa: DataFrame) -> DataFrame:
    """(id, path): every taxon's ancestors from itself to its root, by pointer jumping.

    Each round joins every taxon with the one its path ends at, so the rounds grow with the logarithm of the depth; each
    is written. A taxon that is its own parent, or whose parent is missing, is a root; taxa that are above themselves are
    refused.
    """
    links = taxa.select("id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")).alias("up"))
    sound = links.join(taxa.select(F.col("id").alias("up"), F.lit(True).alias("there")), "up", "left")
    state = sound.select("id", F.when(F.col("there"), F.col("up")).alias("up"), F.array("id").alias("path"))
    while True:
        state = written(state, "paths")
        left = state.agg(F.count("up").alias("open"), F.coalesce(F.bool_or(F.size("path") > F.size(F.array_distinct("path"))), F.lit(False)).alias("circle")).first()
        if left.circle:
            raise ValueError("a taxon is above itself")
        if not left.open:
            return state.select("id", "path")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("path").alias("more"))
        jumped = state.where("up is not null").join(above, "up").select("id", F.col("further").alias("up"), F.concat("path", "more").alias("path"))
        state = state.where("up is null").unionByName(jumped)  # finished ones have no key to meet on


def nested(taxa: DataFrame) -> DataFrame:
    """Taxa with first and last: their place in a walk of the tree, parents before children, and that of the last taxon
    below them. The walk is the order of the paths from the root, so what is below a taxon is one range.
    """
    paths = root_paths(taxa)
    below = paths.select(F.explode("path").alias("id")).groupBy("id").agg(F.count("*").alias("size"))
    walk = numbered(paths.select("id", F.reverse("path").alias("path")), "path").select("id", F.col("n").alias("first"))
    spans = walk.join(below, "id").select("id", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    return taxa.join(spans, "id")


def within(taxa: DataFrame, roots: list[int]) -> DataFrame:
    """The given taxa and all below them: ranges of the walk where a build has stored it, else by the paths to the root."""
    if "first" not in taxa.columns:
        asked = F.array(*map(F.lit, roots)).cast("array<int>")
        return taxa.join(root_paths(taxa).where(F.arrays_overlap(F.col("path").cast("array<int>"), asked)), "id", "left_semi")
    spans = taxa.where(F.col("id").isin(roots)).select("first", "last").collect()  # one for each root
    return taxa.where(reduce(lambda a, b: a | b, (F.col("first").between(*s) for s in spans), F.lit(False)))


def subtree(taxa: DataFrame, roots: list[int]) -> DataFrame:
    """(id) of the given taxa and all below them."""
    return within(taxa, roots).select("id")


def species(taxa: DataFrame, ranks: DataFrame, roots: list[int]) -> DataFrame:
    """Species in the subtrees of the given taxa; a taxon below the rank of species has none."""
    return ranked(within(taxa, roots), ranks).where(F.col("rank") == SPECIES)
