"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums and Cauchy-Schwarz residual bounds.

1. Vectors become integers, floor(256 * x), and are dealt into bands by length, the longest first, and each band into
   blocks of about BLOCK rows. Within a block they stand by descending length.
2. Every query meets the first block, the longest vectors. Its k-th best score there is its floor.
3. A block of queries then meets the blocks of those bands whose greatest length, times the length of any of the
   queries, reaches that query's floor; the bands beyond are skipped whole. The floors travel with the queries. Blocks meet
   in cells: consecutive blocks of candidates and blocks of queries, CELL bytes of each at most. A block is sent once for
   each cell it is in, not for each block it meets, and no block goes through the driver but the first one. In a cell the
   longest vectors come first, and what they find raises the floors for the others.
4. Where two blocks meet, both sides are rotated by the right singular vectors of a sample of the vectors. Tile by tile,
   the inner product over the leading components plus the product of the lengths of the rests bounds the score; the
   bound is taken after two, four, five, six and seven eighths of the components, and pairs below the query's floor,
   which rises with what is found, go. Only pairs that are left get the exact integer product.
5. The k best of all cells are taken by query.

The sample for the rotation has about SAMPLE vectors, chosen by a hash of the id; it changes how much is pruned, never a
result. The driver gets that sample, a row for each of at most BANDS bands and, to broadcast it, the first block.

Cases: null vectors, those that hold a null or non-finite component, and rows without an id take no part; equal
scores go to the smaller id; queries with fewer candidates return all; vectors of unequal length count as padded
with zeros; rows that repeat a query's id make one query (the least vector) and are no candidates of it; an empty
table gives an empty result; other columns are ignored, whatever their names. Scores must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massgrid.llm.bytesops import gather_ranges
from massgrid.llm.common import saved

BLOCK = 2048
BANDS = 512
TILE = 256
SAMPLE = 4096
#: Bytes of the candidates, and of the queries, that meet in a cell, and how many cells candidates are split into below that.
CELL, CELLS = 16 << 20, 64
#: Eighths of the components after which the bound is taken, and the share of a tile's pairs under which they go on one by one.
EIGHTHS, FEW = (2, 4, 5, 6, 7), 1 / 32
LEAST = np.iinfo(np.int64).min
LAST_ID = np.iinfo(np.int64).max


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, q array<long>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(~bad).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256).cast("long")).alias("q"))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded to `width`, in the smallest integers that hold them."""
    column = lists.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets, np.int64))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    top = int(np.abs(out).max(initial=0))
    return out.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _packed(width: int, floors: bool):
    def run(table: pa.Table) -> pa.Table:
        """The rows of a block by descending length, as one row. need: a vector under this length is below all floors."""
        ids, q = table["vec_id"].to_numpy(), _matrix(table["q"], width)
        length = np.sqrt((q.astype(float) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        columns = [pa.array([table["block"][0].as_py()], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([q[order].tobytes()], pa.binary())]
        if floors:
            floor = table["floor"].fill_null(LEAST).to_numpy()
            need = np.where(floor > 0, floor / np.maximum(length, 1e-9), -np.inf).min()
            columns += [pa.array([floor[order].tobytes()], pa.binary()), pa.array([need], pa.float64())]
        return pa.table(columns, names=["block", "ids", "q", "floor", "need"][: len(columns)])

    return run


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample by descending singular value, as columns."""
    return np.linalg.svd(sample.T @ sample)[0]


class Found:
    """The k best of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.known = k, floor
        self.top, self.who = np.full((queries, k), LEAST), np.full((queries, k), LAST_ID)

    def floor(self) -> np.ndarray:
        """A score below it is among no query's k best."""
        return np.maximum(self.known, self.top[:, -1])

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        rows = np.unique(query)
        have = np.repeat(rows, self.k)
        q, s, n = np.concatenate([have, query]), np.concatenate([self.top[rows].ravel(), score]), np.concatenate([self.who[rows].ravel(), name])
        order = np.lexsort((n, -1 - s, q))  # -1 - s instead of -s, which has no value for LEAST
        _, start, count = np.unique(q[order], return_index=True, return_counts=True)
        best = order[gather_ranges(start, np.minimum(count, self.k))].reshape(len(rows), self.k)
        self.top[rows], self.who[rows] = s[best], n[best]


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of each query's k best candidates not below its floor, LEAST where there are fewer; and how many products were exact.

    vectors: by descending length.
    """
    d = queries.shape[1]
    rq, rv = queries @ axes, vectors @ axes
    cuts = [max(1, d * e // 8) for e in EIGHTHS]
    rest_q, rest_v = ([np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts] for x in (rq, rv))
    len_q, len_v = (np.sqrt((x**2).sum(1)) for x in (rq, rv))
    slack = 1e-9 * len_q * len_v.max(initial=0) + 1e-6  # the rotation is rounded, the scores are not
    found, products = Found(len(queries), k, floor), 0
    i, end, tile = 0, 0, 4 * k
    while end < len(vectors):  # tiles grow, so that floors come early
        i, end, tile = end, end + tile, min(TILE, 2 * tile)
        least = found.floor().astype(float) - slack
        live = np.flatnonzero(len_q * len_v[i] >= least)
        if not len(live):
            break  # nor do the shorter vectors reach a floor
        keep = query_ids[live, None] != ids[None, i:end]
        partial, done = np.zeros(keep.shape), 0
        steps = list(zip(cuts, rest_q, rest_v, strict=True))
        while steps:
            c, a, b = steps.pop(0)
            partial += rq[live, done:c] @ rv[i:end, done:c].T
            keep &= partial + a[live, None] * b[None, i:end] >= least[live, None]
            done = c
            if keep.mean() < FEW:
                break
        x, y = np.nonzero(keep)
        part, x, y = partial[x, y], live[x], y + i
        for c, a, b in steps:
            part = part + np.einsum("ij,ij->i", rq[x, done:c], rv[y, done:c])
            near = part + a[x] * b[y] >= least[x]
            part, x, y, done = part[near], x[near], y[near], c
        if len(x):
            products += len(x)
            score = np.einsum("ij,ij->i", queries[x].astype(np.int64), vectors[y].astype(np.int64))
            good = score >= found.floor()[x]
            found.add(x[good], score[good], ids[y[good]])
    return found.top, found.who, products


MEETING = "query_id long, vec_id long, score long"


def _unpacked(ids: pa.Scalar, data: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a packed block."""
    names, q = np.frombuffer(ids.as_py(), np.int64), data.as_py()
    size = len(q) // max(1, len(names) * width)
    return names, np.frombuffer(q, {2: np.int16, 4: np.int32, 8: np.int64}[size]).reshape(len(names), -1)


def _found(query_ids: np.ndarray, top: np.ndarray, who: np.ndarray) -> list[pa.Array]:
    at = np.nonzero(top != LEAST)
    return [pa.array(query_ids[at[0]]), pa.array(who[at]), pa.array(top[at])]


def _search(k: int, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, q, floor, ci, c in zip(*(batch.column(n) for n in ("query_ids", "query_q", "floor", "ids", "q")), strict=True):
                (query_ids, queries), (ids, vectors) = _unpacked(qi, q, len(axes)), _unpacked(ci, c, len(axes))
                top, who, _ = best_of_block(query_ids, queries, np.frombuffer(floor.as_py(), np.int64), ids, vectors, axes, k)
                yield pa.RecordBatch.from_arrays(_found(query_ids, top, who), names=["query_id", "vec_id", "score"])

    return run


def _search_cell(k: int, axes: np.ndarray):
    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        """Each block of queries against the cell's blocks up to the last one that it wants, the longest vectors first."""
        numbers, parts = blocks["block"].to_numpy(), []
        for qi, q, known, wanted in zip(*(asked[n] for n in ("query_ids", "query_q", "floor", "wanted")), strict=True):
            query_ids, queries = _unpacked(qi, q, len(axes))
            best = Found(len(query_ids), k, np.frombuffer(known.as_py(), np.int64))
            for b in np.argsort(numbers):
                if numbers[b] > wanted.as_py():
                    break
                top, who, _ = best_of_block(query_ids, queries, best.floor(), *_unpacked(blocks["ids"][b], blocks["q"][b], len(axes)), axes, k)
                x, y = np.nonzero(top != LEAST)
                if len(x):
                    best.add(x, top[x, y], who[x, y])
            parts.append(pa.table(_found(query_ids, best.top, best.who), names=["query_id", "vec_id", "score"]))
        empty = [pa.array([], pa.int64())] * 3
        return pa.concat_tables(parts or [pa.table(empty, names=["query_id", "vec_id", "score"])])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _per_row(values: list, at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), at)


def bands_of(vectors: DataFrame, rows: int) -> tuple[DataFrame, list[float], list[int]]:
    """(vectors with their block, greatest length of each band, last block of each band); bands by descending length."""
    wanted = max(1, min(BANDS, math.ceil(rows / BLOCK)))
    cuts = sorted(set(vectors.approxQuantile("length", [i / wanted for i in range(1, wanted)], 0.1 / wanted)), reverse=True) if wanted > 1 else []
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("length"))) if cuts else F.lit(0)
    banded = vectors.withColumn("band", above)
    held = sorted(banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect())  # a row for each band
    place = {r.band: i for i, r in enumerate(held)}
    parts = [math.ceil(r.n / BLOCK) for r in held]
    last = np.cumsum(parts).tolist()
    number = _per_row([place.get(b, 0) + 1 for b in range(max(place) + 1)], F.col("band") + 1)
    own = F.pmod(F.xxhash64("vec_id", F.to_json("q")), _per_row(parts, F.col("number")))
    block = own + _per_row([0, *last[:-1]], F.col("number"))
    return banded.withColumn("number", number).withColumn("block", block.cast("long")), [r.top for r in held], last


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as integer_vectors returns them."""
    spark = candidates.sparkSession
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    vectors = saved(candidates.withColumn("length", length), "vectors")
    asked = saved(queries.groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    n, width = vectors.agg(F.count("*"), F.max(F.size("q"))).first()
    n_q, width_q = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    if not n or not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width, width_q)
    share = min(1 << 20, (SAMPLE << 20) // n + 1)
    sample = vectors.where(F.pmod(F.xxhash64(F.lit("axes"), "vec_id"), F.lit(1 << 20)) < share).select("q").toArrow()
    axes = rotation(_matrix(sample["q"], width).astype(float))

    banded, tops, last = bands_of(vectors, n)
    blocks = saved(banded.select("block", "vec_id", "q").groupBy("block").applyInArrow(_packed(width, False), "block long, ids binary, q binary"), "blocks")

    def dealt(rows: DataFrame) -> DataFrame:
        dealt_ = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(math.ceil(n_q / BLOCK))))
        packed = dealt_.groupBy("block").applyInArrow(_packed(width, True), "block long, ids binary, q binary, floor binary, need double")
        return packed.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("q").alias("query_q"), "floor", "need")

    longest = F.broadcast(blocks.where("block = 0").select("ids", "q"))  # one row of about BLOCK vectors
    met = dealt(asked.withColumn("floor", F.lit(None).cast("long"))).crossJoin(longest).select("query_ids", "query_q", "floor", "ids", "q")
    first = saved(_best(met.mapInArrow(_search(k, axes), MEETING), k), "first-block")
    if last[-1] == 1:
        return first
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    with_floors = saved(dealt(asked.join(floors, "vec_id", "left")), "query-blocks")
    reached = F.size(F.filter(F.array(*map(F.lit, tops)), lambda t: t * (1 + 1e-9) + 1e-6 >= F.col("need")))
    wanted = F.when(reached > 0, _per_row(last, F.greatest(reached, F.lit(1)))).otherwise(0).cast("long") - 1

    most = max(1, CELL // (BLOCK * (2 * width + 8)))  # components mostly take two bytes
    side, groups = min(most, math.ceil(last[-1] / CELLS)), math.ceil(math.ceil(n_q / BLOCK) / most)
    asking = with_floors.withColumn("wanted", wanted).where("wanted >= 1")
    furthest = asking.agg(F.max("wanted")).first()[0] or 0
    group = F.floor(F.col("query_block") / most).cast("long").alias("group")
    asking = asking.select("query_ids", "query_q", "floor", "wanted", group, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("wanted") - 1) / side).cast("long"))).alias("part"))
    others = blocks.where(F.col("block").between(1, furthest)).withColumn("part", F.floor((F.col("block") - 1) / side).cast("long"))
    others = others.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    cells = asking.groupBy("group", "part").cogroup(others.groupBy("group", "part")).applyInArrow(_search_cell(k, axes), MEETING)
    return _best(first.drop("rank").union(cells), k)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the 5 highest inner products of every vector whose id is divisible by 50."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
