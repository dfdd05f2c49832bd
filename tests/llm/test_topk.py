import math
import random

import numpy as np

from massgrid.llm import topk


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = random.Random(4)
    common = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, common if i % 3 == 0 else [rng.gauss(0, 0.1 + i % 7) for _ in range(12)]) for i in range(500)]
    rows += [(700, None), (750, [float("nan")] * 12), (800, [1.0, None]), (None, common), (850, [float("inf")]), (900, [0.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(table)
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    assert got == brute(rows)


def meet(vectors, queries, k=5):
    """One block of queries against vectors in blocks of 200 by descending length; (scores, ids, products)."""
    vectors = vectors[np.argsort(-np.linalg.norm(vectors, axis=1))]
    ids, axes = np.arange(len(vectors)) + 1000, topk.rotation(vectors.astype(float))
    names = np.arange(len(queries))
    floor, products, best = np.full(len(queries), topk.LEAST), 0, topk.Found(len(queries), k, np.full(len(queries), topk.LEAST))
    for i in range(0, len(vectors), 200):
        top, who, n = topk.best_of_block(names, queries, floor, ids[i : i + 200], vectors[i : i + 200], axes, k)
        q, c = np.nonzero(top != topk.LEAST)
        if len(q):
            best.add(q, top[q, c], who[q, c])
        floor, products = best.floor(), products + n
    exact = queries @ vectors.T
    for q in range(len(queries)):
        order = np.lexsort((ids, -exact[q]))[:k]
        assert best.top[q].tolist() == exact[q][order].tolist() and best.who[q].tolist() == ids[order].tolist()
    return products / exact.size


def test_few_exact_products():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    whole = lambda x: np.floor(256 * x).astype(np.int64)
    assert meet(whole(unit), whole(unit[:100])) < 0.25  # equal lengths in all directions: the hardest case
    skewed = unit * np.exp(rng.normal(size=(2000, 1)))
    assert meet(whole(skewed), whole(unit[:100])) < 0.05
    flat = unit * 0.9 ** np.arange(64)
    assert meet(whole(flat), whole(flat[:100])) < 0.05
    assert meet(np.zeros((300, 8), np.int64), whole(unit[:10, :8])) <= 1  # ties throughout


def test_bands_beyond_the_floors_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 20 if i < 60 else 0.01) for _ in range(6)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(table)
    met = []
    search = topk._search
    monkeypatch.setattr(topk, "_search", lambda k, axes: met.append(1) or search(k, axes))
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    assert got == brute(rows)
    length = topk.F.sqrt(topk.F.aggregate("q", topk.F.lit(0.0), lambda a, x: a + x * x))
    banded, tops, last = topk.bands_of(vectors.withColumn("length", length), 600)
    assert tops == sorted(tops, reverse=True) and last[-1] >= 12
    assert banded.groupBy("number").agg(topk.F.max("length").alias("t")).orderBy("number").toPandas()["t"].tolist() == tops


def test_blocks_meet_in_cells_and_not_in_the_driver(spark, monkeypatch):
    """Queries are never broadcast with the candidates that they meet; few large cells, and many small ones of both."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + i % 5) for _ in range(8)]) for i in range(2000)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    monkeypatch.setattr(topk, "BLOCK", 16)
    for cell, cells in ((1 << 20, 4), (2 * 16 * 24, 4)):  # a quarter of the blocks with all queries; two blocks with two
        monkeypatch.setattr(topk, "CELL", cell, raising=False)
        monkeypatch.setattr(topk, "CELLS", cells, raising=False)
        found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))
        assert sorted(map(tuple, found.collect())) == brute(rows)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_columns_with_other_names(spark):
    """Columns that the operator names itself, too."""
    rows = [(i, [float(i % 7), 1.0], "x", 1, 2, 3.0, "b") for i in range(101)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string, block long, rank int, length double, ids string")
    vectors = topk.integer_vectors(table)
    assert sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect())) == brute([r[:2] for r in rows])


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(table)
    assert sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id = 0")).collect())) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    none = vectors.where("false")
    assert topk.top_k(none, none).count() == 0
