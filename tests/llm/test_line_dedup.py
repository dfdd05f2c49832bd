"""Line dedup against plain Python, and the runs themselves."""

import hashlib

import pytest
from pyspark.sql import functions as F

from massgrid.llm import line_dedup as L

UP = {ord(c): c.lower() for c in L.UPPER}


def plain(rows, least=L.LEAST):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows."""
    key = lambda line: line.strip(L.SPACES).translate(UP)
    owner = {}
    for k, text in rows:
        for line in (text or "").split("\n") if k is not None else []:
            owner[key(line)] = min(k, owner.get(key(line), k))
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if k is None or len(key(x)) < least or owner[key(x)] == k]
        yield k, len(lines), len(lines) - len(kept), "\n".join(kept)


def answers(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in frame.collect()), key=repr)


TEXTS = [
    "A common line of all.\nits own first line\n\n\nshort\nshort",
    "a COMMON line of all. \n\t its own second line\nÉtait-ce Écrit ainsi\nshort",
    "  a common line of all.\nÉtait-ce écrit ainsi\nÉTAIT-CE Écrit AINSI\nétait-ce Écrit ainsi\n",
    None,
    "",
    "\n",
    "its own fifth line\nits own fifth line\nits own fifth line",
    "its own fifth line\nits own fifth line\nwith no plain space  \nwith no plain space",
    "ten chars.\nten char.",
    "TEN chars.\nten char.",
    "İstanbul has many cats\ni̇stanbul has many cats",
    "İSTANBUL has many cats\rİstanbul has many cats",
]


@pytest.mark.parametrize("batches", [1, 2, 6, 9])
def test_plain(spark, table, batches):
    docs = table([*TEXTS, *TEXTS[::-1]])
    assert answers(L.dedup(docs, batches)) == sorted(plain([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_odd_rows(spark, table, empty, odd_texts):
    """Long texts, repeated rows, two texts of one doc_id, and rows without one."""
    texts = [*odd_texts, "\n".join(f"line number {i % 700} of a long text" for i in range(30_000)), "line number 7 of a long text\nLINE number 699 of a long text "]
    docs = table(texts)
    docs = docs.union(docs.where("doc_id in (4, 6)")).union(docs.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.where("doc_id = 12").withColumn("doc_id", F.lit(11).cast("long")))
    assert answers(L.dedup(docs)) == sorted(plain([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert L.dedup(empty).isEmpty()


def test_runs_are_levelled_and_disjoint(spark):
    """Eleven batches with three runs to a level: compacted as they come, each key in one run, owned by its first batch."""
    runs, owner = L.LineRuns(spark, fanout=3), {}
    for batch in range(11):
        keys = [(k * k % 97, -k, batch * 10 + k % 3) for k in range(batch, batch + 40)]
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long, doc_id long"))
        for h1, h2, doc_id in keys:
            owner.setdefault((h1, h2), []).append((batch, doc_id))
        assert all(len(level) < 3 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [2, 0, 1]
    rows = runs.owners().collect()
    assert len(rows) == len(owner) and all(r.owner == min(owner[r.h1, r.h2])[1] for r in rows)


def test_runs_are_joined_where_they_lie(spark):
    """The join with a run shuffles the batch once and the run never."""
    runs = L.LineRuns(spark)
    runs.add(spark.createDataFrame([(1, 2, 3)], "h1 long, h2 long, doc_id long"))
    batch = spark.createDataFrame([(1, 2, 4), (5, 6, 4)], "h1 long, h2 long, doc_id long").groupBy(*L.HASHES).agg(F.min("doc_id").alias("owner"))
    fresh = batch.join(runs.runs()[0].hint("merge"), L.HASHES, "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    assert [tuple(r) for r in fresh.collect()] == [(5, 6, 4)]


def test_no_python_on_the_main_path(spark, table):
    plan = L.dedup(table(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digests(spark, table, tmp_path):
    table(TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept_sha256 for r in L.query(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(kept.encode()).hexdigest() for k, _, _, kept in plain(list(enumerate(TEXTS)))}
