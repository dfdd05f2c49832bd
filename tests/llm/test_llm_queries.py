"""Each query over the small tables, against its SQL where it has one; and the pipeline's stages."""

import numpy as np
import pytest
from helpers import SMALL, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from massgrid.llm import queries, secrets, toxicity
from test_ngram_join import brute as groups
from test_repeats import covered


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == before.columns
    before, after = kept["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(before, model).where("score < 0.5").collect()}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept["near-duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {k for k, _, c in groups(rows) if c == k}
    before, after = kept["repeats"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    left = {r.doc_id: r.text for r in after.collect()}
    for (k, text), gone in zip(rows, covered([t for _, t in rows], corpus_pipeline.PASSAGE)):
        raw, runs = text.encode(), np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        for a, b in runs.reshape(-1, 2):
            gone[a:b] = b - a >= 400 or len(raw[a:b].split()) > corpus_pipeline.WORDS
        ends = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert left[k] == "".join(c for c, a, b in zip(text, ends, ends[1:]) if not gone[a:b].all())
    before, after = kept["secrets"]
    again = secrets.scan(after, secrets.Model.trained(secrets.samples(spark)))
    assert after.count() == before.count() and again.where("size(base) > 0").count() == 0
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()
    assert corpus_pipeline.run(spark, SMALL).count() == after.count()


def through(spark, docs, tmp_path):
    """The kept rows after each stage, with the labels of the small tables."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs
    return out


def test_pipeline_of_nothing(spark, empty, tmp_path):
    for name, docs in through(spark, empty, tmp_path).items():
        assert docs.isEmpty()
        assert name == "packing" or docs.columns == empty.columns


def test_pipeline_of_odd_rows(spark, table, odd_texts, tmp_path):
    """Null and empty texts, repeated rows, a null doc_id, and columns that the stages name themselves."""
    docs = table([*odd_texts, "password = hunter2hunter2 " + "word " * 8, ""])
    nameless = docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.union(docs.where("doc_id = 6")).union(nameless)
    stages = through(spark, docs, tmp_path)
    assert stages["secrets"].columns == docs.columns
    kept = {(r.doc_id, r.text) for r in stages["near-duplicates"].collect()}
    assert {k for k, _ in kept} == {0, 1, 2, 3, 4, 6, 7, 8, 10, 11, 12, None}  # 5 repeats 4, and 9 nearly does
    left = {r.doc_id: r for r in stages["secrets"].collect()}
    assert left[11].text.startswith("[SECRET] word") and left[11].n_chars == len(left[11].text) and left[4].k == 1
    assert left[0].text in (None, "") and left[12].text == ""
    ids = {r.doc_id: 0 for r in stages["packing"].collect()}
    assert set(ids) == set(left)
