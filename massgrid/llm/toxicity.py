"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-case words, pairs of neighbours and pairs with one word between, hashed to
2**BITS places; each counts once in a text. Per-coordinate learning rates and the L1 term leave few weights other than zero, and
only these are broadcast: at most 2**BITS, whatever the size of the corpus.

The classifier is fitted on a bounded sample of labelled rows: `max_rows` or `max_bytes` in expectation, chosen by a hash of the
doc_id among those whose crc32(doc_id as text) mod 5 is not 0. Everything else covers all rows and is narrow.

Cases: a null or empty text has no features and gets the base rate's score; rows with a null label or doc_id are
not learned from; without any labelled row all scores are 0; repeated labels count each; an empty table gives an empty
result; very long texts are scored whole, and a sample with such gets fewer rows; ties in the order of learning go by
doc_id and label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massgrid.llm.bpe import blocks
from massgrid.llm.bytesops import PUNCTUATION, U64, mix, text_bytes, word_hashes, words
from massgrid.llm.common import lean, removed, saved, shared_folder, text_rows

BITS = 20
BLOCK_BYTES = 4 << 20


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, offsets): for every text the places of its words, then of its pairs and skip-grams, as they come."""
    start, end, first = words(raw, offsets, PUNCTUATION)
    h = word_hashes(raw, start, end, 5)
    count = np.diff(first)
    left = np.repeat(first[1:], count) - np.arange(len(h))
    out = np.empty((len(h), 3), np.int64)
    out[:, 0] = h >> U64(64 - BITS)
    for gap in (1, 2):
        near = np.zeros(len(h), U64)
        near[: len(h) - gap] = h[gap:] if len(h) > gap else near[: len(h) - gap]
        out[:, gap] = np.where(left > gap, (mix(h * U64(0x9E3779B97F4A7C15) + near * U64(2 * gap + 1)) >> U64(64 - BITS)).astype(np.int64), -1)
    return out, first


class Ftrl:
    """Follow the regularised leader, with a learning rate for each coordinate; place 2**BITS is the constant."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _fit(passes: int):
    def run(table: pa.Table) -> pa.Table:
        """The weights that are not zero, after `passes` over the sample in the order of a hash."""
        table = table.combine_chunks()
        raw, offsets = text_bytes(table["text"])
        rows = []
        for i, j in blocks(offsets, BLOCK_BYTES):
            found, first = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                at = np.unique(found[first[k] : first[k + 1]])
                rows.append(np.append(at[at >= 0], 1 << BITS).astype(np.int32))
        labels = table["toxic"].to_pylist()
        order = np.lexsort((table["toxic"].to_numpy(), table["doc_id"].to_numpy(), mix(table["doc_id"].to_numpy().astype(U64))))
        model = Ftrl()
        for _ in range(passes):
            for i in order:
                model.learn(rows[i], labels[i])
        at = np.flatnonzero(model.weights(slice(None)))
        return pa.table([pa.array(at), pa.array(model.weights(at))], names=["place", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, passes: int = 4, max_bytes: int = 1 << 28) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), learned from about max_rows labelled documents, or max_bytes of text, that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    drawn = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20))
    limit = int(min(1.0, max_rows / max(1, known.count())) * (1 << 20))
    sample = known.where(drawn < limit)
    folder = shared_folder(docs.sparkSession, "labelled")
    texts = saved(text_rows(docs).join(F.broadcast(sample), "doc_id"), "texts", folder)  # max_rows bounds what is broadcast
    size = texts.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    rows = texts.where(drawn < int(limit * min(1.0, max_bytes / max(1.0, size)))).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fit(passes), "place long, weight double").collect()
    removed(folder)
    return np.array([r.place for r in rows], np.int64), np.array([r.weight for r in rows], float)


def _scores(text: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    weight = np.zeros((1 << BITS) + 1, np.float32)
    weight[model[0]] = model[1]
    base = float(weight[-1]) if len(model[0]) else -np.inf
    weight[-1] = 0  # place -1: no feature
    raw, offsets = text_bytes(text)
    out = np.empty(len(text))
    for i, j in blocks(offsets, BLOCK_BYTES):
        found, first = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        row, column = np.nonzero(weight[found])  # few; once in each text
        owner = np.searchsorted(first, row, side="right") - 1
        once = np.unique((owner << BITS) | found[row, column])
        x = base + np.bincount(once >> BITS, weight[once & ((1 << BITS) - 1)], minlength=j - i)
        out[i:j] = np.round(1 / (1 + np.exp(-np.clip(x, -500, 35))), 9)
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), sent.value))], names=["doc_id", "score"])

    return text_rows(docs).mapInArrow(lean(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), sent.value) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, train(docs, labels, max_rows))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: toxicity of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
