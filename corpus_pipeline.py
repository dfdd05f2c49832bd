"""From raw documents to packed token sequences, in five stages; each is written and read again.

1. toxicity: documents that the classifier, trained on the labels of documents that are not held out, scores 0.5
   or higher go.
2. near-duplicates: of each group whose word shingles overlap by 75 % or more, directly or through others, the
   document with the smallest doc_id stays.
3. repeats: characters that repeated strings of PASSAGE bytes cover are cut from the texts, where such a run has over
   WORDS words or 400 bytes; documents stay.
4. secrets: spans of secrets are replaced by a mark; documents stay.
5. packing: the texts become token sequences of at most 4096 ids.

Cases: a null text is empty to every stage, one under PASSAGE bytes is never cut, and a document that is cut or redacted
to nothing stays as an empty text; rows with a null doc_id stay until packing; repeated rows and equal texts with different
doc_ids leave the smallest doc_id; rows that share a doc_id stand or fall together; further columns, whatever their names,
are carried to packing, which returns its own columns; an empty table gives an empty result.

SQL can express none of the models, so ORACLE_SQL is None; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid.llm import ngram_join, packing, repeats, secrets, toxicity
from massgrid.llm.common import saved

TOKENIZER = "word_bpe_49k.json"
#: Bytes of the shortest repeat that is looked for: over 50 words, at four bytes for a short word and its space.
PASSAGE = 200
WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = repeats.without_repeats(docs, tuple(others), as_text=True, length=PASSAGE, words=WORDS)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return kept.select(*(new.get(c, F.col(f"carried.`{c}`")) for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.cleaned(docs, secrets.Model.trained(secrets.samples(spark)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("secrets", redact_secrets), ("packing", pack_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
