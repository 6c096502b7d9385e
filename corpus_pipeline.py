"""A corpus pipeline: toxicity filter, exact dedup, near dedup, mixing to target weights, BPE tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads again
for the next one. All but the last return the columns of documents.

Defined cases: what a stage's operator defines for nulls, empty and very long texts, ties and repeated rows holds here too. Rows with a null id or text stay
where their stage keeps them (null and empty texts are not toxic by themselves and equal one another; they hold no words, so the mix takes none of them). Without labels
no document is called toxic. A stage that keeps nothing hands an empty table on, and the result is then empty, as it is for empty documents. Columns that
documents has beyond its own go through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_stream, exact_dedup, mixing, near_dedup, toxicity
from quillspark.llm.stages import checkpoint_dir

#: SQL can express neither the toxicity model nor the sampling of near duplicates.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels does not call toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id."""
    return near_dedup.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    import public_tokenizers

    return bpe_stream.round_trip(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
