"""A training corpus from raw documents: STAGES, each a function of (spark, docs, sf_dir), written as Parquet between them.

Toxic documents go, of exact copies one stays, of near copies one stays, sources are mixed to their target weights (documents
come back in training order, repeated where their source is), and what is left is encoded.

Cases, in every stage but the last, which hands on all columns but the text: all columns of the table stay, whatever their names, and
extra ones too; null and empty texts have no toxic term and stay unless the model holds an empty text for toxic, are copies of each other,
have no near copies, and are never taken by the mix; texts of any length are judged whole; of repeated rows and ties one stays from exact
dedup on; rows without a doc_id stay unless they are copies of a row that has one; an empty table gives an empty table.

What stages store for themselves is deleted once their result is written, and each result once the next one is; the last but one is what the
result reads, and goes when the application ends (or the scope that the caller has opened).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from threadloom.tables import current, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier is fitted on all documents that have labels and are not held out."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit(every, labels, ~toxicity.held_out()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies at five-word shingles; see near_dedup."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids (little-endian unsigned 32-bit integers), n_tokens, digests of ids and of the decoded text, and the other columns
    but the text itself."""
    return bpe.encoded_and_checked(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: Toxicity and near duplicates are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    results = current(spark)
    for name, stage in STAGES[:-1]:
        # what a stage stores for itself goes with its scope, and nobody else's tables do
        with scope(spark):
            at = results.new_path(f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            results.drop(before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
