"""The training-data pipeline: quality rules, near-duplicates, secrets, source weights, token ids. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import byte_bpe, near_dedup, quality_rules, secrets_crf, source_mix
from tidewire.llm.shared import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; whole rows ride along, so nothing is joined."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    # a filter on what explode() makes isn't pushed below it, where every rule would be computed once more
    judged = quality_rules.quality_rules(rows, id_col="row").select("row", F.explode(F.array("kept")).alias("kept"))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8): the one of the least id."""
    gone = near_dedup.near_dedup(docs, k=5, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets_crf.redact_documents(docs, secrets_crf.train(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents once for each time that they are taken."""
    return source_mix.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number and digest of each document's byte-level BPE ids, and the digest of what they decode to."""
    import public_tokenizers

    return byte_bpe.digest(docs, byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("source mix", mixture), ("token ids", token_ids)]

#: No SQL: secrets are found by a trained model, and merges are folded by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage{k}"))
        docs = spark.read.parquet(path)
    return docs
