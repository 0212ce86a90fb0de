"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, common, decontam, line_dedup, minhash, toxicity

#: A document is rejected from this score on.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; learnt from the labelled ones that are here."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    (name,) = common.free_names(docs, "toxicity")
    return toxicity.score(docs, model, keep=docs.columns, name=name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat, nearly or exactly, one that comes before; n_chars follows the text."""
    out = line_dedup.deduplicate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies at a similarity of 0.8: that of the smallest id."""
    found = minhash.near_dedup(docs, percent=80, bands=28, height=6)
    (name,) = common.free_names(docs, "gone")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every whole text, with their number and digests."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: Models and groups by graph search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
