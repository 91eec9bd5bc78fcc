"""The corpus pipeline: documents in, packed token sequences out.

Each stage works on all that the stage before kept. All but the last return the columns of documents:
toxicity drops what it predicts toxic, near-dedup keeps one document of each group, substring dedup cuts passages that
an earlier document holds (the text and its number of characters change), decontamination drops documents that
hold a benchmark item; packing returns one row per piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetide.llm import decontaminate, minhash, packing, substrings, toxicity
from facetide.llm.shared import without
from facetide.session import prepare, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, labels).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs)
    return without(docs, stored(found.where("NOT kept").select(F.col("id").alias("doc_id")), "dropped"), "doc_id").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_passages(docs, stored(substrings.shared_passages(docs), "passages"), n_chars="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stored(found.select(F.col("id").alias("doc_id")).distinct(), "dropped"), "doc_id").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(stored(parts, "pieces")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot learn the toxicity model nor tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
