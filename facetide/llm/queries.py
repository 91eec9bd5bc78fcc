"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder, prepare, stored
from . import codes, corpusorder, decontaminate, htmltext, licenses, minhash, packing, periods, quality, rollups, substrings, toxicity, urlfilter
from .oracles import ORACLES


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.shared_passages(_table(spark, folder, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "head": "kept_doc_id", "start": "start_word", "end": "end_word", "head_start": "kept_start_word", "head_end": "kept_end_word"})


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, folder, "documents"), shingle=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are inserted as one batch; rows whose text an earlier document has are taken out again by a second one
    that is sent twice; what stays has its count revised from words to the tokenizer's by a third."""
    docs = _table(spark, folder, "documents")
    rows = stored(rollups.counted(docs, {rollups.WORDS: "", "word_bpe_49k": public_tokenizers.path("word_bpe_49k.json")}), "counted")
    words, tokens = (rows.where(F.col("tokenizer") == t) for t in (rollups.WORDS, "word_bpe_49k"))
    first = docs.groupBy(F.xxhash64("text").alias("h"), F.md5(F.col("text").cast("binary")).alias("m")).agg(F.min("doc_id").alias("id"))
    kept = stored(first.select("id"), "kept")
    rollup = rollups.Rollup(spark, fresh_folder(spark, "rollup"))
    rollup.commit("inserted", rollups.delta(None, words))
    copies = rollups.delta(words.join(kept, "id", "left_anti"), None)
    rollup.commit("copies", copies)
    rollup.commit("copies", copies)
    rollup.commit("revised", rollups.delta(words.join(kept, "id", "left_semi"), rows.join(kept, "id", "left_semi")))
    return rollup.totals()


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.main_texts(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    parts = packing.pieces(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(stored(parts, "pieces")).withColumnRenamed("id", "doc_id")


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    found = urlfilter.judged(pages, urlfilter.document_labels(pages, _table(spark, folder, "labels")))
    return found.withColumnRenamed("id", "page_id")


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "start": "start_word", "end": "end_word"})


def op10_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.found_licenses(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op11_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return corpusorder.deduplicated(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", periods.repeated_tail("doc_id", "text").alias("text"))
    return periods.digests(periods.periodic_runs(docs)).withColumnRenamed("id", "doc_id")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compressed(_table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_html_extraction": op5_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_filters": op8_url_filters,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_license_scans": op10_license_scans,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

LLM_ORACLES: dict[str, str] = dict(ORACLES)
