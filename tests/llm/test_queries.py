"""The registered queries: columns, whole tables, and SQL where there is some."""

import sys

import pytest

import __spark_entry__ as contract

sys.path.insert(0, contract.ROOT + "/tools")

import check_oracles  # noqa: E402

#: First columns of each result, and the table it has a row of each of (None: found cases only).
EXPECTED = {
    "op1_substring_dedup": (["doc_id", "start_word", "end_word", "kept_doc_id"], None),
    "op2_minhash_near_dedup": (["doc_id", "n_shingles", "component_id", "kept"], "documents"),
    "op3_quality_rules": (["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "documents"),
    "op4_token_counts": (["source", "lang", "tokenizer", "n_docs", "n_chars", "n_tokens"], None),
    "op5_html_extraction": (["page_id", "url", "text", "n_chars"], "pages"),
    "op6_toxicity": (["doc_id", "held_out", "score", "predicted"], "documents"),
    "op7_best_fit_packing": (["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], None),
    "op8_url_filters": (["page_id", "host", "path", "rule", "verdict"], "pages"),
    "op9_benchmark_decontamination": (["doc_id", "item_id"], None),
    "op10_license_scans": (["doc_id", "license"], None),
    "op11_suffix_array_dedup": (["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "documents"),
    "op12_periodic_runs": (["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"], "documents"),
    "op13_vector_codes": (["vec_id", "code", "error", "label_error", "codebooks_sha256"], "embeddings"),
}


def test_all_are_registered():
    assert set(EXPECTED) | {"pipeline"} == {n for n in contract.queries() if n.startswith("op") or n == "pipeline"}


@pytest.mark.parametrize("name", EXPECTED)
def test_query(spark, folder, name):
    columns, table = EXPECTED[name]
    out = contract.queries()[name](spark, folder)
    assert out.columns[: len(columns)] == columns
    assert out.count() == spark.read.parquet(f"{folder}/{table}.parquet").count() if table else not out.isEmpty()


def test_url_filters_as_sql(spark, folder):
    outcome = check_oracles.compare(spark, check_oracles.connect(folder), folder, "op8_url_filters")
    assert outcome.startswith("ok"), outcome
