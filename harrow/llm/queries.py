"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import (
    decontamination, importance, language_id, line_dedup, lz_fingerprints, near_duplicates, packing,
    periodic_runs, prefix_trie, shards, token_counts, url_rules, warc_records,
)
from harrow.llm.oracles import ORACLES  # noqa: F401
from harrow.sources.tables import read_table


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers; $HARROW_TOKENIZERS names another folder."""
    folder = os.environ.get("HARROW_TOKENIZERS")
    return f"{folder}/{name}" if folder else importlib.import_module("public_tokenizers").path(name)


WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def op1_importance_resampling(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return importance.resample_by_labels(_documents(spark, folder), labels)


def op2_token_counts(spark, folder):
    return token_counts.token_counts(_documents(spark, folder), tokenizer_file(PIECE_BPE))


def op3_near_duplicates(spark, folder):
    return near_duplicates.near_duplicates(_documents(spark, folder))


def op4_url_rules(spark, folder):
    judged = url_rules.judge_urls(read_table(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_warc_records(spark, folder):
    read = warc_records.archived(read_table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op6_line_dedup(spark, folder):
    return line_dedup.line_report(_documents(spark, folder))


def op7_best_fit_packing(spark, folder):
    return packing.pack(_documents(spark, folder), tokenizer_file(WORD_BPE))


def op8_language_id(spark, folder):
    return language_id.identify(_documents(spark, folder))


def op9_lz_fingerprints(spark, folder):
    return lz_fingerprints.compared(_documents(spark, folder))


def op10_benchmark_leaks(spark, folder):
    return decontamination.leak_report(_documents(spark, folder), read_table(spark, folder, "benchmark"))


def op11_periodic_runs(spark, folder):
    return periodic_runs.run_report(_documents(spark, folder))


def op12_prefix_trie(spark, folder):
    return prefix_trie.trie_report(read_table(spark, folder, "conversations"))


def op13_histogram_shards(spark, folder):
    return shards.shard_report(_documents(spark, folder))


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_token_counts": op2_token_counts,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_url_rules": op4_url_rules,
    "op5_warc_records": op5_warc_records,
    "op6_line_dedup": op6_line_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_lz_fingerprints": op9_lz_fingerprints,
    "op10_benchmark_leaks": op10_benchmark_leaks,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_histogram_shards": op13_histogram_shards,
}
