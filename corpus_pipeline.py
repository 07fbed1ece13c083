"""From raw documents to packed sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import decontamination, language_id, line_dedup, near_duplicates, packing
from harrow.llm.queries import WORD_BPE, tokenizer_file
from harrow.session import stored, use_small_batches
from harrow.sources.tables import read_table


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language explains go: other scripts, noise, nothing but signs."""
    return language_id.with_language(docs, by_certainty=True)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; `n_chars` follows the text."""
    cleaned = line_dedup.without_common_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(kind))
    return cleaned


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_duplicates.keep_one(docs)


def unseen_by_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, in its words or with other values, go."""
    return decontamination.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences."""
    return packing.pack(docs, tokenizer_file(WORD_BPE))


def _in_small_batches(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        use_small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _in_small_batches(stage)) for name, stage in (
    ("language_id", in_a_language),
    ("line_dedup", lines_once),
    ("near_duplicates", one_of_each),
    ("decontamination", unseen_by_benchmarks),
    ("packing", packed),
)]

# Trained weights and tokenizer ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
