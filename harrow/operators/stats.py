"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import scoring


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row `(n_docs, avgdl)` over every document row, fetched or not."""
    average = F.avg("doc_length")
    return documents.agg(
        F.greatest(F.count(F.lit(1)), F.lit(1)).cast("long").alias("n_docs"),
        F.when(average.isNull() | (average == 0), F.lit(scoring.DEFAULT_AVGDL))
        .otherwise(average).alias("avgdl"),
    )


def term_statistics(postings: DataFrame) -> DataFrame:
    """Per term its document frequency, its shortest document with a known length,
    and whether any of its documents lacks one (it counts as an average document then).

    All of it combines on the map side, so a term that sits in most documents reaches
    the shuffle as one row per task.
    """
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.min(F.when(F.col("doc_length") > 0, F.col("doc_length"))).alias("min_length"),
        F.bool_or(F.coalesce("doc_length", F.lit(0)) == 0).alias("length_unknown"),
    )


def term_idf(term_stats: DataFrame, n_docs) -> DataFrame:
    """`n_docs` is a number or a scalar column."""
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(n_docs)
    return term_stats.select("term", "df", scoring.idf(n, F.col("df")).alias("idf"))
