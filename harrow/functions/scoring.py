"""BM25 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
K1 = 1.5
B = 0.75
DEFAULT_AVGDL = 100.0
DEFAULT_K = 10


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def length_or_average(doc_length: Column, avgdl: Column) -> Column:
    """A document whose length is unknown or zero counts as an average one."""
    return F.when(F.coalesce(doc_length, F.lit(0)) == 0, avgdl).otherwise(doc_length.cast("double"))


def contribution(term_idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """One term's share of a document's score; `dl` must be non-zero."""
    damping = F.lit(1.0 - B) + F.lit(B) * (dl / avgdl)
    return term_idf * tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * damping)


def sum_in_order(pairs: Column, value: str = "c") -> Column:
    """Sum `value` over structs sorted by their first field.

    Float addition is not associative, and ties are broken only between exactly
    equal scores, so the order of the query's tokens is kept.
    """
    return F.aggregate(
        F.array_sort(pairs), F.lit(0.0), lambda total, pair: total + pair[value]
    )
