"""The documents table: folded state of the append-only log, and its lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow import schemas
from harrow.session import hinted

_FOLDED = [f.name for f in schemas.DOC_LOG.fields if f.name not in ("doc_id", "seq")]


def log_rows(rows: DataFrame) -> DataFrame:
    """Partial updates in log shape; columns not given stay NULL (unchanged)."""
    return rows.select(*[
        F.col(f.name).cast(f.dataType) if f.name in rows.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.DOC_LOG.fields
    ])


def crawled_rows(manifest: DataFrame, seq: int) -> DataFrame:
    """Log rows that say where a fetched page was stored."""
    return log_rows(manifest.withColumns({"seq": F.lit(seq), "status": F.lit("crawled")}))


def document_state(doc_log: DataFrame) -> DataFrame:
    """Last non-NULL value per column and document."""
    return doc_log.groupBy("doc_id").agg(*[
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)
        for name in _FOLDED
    ])


def documents_by_status(documents: DataFrame, status: str) -> DataFrame:
    return documents.filter(F.col("status") == status)


def first_documents(documents: DataFrame, n: int = 10) -> DataFrame:
    """A short listing in id order."""
    return documents.select("doc_id", "url", "title", "status").orderBy("doc_id").limit(n)


def documents_by_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.join(hinted(ids.select("doc_id").distinct()), "doc_id", "left_semi")


def not_indexed(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """Crawled documents that never reached the index, as `crawled_not_queued`."""
    return (
        documents.filter(F.col("status") == "crawled").select("doc_id")
        .join(indexed.select("doc_id"), "doc_id", "left_anti")
        .withColumn("status", F.lit("crawled_not_queued"))
    )
