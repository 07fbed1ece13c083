"""Index versions in the shared folder.

A version is four Parquet tables. `documents` and `postings` are bucketed by
`doc_id` with the same bucket count, so every posting of a document sits with
its metadata and a query is scored without shuffling postings; a term found in
most documents is spread over all buckets. Rows inside a bucket are sorted by
term, which lets a pushed `term IN (...)` skip row groups and pages.

`stats` is written last: a folder without it is an unfinished build.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow import schemas
from harrow.functions import text as tx
from harrow.operators import indexing
from harrow.operators.stats import corpus_stats, term_statistics
from harrow.session import new_path, stored


# What one task counts, sorts and scores: its memory follows the text of a bucket, whatever the corpus.
BUCKET_TEXT_BYTES = 8 * 1024 * 1024
# Beyond so many buckets they grow to `LARGEST_BUCKET_BYTES` before there are more of them.
MANY_BUCKETS = 10_000
LARGEST_BUCKET_BYTES = 256 * 1024 * 1024
# A vocabulary grows far slower than its corpus.
TERM_BUCKETS = 2000


@dataclass(frozen=True)
class SearchIndex:
    path: str
    documents: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    n_docs: int
    avgdl: float
    buckets: int

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def attach(spark, name, schema, path, key, sort, buckets) -> DataFrame:
    """Declare the bucketed layout of files already in place."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_columns(schema)}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def save(df: DataFrame, name: str, path: str, key: str, sort: list[str], buckets: int) -> None:
    (
        df.write.format("parquet").bucketBy(buckets, key).sortBy(*sort)
        .option("path", path).saveAsTable(name)
    )


def default_buckets(spark: SparkSession, text_bytes: int = 0) -> int:
    """A bucket per core, or more so that one holds some 8 MB of text (up to 256 MB beyond 80 GB)."""
    by_size = max(min(MANY_BUCKETS, -(-text_bytes // BUCKET_TEXT_BYTES)), -(-text_bytes // LARGEST_BUCKET_BYTES))
    return max(spark.sparkContext.defaultParallelism, by_size)


def build_index(
    documents: DataFrame,
    path: str | None = None,
    buckets: int | None = None,
    postings: DataFrame | None = None,
    text_bytes: int = 0,
) -> SearchIndex:
    """Index `(doc_id, url, title, text)`; NULL text is a document never fetched.

    The only full shuffle moves each text once to its bucket. Tokens, term counts
    and the postings sort all happen inside the buckets. Give `text_bytes` (or
    `buckets`) for a large corpus that is costly to measure: it sets how much one task
    sorts. `postings(term, doc_id, tf[, batch_id])`, if given, are taken over instead of
    being derived from the texts; of repeated ones the latest batch counts. They are
    shuffled once, to the buckets of their documents.
    """
    spark = documents.sparkSession
    path = path or new_path(spark, "index")
    if not buckets:
        if not text_bytes:  # measured on a copy, as the input may be dear to evaluate
            documents = stored(documents.select("doc_id", "url", "title", "text"), "documents")
            text_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = default_buckets(spark, text_bytes)
    tag = "harrow_" + uuid.uuid4().hex[:12]

    placed = documents.select("doc_id", "url", "title", "text").repartition(buckets, "doc_id")
    text = F.col("text")
    save(
        placed.select(
            "doc_id", "url", "title", tx.snippet(text).alias("snippet"),
            tx.token_count(text).alias("doc_length"), "text",
        ),
        f"{tag}_documents", f"{path}/documents", "doc_id", ["doc_id"], buckets,
    )
    kept = spark.table(f"{tag}_documents")
    if postings is None:
        rows = indexing.count_terms(kept, "doc_length")
    else:
        latest = F.max_by("tf", "batch_id") if "batch_id" in postings.columns else F.max("tf")
        rows = (
            postings.repartition(buckets, "doc_id").groupBy("term", "doc_id").agg(latest.alias("tf"))
            .join(kept.select("doc_id", "doc_length"), "doc_id", "left")
            .select("term", "doc_id", "tf", "doc_length")
        )
    save(
        rows, f"{tag}_postings", f"{path}/postings", "doc_id", ["term", "doc_id"], buckets,
    )
    indexed = spark.table(f"{tag}_postings")
    terms = term_statistics(indexed)
    few = min(buckets, TERM_BUCKETS)
    save(terms.repartition(few, "term"), f"{tag}_terms", f"{path}/term_stats", "term", ["term"], few)
    (
        corpus_stats(kept).withColumn("buckets", F.lit(buckets))
        .coalesce(1).write.parquet(f"{path}/stats")
    )
    return _opened(spark, path, tag)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """Reopen a finished version, in this session or a later one."""
    return _opened(spark, path, "harrow_" + uuid.uuid4().hex[:12])


def _opened(spark: SparkSession, path: str, tag: str) -> SearchIndex:
    stats = spark.read.schema(schemas.STATS).parquet(f"{path}/stats").first()
    n = stats["buckets"]
    return SearchIndex(
        path=path,
        documents=attach(spark, f"{tag}_documents", schemas.INDEXED_DOCUMENTS,
                          f"{path}/documents", "doc_id", "doc_id", n),
        postings=attach(spark, f"{tag}_postings", schemas.POSTINGS,
                         f"{path}/postings", "doc_id", "term, doc_id", n),
        term_stats=attach(spark, f"{tag}_terms", schemas.TERM_STATS,
                           f"{path}/term_stats", "term", "term", min(n, TERM_BUCKETS)),
        n_docs=stats["n_docs"],
        avgdl=stats["avgdl"],
        buckets=n,
    )


def lookup(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of a few literal terms; the list reaches Parquet as a pushed `In`."""
    return postings.filter(F.col("term").isin(*terms))
