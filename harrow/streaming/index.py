"""Continuous indexing of archived pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harrow import schemas
from harrow.functions import text as tx
from harrow.operators import documents as docs
from harrow.operators import indexing
from harrow.operators.extract import page_content
from harrow.session import hinted
from harrow.sources import grown_index, warc
from harrow.sources.index_store import SearchIndex, build_index, default_buckets
from harrow.streaming import batches

EXTRACTED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("doc_length", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("reason", T.StringType()),
])
TERMS = T.StructType([f for f in schemas.POSTINGS.fields if f.name != "doc_length"])
REJECTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("reason", T.StringType())])


@dataclass(frozen=True)
class StreamedIndex:
    """Folders a stream grows: extracted pages, postings, document log, rejects."""

    path: str

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def prepare(self, spark: SparkSession) -> None:
        batches.start_table(spark, self.table("extracted"), EXTRACTED)
        batches.start_table(spark, self.table("postings"), TERMS)
        batches.start_table(spark, self.table("doc_log"), schemas.DOC_LOG)

    def all_postings(self, spark: SparkSession) -> DataFrame:
        """Postings batch by batch, `(term, doc_id, tf, batch_id)`."""
        return batches.read_table(spark, self.table("postings"), TERMS)

    def postings(self, spark: SparkSession) -> DataFrame:
        """Each `(term, doc_id)` once, with its latest `tf`."""
        return self.all_postings(spark).groupBy("term", "doc_id").agg(F.max_by("tf", "batch_id").alias("tf"))

    def doc_log(self, spark: SparkSession) -> DataFrame:
        return batches.read_table(spark, self.table("doc_log"), schemas.DOC_LOG)

    def documents(self, spark: SparkSession) -> DataFrame:
        return docs.document_state(self.doc_log(spark))

    def latest_documents(self, spark: SparkSession) -> DataFrame:
        """`(doc_id, url, title, text)` as last extracted; a batch has one row per document.

        Only ids and batch numbers are grouped, texts are not moved for it.
        """
        rows = batches.read_table(spark, self.table("extracted"), EXTRACTED)
        good = rows.filter(F.col("reason").isNull())
        newest = good.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
        return good.join(hinted(newest), ["doc_id", "batch_id"]).select("doc_id", "url", "title", "text")

    def publish(self, spark: SparkSession, path: str | None = None) -> SearchIndex:
        """Turn what has been streamed so far into an index version for searching.

        Postings are the union over all batches, so terms of replaced contents stay in;
        `tf` is that of the last batch that had the term in the document.
        """
        documents = self.latest_documents(spark)
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        return build_index(documents, path, postings=self.all_postings(spark), text_bytes=size)

    def grow(self, spark: SparkSession, batch_id: int, path: str) -> SearchIndex:
        """Publish one batch as the next version of the grown index at `path`, at the batch's cost."""
        rows = batches.read_batch(spark, self.table("extracted"), EXTRACTED, batch_id)
        return grown_index.grow(rows.filter(F.col("reason").isNull()), path, batch=batch_id)

    def rejects(self, spark: SparkSession) -> DataFrame:
        rows = batches.read_table(spark, self.table("extracted"), EXTRACTED)
        return rows.filter(F.col("reason").isNotNull()).select("doc_id", "reason")


def last_handed_over(manifest: DataFrame) -> DataFrame:
    """One row per document of a batch: the one with the largest `seq` if the manifest has
    it, and among equals the last by file and offset."""
    fields = [f.name for f in schemas.MANIFEST.fields if f.name != "doc_id"]
    order = (["seq"] if "seq" in manifest.columns else []) + ["file_path", "offset", "length", "url"]
    last = manifest.groupBy("doc_id").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("row"))
    return last.select("doc_id", *[F.col("row")[name].alias(name) for name in fields])


def extract_batch(manifest: DataFrame, archive: str) -> DataFrame:
    """Manifest rows to extracted documents; unreadable ones carry a reason only."""
    items = last_handed_over(manifest)
    pages = warc.read_records(items, archive).withColumn("page", page_content(F.col("body")))
    text = F.col("page.text")
    return pages.select(
        "doc_id", "url", "page.title", "page.text",
        F.when(F.col("reason").isNull(), tx.token_count(text)).alias("doc_length"),
        tx.snippet(text).alias("snippet"), "reason",
    )


def index_batch(
    manifest: DataFrame, archive: str, index: StreamedIndex, batch_id: int
) -> None:
    """Index one batch of manifest rows; doing it again gives the same folders.

    No earlier batch is read: a document met again adds its postings anew, and readers
    take each posting once. A batch costs its own size, however many came before. Texts are
    dealt by document before their terms are counted, so a task counts those of some 8 MB.
    """
    spark = manifest.sparkSession
    batches.write_batch(
        extract_batch(manifest, archive), index.table("extracted"), batch_id
    )
    extracted = batches.read_batch(spark, index.table("extracted"), EXTRACTED, batch_id)
    good = extracted.filter(F.col("reason").isNull())
    size = good.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = good.select("doc_id", "text").repartition(default_buckets(spark, size), "doc_id")
    batches.write_batch(
        indexing.count_terms(dealt).select("term", "doc_id", "tf"), index.table("postings"), batch_id
    )
    batches.write_batch(
        docs.log_rows(good.select(
            "doc_id", F.lit(batch_id).alias("seq"), "url", "doc_length", "title", "snippet"
        )),
        index.table("doc_log"), batch_id,
    )


def index_stream(
    manifest: DataFrame, archive: str, index: StreamedIndex, checkpoint: str, grown: str | None = None
) -> StreamingQuery:
    """Index a stream of manifest rows through what is available, then stop.

    `grown` names a grown index of which every batch becomes a version.
    """
    index.prepare(manifest.sparkSession)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        index_batch(batch, archive, index, batch_id)
        if grown:
            index.grow(batch.sparkSession, batch_id, grown)

    return (
        manifest.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
