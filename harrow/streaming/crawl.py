"""Continuous frontier consumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harrow.operators.frontier import accept_urls, clean_queue, valid_urls
from harrow.session import stored
from harrow.sources.queue import BATCH_ROWS, read_queue
from harrow.streaming import batches

ACCEPTED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.StringType()),
])


def accept_stream(
    frontier: DataFrame, table: str, checkpoint: str, known: DataFrame | None = None
) -> StreamingQuery:
    """Append newly accepted URLs of a stream `(seq, url)` to the documents table.

    The table is the memory of accepted URLs; `seq` becomes the document id. Runs
    through what is available and stops; a later run goes on from the checkpoint.
    """
    spark = frontier.sparkSession
    rows = None if known is None else known.select(
        F.col("doc_id").cast("long"), "url", "status"
    )
    batches.start_table(spark, table, ACCEPTED, rows)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = batches.read_table(batch.sparkSession, table, ACCEPTED, before=batch_id)
        accepted = accept_urls(batch, earlier)
        batches.write_batch(
            accepted.select(F.col("seq").alias("doc_id"), "url", F.lit("processing").alias("status")),
            table, batch_id,
        )

    return (
        frontier.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


THROUGH = T.StructType([T.StructField("last", T.LongType())])
_BEFORE_ALL = -(2**63)
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accept_queue(
    spark: SparkSession,
    queue: str,
    table: str,
    checkpoint: str,
    known: DataFrame | None = None,
    rows_per_batch: int = BATCH_ROWS,
) -> None:
    """Take an ordered queue (`sources.queue`) through what is published, first come first served.

    The URLs met so far are keyed state, each with the `seq` that came first; Spark keeps it
    by the hash of the URL beside the tasks, in RocksDB. A batch reads its own segments and the
    state of its own URLs, and never the accepted table, so its cost does not grow with the
    batches before. As batches follow the order of `seq`, a URL is new if its first `seq` lies
    behind all that earlier batches have seen. `known(doc_id, url, status)` URLs enter the state
    in front of the queue. Call it again to take what was published since.
    """
    rows = None if known is None else stored(known.select(F.col("doc_id").cast("long"), "url", "status"), "known")
    batches.start_table(spark, table, ACCEPTED, rows)
    through = f"{table}-through"
    batches.start_table(spark, through, THROUGH, spark.createDataFrame([(_BEFORE_ALL,)], THROUGH))
    claims = valid_urls(clean_queue(read_queue(spark, queue, checkpoint, rows_per_batch=rows_per_batch)))
    before = spark.readStream.schema("url string").parquet(f"{table}/batch_id={batches.BASE_BATCH}").select(
        F.lit(_BEFORE_ALL).alias("seq"), "url")
    met = before.unionByName(claims.select("seq", "url")).groupBy("url").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"))

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # one row per URL of the batch; every batch leaves one number
        batch = stored(batch, "met")
        past = batches.read_batch(session, through, THROUGH, batch_id - 1).first()["last"]
        last = batch.agg(F.max("last").alias("last")).first()["last"]
        batches.write_batch(batch.filter(F.col("first") > past).select(
            F.col("first").alias("doc_id"), "url", F.lit("processing").alias("status")), table, batch_id)
        reached = past if last is None else max(past, last)
        batches.write_batch(session.createDataFrame([(reached,)], THROUGH), through, batch_id)

    was = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKS)
    try:
        query = (
            met.writeStream.outputMode("update").foreachBatch(one_batch)
            .option("checkpointLocation", checkpoint).start()
        )
    finally:
        spark.conf.set(_STATE_STORE, was)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
