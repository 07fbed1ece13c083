"""Handing items over with a bounded number of tries.

Each try is a job over the items that are still to be handed over, and leaves its outcomes
`(doc_id, reason)` in its own folder of the attempt log: a NULL reason means delivered. Only what
failed is tried again. What fails `MOST` times is a dead letter. A run that was interrupted goes
on with the first try whose folder is not finished; finished tries are not repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.operators.documents import log_rows
from harrow.session import hinted
from harrow.streaming import batches

MOST = 3
QUEUED, NOT_QUEUED, PENDING = "queued", "crawled_not_queued", "crawled"
OUTCOMES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("reason", T.StringType())])
FINISHED = T.StructType([T.StructField("failed", T.LongType())])

Deliver = Callable[[DataFrame, int], DataFrame]


def _finished(spark: SparkSession, log: str, attempt: int) -> int | None:
    """How many items failed at a try that was finished before."""
    try:
        row = batches.read_batch(spark, f"{log}/finished", FINISHED, attempt).first()
    except Exception as error:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return row["failed"] if row else None


def hand_over(items: DataFrame, deliver: Deliver, log: str, most: int = MOST) -> DataFrame:
    """Deliver `items(doc_id, ...)`, each at most `most` times; the outcomes `(doc_id, attempt, reason)`.

    `deliver(items, attempt)` returns `(doc_id, reason)` of the rows it was given, as a plan.
    An id with several rows is delivered if all of them are. Rows without doc_id are not items.
    """
    spark = items.sparkSession
    items = items.filter(F.col("doc_id").isNotNull())
    pending = items
    for attempt in range(1, most + 1):
        failed = _finished(spark, log, attempt)
        if failed is None:
            outcomes = deliver(pending, attempt).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
                F.max("reason").alias("reason"))
            batches.write_batch(outcomes, f"{log}/outcomes", attempt)
            tried = batches.read_batch(spark, f"{log}/outcomes", OUTCOMES, attempt)
            failed = tried.filter("reason IS NOT NULL").count()
            batches.write_batch(spark.createDataFrame([(failed,)], FINISHED), f"{log}/finished", attempt)
        if not failed:
            break
        again = batches.read_batch(spark, f"{log}/outcomes", OUTCOMES, attempt).filter("reason IS NOT NULL")
        pending = items.join(hinted(again.select("doc_id")), "doc_id", "left_semi")
    return outcomes_of(spark, log)


def outcomes_of(spark: SparkSession, log: str) -> DataFrame:
    """Every outcome of a log, `(doc_id, attempt, reason)`."""
    rows = batches.read_table(spark, f"{log}/outcomes", OUTCOMES)
    return rows.select("doc_id", F.col("batch_id").cast("int").alias("attempt"), "reason")


def hand_over_state(outcomes: DataFrame, most: int = MOST) -> DataFrame:
    """`(doc_id, attempts, status, reason)`: how often each item was tried and how it ended."""
    last = outcomes.groupBy("doc_id").agg(
        F.max("attempt").alias("attempts"), F.max_by(F.struct("reason"), "attempt").alias("last"))
    reason = F.col("last.reason")
    return last.select(
        "doc_id", "attempts",
        F.when(reason.isNull(), QUEUED).when(F.col("attempts") >= most, NOT_QUEUED).otherwise(PENDING).alias("status"),
        reason.alias("reason"))


def dead_letter_rows(state: DataFrame, seq: int) -> DataFrame:
    """Log rows that mark the documents that could not be handed over."""
    dead = state.filter(F.col("status") == NOT_QUEUED)
    return log_rows(dead.select("doc_id", F.lit(seq).alias("seq"), "status"))
