"""Frontier operators: queue cleaning, validation, seeding, first-come URL claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions.urls import SEED_URL, is_valid_url
from harrow.session import broadcast_limit, measured_bytes, stored


def clean_queue(queue: DataFrame, item: str = "url") -> DataFrame:
    """Drop items that carry no value."""
    return queue.filter(F.col(item).isNotNull())


def queue_items(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Queue replies (JSON, `["queue", "item"]`) to `item`; replies that are missing, of
    another type, or too short carry no item and are skipped."""
    pair = F.when(F.json_array_length(reply) >= 2, F.get_json_object(reply, "$[1]"))
    return replies.withColumn("item", pair).filter("item IS NOT NULL")


def valid_urls(frontier: DataFrame) -> DataFrame:
    return frontier.filter(is_valid_url(F.col("url")))


def parse_doc_ids(items: DataFrame, item: str = "item") -> DataFrame:
    """Queue items to int ids; items without one are skipped."""
    return items.withColumn("doc_id", tx.leading_int(F.col(item))).filter("doc_id IS NOT NULL")


def seed_frontier(frontier: DataFrame, seed: str = SEED_URL) -> DataFrame:
    """The frontier, or the seed URL alone if the frontier is empty."""
    spark = frontier.sparkSession
    first = spark.range(1).select(F.lit(0).cast("long").alias("seq"), F.lit(seed).alias("url"))
    any_row = frontier.select(F.lit(0).cast("long").alias("seq")).limit(1)
    return frontier.select("seq", "url").unionByName(first.join(any_row, "seq", "left_anti"))


def first_claims(frontier: DataFrame) -> DataFrame:
    """Earliest `seq` per URL; a URL queued by many pages shrinks on the map side."""
    return frontier.groupBy("url").agg(F.min("seq").alias("seq")).select("seq", "url")


def accept_urls(frontier: DataFrame, documents: DataFrame) -> DataFrame:
    """Valid URLs of the frontier not yet in `documents(url)`, each once.

    A small batch is broadcast to the documents scan, and the URLs found there
    (no more than the batch) are broadcast back, so documents are not shuffled.
    A large batch is anti-joined on the URL; it has one row per URL by then.
    """
    claims = stored(first_claims(valid_urls(clean_queue(frontier))), "claims")
    known = documents.select("url")
    if measured_bytes(claims) <= broadcast_limit(frontier.sparkSession):
        seen = known.join(F.broadcast(claims.select("url")), "url", "left_semi").distinct()
        fresh = claims.join(F.broadcast(seen), "url", "left_anti")
    else:
        fresh = claims.join(known, "url", "left_anti")
    return fresh.select("seq", "url")
