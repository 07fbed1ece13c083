"""Inverted-index operators over `(doc_id, text)` frames and postings frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions.folding import fold
from harrow.operators.joins import spread_join
from harrow.operators.order import numbered
from harrow.session import broadcast_limit, fits_broadcast, hinted, stored

ID_ROW_BYTES = 24


def doc_tokens(documents: DataFrame) -> DataFrame:
    """`(doc_id, pos, token)`, order and repeats kept."""
    return documents.select(
        "doc_id", F.posexplode(tx.raw_tokens(F.col("text"))).alias("pos", "token")
    ).select("doc_id", "pos", F.lower("token").alias("token"))


def doc_lengths(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", tx.token_count(F.col("text")).alias("doc_length"))


def doc_terms(documents: DataFrame) -> DataFrame:
    """Distinct `(term, doc_id)`; repeats are removed inside the row, without a shuffle."""
    return documents.select(
        F.explode(F.array_distinct(tx.index_tokens(F.col("text")))).alias("term"), "doc_id"
    )


def count_terms(documents: DataFrame, *carried: str) -> DataFrame:
    """Postings `(term, doc_id, tf)` plus stored columns of the document.

    Over a source bucketed by `doc_id` the grouping needs no exchange. `carried`
    columns must be stored ones: an expression over the text would be evaluated
    again for every word.
    """
    words = documents.select(
        "doc_id", *carried, F.explode(tx.raw_tokens(F.col("text"))).alias("word")
    )
    return (
        words.groupBy("doc_id", *carried, F.lower("word").alias("term"))
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
        .select("term", "doc_id", "tf", *carried)
    )


def posting_strings(postings: DataFrame, max_ids: int = 1_000_000) -> DataFrame:
    """Export view `(term, part, first_pos, doc_ids)`: comma-joined ids in string order.

    A list longer than `max_ids` is cut into parts of that many ids, the last one
    shorter; `first_pos` is the place of a part's first id in the whole list. Long
    lists are numbered over ranges of ids, so no task gathers one of them.
    """
    ids = postings.select("term", F.col("doc_id").cast("string").alias("id"))
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    heavy = stored(counted.filter(F.col("df") > max_ids).select("term"), "long-lists")
    if fits_broadcast(heavy):
        heavy = F.broadcast(heavy)
    light = (
        ids.join(heavy, "term", "left_anti").groupBy("term")
        .agg(F.concat_ws(",", F.array_sort(F.collect_list("id"))).alias("doc_ids"))
        .select("term", F.lit(0).alias("part"), F.lit(0).cast("long").alias("first_pos"), "doc_ids")
    )
    placed = numbered(ids.join(heavy, "term", "left_semi"), [F.col("term"), F.col("id")], "_at")
    starts = placed.groupBy("term").agg(F.min("_at").alias("_start"))
    if fits_broadcast(starts):
        starts = F.broadcast(starts)
    part = F.floor((F.col("_at") - F.col("_start")) / F.lit(max_ids)).cast("int")
    cut = (
        placed.join(starts, "term").groupBy("term", part.alias("part"))
        .agg(F.concat_ws(",", F.array_sort(F.collect_list("id"))).alias("doc_ids"))
        .select("term", "part", (F.col("part").cast("long") * max_ids).alias("first_pos"), "doc_ids")
    )
    return light.unionByName(cut)


def parse_posting_strings(strings: DataFrame) -> DataFrame:
    """`(term, part, pos, doc_id)`; positions run through all parts of a list."""
    rows = strings.select(
        "term", "part", "first_pos", F.posexplode(tx.posting_ids(F.col("doc_ids"))).alias("at", "doc_id")
    )
    return rows.select("term", "part", (F.col("first_pos") + F.col("at")).alias("pos"), "doc_id")


def unseen_postings(new: DataFrame, old: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows of `new` whose `(term, doc_id)` the old postings lack.

    Only documents indexed before can collide, so the old postings are first cut
    down to the batch's documents (`ids`, cheaper to list than `new` if known):
    by an id range that file statistics understand, then by the ids themselves.
    """
    ids = new.select("doc_id").distinct() if ids is None else ids
    span = ids.agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    ).first()
    if span["lo"] is None:
        return new
    if span["n"] * ID_ROW_BYTES <= broadcast_limit(new.sparkSession):
        old = old.filter(F.col("doc_id").between(span["lo"], span["hi"]))
        old = old.join(F.broadcast(ids), "doc_id", "left_semi")
    return new.join(old.select("term", "doc_id"), ["term", "doc_id"], "left_anti")


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Set union: re-indexing adds postings and never removes any."""
    columns = ["term", "doc_id"]
    return old.select(*columns).unionByName(new.select(*columns)).dropDuplicates(columns)


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """`(doc_id, content_hash, keep_id)`: every document with the first id of its text.

    The first id per hash is a map-side combined minimum, and joining it back
    spreads a text that fills much of the corpus over many tasks.
    """
    hashed = stored(
        documents.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash")), "content-hashes"
    )
    first = hashed.groupBy("content_hash").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")
    )
    shared = stored(first.filter("copies > 1"), "shared-hashes")
    return spread_join(hashed, shared, "content_hash", "copies", "doc_id").select(
        "doc_id", "content_hash", "keep_id"
    )


def folded_terms(documents: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Distinct terms after accent and case folding and a stop-word table `(term)`."""
    folded = documents.select("doc_id", fold(F.col("text")).alias("text"))
    terms = doc_terms(folded)
    return terms.join(hinted(stop_words.select("term").distinct()), "term", "left_anti")
