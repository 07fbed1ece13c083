"""Query terms, candidates, BM25 scores, top-k and results, over tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import scoring
from harrow.functions import text as tx
from harrow.operators.joins import attach, spread_join

# Longest query that is scored with one aggregate column per token.
MAX_POSITION_COLUMNS = 32


def nonblank(queries: DataFrame) -> DataFrame:
    """Queries with anything but white space in them."""
    return queries.filter(F.trim(F.regexp_replace("q", tx.UNICODE_SPACE, " ")) != "")


def query_terms(queries: DataFrame) -> DataFrame:
    """`(qid, pos, term)`; a repeated token keeps every position."""
    return queries.select("qid", F.posexplode(tx.query_tokens(F.col("q"))).alias("pos", "term"))


def weighted_terms(
    terms: DataFrame, term_stats: DataFrame, n_docs: int, fits: bool = False
) -> DataFrame:
    """`(qid, pos, term, df, min_length, length_unknown, idf)` for query terms that the index holds.

    `fits`: the query terms are known to fit a broadcast.
    """
    uses = terms.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    known = term_stats.join(F.broadcast(uses) if fits else uses, "term")
    return (
        spread_join(terms, known, "term", "uses", "qid", fits=fits)
        .withColumn("idf", scoring.idf(F.lit(n_docs), F.col("df")))
        .select("qid", "pos", "term", "df", "min_length", "length_unknown", "idf")
    )


def candidates(postings: DataFrame, weighted: DataFrame, fits: bool = False) -> DataFrame:
    """Every posting of every query term occurrence.

    With the query terms broadcast, postings are streamed and never shuffled. A
    query table beyond the broadcast limit is joined on the term, the postings of
    frequent terms being spread over several tasks by document.
    """
    return spread_join(postings, weighted, "term", "df", "doc_id", fits=fits)


def candidate_set(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "doc_id").distinct()


def with_lengths(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Attach document lengths; a missing document leaves NULL.

    A task hashes the lengths of its bucket, so the hits, of which there are far more, are not sorted. A session
    that has switched off Spark's own broadcasts gets a join that holds no side in memory.
    """
    lengths = documents.select("doc_id", "doc_length")
    if documents.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1":
        lengths = lengths.hint("shuffle_hash")
    return hits.drop("doc_length").join(lengths, "doc_id", "left")


def with_contributions(hits: DataFrame, avgdl: float | Column, use_tf: bool = False) -> DataFrame:
    """Add `c`. Every posting weighs as one occurrence unless `use_tf`."""
    average = avgdl if isinstance(avgdl, Column) else F.lit(float(avgdl))
    tf = F.col("tf") if use_tf else F.lit(1)
    dl = scoring.length_or_average(F.col("doc_length"), average)
    return hits.withColumn("c", scoring.contribution(F.col("idf"), tf, dl, average))


def scores(contributions: DataFrame) -> DataFrame:
    """`(qid, doc_id, score, first_pos)`; a group is at most one query long."""
    return (
        contributions.groupBy("qid", "doc_id")
        .agg(
            F.collect_list(F.struct("pos", "c")).alias("parts"),
            F.min("pos").alias("first_pos"),
        )
        .select("qid", "doc_id", scoring.sum_in_order(F.col("parts")).alias("score"), "first_pos")
    )


def scores_by_position(contributions: DataFrame, positions: list[int]) -> DataFrame:
    """`scores` for one short query: a column per token position, added up in order.

    Keeps the aggregation on fixed-width buffers, which hash aggregation and code
    generation handle; an absent token adds an exact zero.
    """
    at = [F.max(F.when(F.col("pos") == pos, F.col("c"))).alias(f"at_{pos}") for pos in positions]
    score = F.lit(0.0)
    for pos in positions:
        score = score + F.coalesce(F.col(f"at_{pos}"), F.lit(0.0))
    return (
        contributions.groupBy("qid", "doc_id").agg(F.min("pos").alias("first_pos"), *at)
        .select("qid", "doc_id", score.alias("score"), "first_pos")
    )


def result_order() -> list[Column]:
    """Best score first; ties by first matching token, then by id as a string."""
    return [F.col("score").desc(), F.col("first_pos").asc(), F.col("doc_id").cast("string").asc()]


def top_k(scored: DataFrame, k: int = scoring.DEFAULT_K) -> DataFrame:
    """Per query `(qid, rank, doc_id, score)`.

    The rank filter turns into a group limit before the exchange, so each task
    sends at most k rows per query, however many documents match.
    """
    best_first = Window.partitionBy("qid").orderBy(*result_order())
    return (
        scored.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k)
        .select("qid", "rank", "doc_id", "score")
    )


def with_metadata(ranked: DataFrame, documents: DataFrame, fits: bool = False) -> DataFrame:
    """Result rows; hits without metadata drop out after the cut, unreplaced.

    `fits`: the ranked rows (k per query) are known to fit a broadcast.
    """
    meta = documents.select("doc_id", "url", "title", "snippet")
    joined = attach(ranked, meta, "doc_id", "qid", fits)
    return joined.select(
        "qid", "rank", F.col("doc_id").alias("id"), "url",
        tx.filled(F.col("title"), F.col("url")).alias("title"),
        tx.filled(F.col("snippet"), F.lit(tx.NO_PREVIEW)).alias("snippet"),
        "score",
    )


def result_counts(queries: DataFrame, results: DataFrame) -> DataFrame:
    counted = results.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("qid").join(counted, "qid", "left").select(
        "qid", F.coalesce("n", F.lit(0)).alias("result_count")
    )


def responses(queries: DataFrame, results: DataFrame, latency_ms: Column | None = None) -> DataFrame:
    """One JSON response per query; at most k rows are gathered for each."""
    listed = results.groupBy("qid").agg(
        F.array_sort(F.collect_list(
            F.struct("rank", "id", "url", "title", "snippet", "score")
        )).alias("ranked")
    )
    rows = F.coalesce(
        F.transform("ranked", lambda r: F.struct(
            r["id"].alias("id"), r["url"].alias("url"), r["title"].alias("title"),
            r["snippet"].alias("snippet"), r["score"].alias("score"),
        )),
        F.array().cast("array<struct<id:bigint,url:string,title:string,snippet:string,score:double>>"),
    )
    latency = F.lit(0.0) if latency_ms is None else latency_ms
    body = F.struct(
        F.lower("q").alias("query"),
        rows.alias("results"),
        F.struct(F.size(rows).alias("count"), F.round(latency, 2).alias("latency_ms")).alias("meta"),
    )
    return queries.join(listed, "qid", "left").select("qid", F.to_json(body).alias("response"))
