"""Search plans over an index version.

`search`        one query string, terms pushed into the postings scan.
`search_batch`  a table of queries. Two exact ways to the same rows:

* exhaustive: score every posting of every query term, in blocks of documents;
* bounded:    score the rare terms first, take each query's k-th partial score as
  a floor, and drop documents whose upper bound stays under it before the
  frequent terms are looked at. Nothing that could reach the top k is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import scoring
from harrow.functions import text as tx
from harrow.operators import blocks, ranking
from harrow.operators.joins import spread_join
from harrow.operators.order import numbered
from harrow.session import broadcast_limit, fits_broadcast, measured_bytes, stored
from harrow.sources.index_store import SearchIndex, lookup

RESULT_ROW_BYTES = 64
# Result ids of one query that are pushed into the metadata scan as literals.
MAX_PUSHED_IDS = 1000
# Postings of a query's rarest terms that are scored to find its floor.
SEED_POSTINGS = 2000
# Results of a query up to which blocks of documents are scored; more are grouped by Spark.
BLOCK_RESULTS = 1000
# Share of the floor that left-out terms may add up to: more would leave fewer
# postings to sum but many more documents to score exactly.
LEFT_OUT_SHARE = 0.1
# Float sums in another order differ in the last digits only.
SLACK = 1e-9

_WEIGHTED = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("term", T.StringType()),
    T.StructField("idf", T.DoubleType()),
])


def best_documents(index: SearchIndex, q: str, k: int | None, use_tf: bool = False) -> DataFrame:
    """`(qid, doc_id, score, rank)` of one query, all that match if `k` is None; the frame itself is lazy."""
    spark = index.spark
    tokens = spark.range(1).select(tx.query_tokens(F.lit(q)).alias("t")).first()["t"]
    known = {
        row["term"]: row["idf"]
        for row in index.term_stats.filter(F.col("term").isin(*set(tokens)))
        .select("term", scoring.idf(F.lit(index.n_docs), F.col("df")).alias("idf"))
        .collect()
    } if tokens else {}
    weighted = spark.createDataFrame(
        [(0, pos, t, known[t]) for pos, t in enumerate(tokens) if t in known], _WEIGHTED
    )
    postings = lookup(index.postings, sorted(known))
    hits = postings.join(F.broadcast(weighted), "term")
    worth = ranking.with_contributions(hits, index.avgdl, use_tf)
    known_at = [pos for pos, token in enumerate(tokens) if token in known]
    if len(known_at) <= ranking.MAX_POSITION_COLUMNS:
        scored = ranking.scores_by_position(worth, known_at)
    else:
        scored = ranking.scores(worth)
    if k is None or k > MAX_PUSHED_IDS:
        ranked = numbered(scored, ranking.result_order(), "rank")
        if k is not None:
            ranked = ranked.filter(F.col("rank") <= k)
        return ranked.withColumn("rank", F.col("rank").cast("int")).drop("first_pos")
    best = scored.orderBy(*ranking.result_order()).limit(k)
    order = Window.orderBy(*ranking.result_order())  # MAX_PUSHED_IDS rows at most
    return best.withColumn("rank", F.row_number().over(order)).drop("first_pos")


def search(
    index: SearchIndex, q: str, k: int | None = scoring.DEFAULT_K, use_tf: bool = False
) -> DataFrame:
    """Top-k result rows of one query, ordered by rank; `k=None` is every match."""
    ranked = best_documents(index, q, k, use_tf)
    documents = index.documents
    fits = k is not None and k * RESULT_ROW_BYTES <= broadcast_limit(index.spark)
    if k is not None and k <= MAX_PUSHED_IDS:
        # the k ids become a literal list: pushed to Parquet it skips row groups
        # of the metadata, which a join would scan in full
        rows = ranked.collect()
        ranked = index.spark.createDataFrame(rows, ranked.schema)
        documents = documents.filter(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    return ranking.with_metadata(ranked, documents, fits=fits).orderBy("rank").drop("qid")


def search_batch(
    index: SearchIndex,
    queries: DataFrame,
    k: int = scoring.DEFAULT_K,
    use_tf: bool = False,
    bounded: bool | None = None,
) -> DataFrame:
    """`(qid, rank, id, url, title, snippet, score)` for a table `(qid, q)`.

    `bounded` picks the plan. The default is the exhaustive one: it makes no row per
    query and document, of which the bounded one writes those that may reach the top k.

    Queries with the same token list are scored once, under their smallest qid.
    """
    spark = index.spark
    parsed = queries.select(
        "qid", F.concat_ws(" ", tx.query_tokens(F.col("q"))).alias("words")
    ).filter(F.col("words") != "")
    parsed = stored(parsed, "queries")
    lists = stored(
        parsed.groupBy("words").agg(F.min("qid").alias("list_id"), F.count(F.lit(1)).alias("copies")),
        "token-lists",
    )
    size = lists.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("queries")).first()
    terms = lists.select(
        F.col("list_id").alias("qid"), F.posexplode(F.split("words", " ")).alias("pos", "term")
    )
    fits = fits_broadcast(terms)
    weighted = stored(
        ranking.weighted_terms(terms, index.term_stats, index.n_docs, fits), "query-terms"
    )
    if not bounded and 0 < k <= BLOCK_RESULTS:
        ranked = blocks.best_documents(index.postings, weighted, index.avgdl, k, use_tf)
    else:
        scored = (bounded_scores if bounded else exhaustive_scores)(index, weighted, k, use_tf, fits)
        ranked = ranking.top_k(scored, k)
    few = fits and size["n"] * k * RESULT_ROW_BYTES <= broadcast_limit(spark)
    results = ranking.with_metadata(ranked, index.documents, fits=few)
    if size["n"] == (size["queries"] or 0):
        return results
    # hand the rows of each token list to every query that has it
    return _per_query(parsed, lists, results)


def _per_query(parsed: DataFrame, lists: DataFrame, results: DataFrame) -> DataFrame:
    """Both joins spread a token list that very many queries share."""
    owners = spread_join(parsed, lists, "words", "copies", "qid").select("qid", "list_id")
    weights = lists.select(F.col("list_id").alias("qid"), "copies")
    rows = results.join(F.broadcast(weights) if fits_broadcast(weights) else weights, "qid")
    rows = stored(rows.withColumnRenamed("qid", "list_id"), "list-results")
    return spread_join(owners, rows, "list_id", "copies", "qid").select(
        "qid", "rank", "id", "url", "title", "snippet", "score"
    )


def exhaustive_scores(
    index: SearchIndex, weighted: DataFrame, k: int, use_tf: bool, fits: bool
) -> DataFrame:
    hits = ranking.candidates(index.postings, weighted, fits)
    return ranking.scores(ranking.with_contributions(hits, index.avgdl, use_tf))


def term_bounds(weighted: DataFrame, avgdl: float, use_tf: bool) -> DataFrame:
    """Per query, distinct terms from rare to frequent with running totals.

    `cap` is the most a term can add to any document, `rest_cap` what the term and
    all more frequent ones can add together, `cum_df` the postings up to the term.
    A window partition holds one query's terms.
    """
    # a document without a length scores as an average one
    shortest = F.least(F.col("min_length").cast("double"), F.when(F.col("length_unknown"), F.lit(avgdl)))
    most = (
        F.col("idf") * F.lit(scoring.K1 + 1.0) if use_tf
        else scoring.contribution(F.col("idf"), F.lit(1), shortest, F.lit(avgdl))
    )
    order = Window.partitionBy("qid").orderBy("df", "term")
    return (
        weighted.groupBy("qid", "term")
        .agg(F.max("df").alias("df"), F.max("idf").alias("idf"),
             F.sum(most).alias("cap"), F.count(F.lit(1)).alias("times"))
        .select(
            "qid", "term", "df", "idf", "times", "cap",
            F.row_number().over(order).alias("nth"),
            F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_df"),
            F.sum("cap").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest_cap"),
        )
    )


def _partial_sums(index: SearchIndex, terms: DataFrame, use_tf: bool, fits: bool) -> DataFrame:
    """Per `(qid, doc_id)` the plain sum over the given terms (any order)."""
    hits = ranking.candidates(index.postings, terms, fits)
    worth = ranking.with_contributions(hits, index.avgdl, use_tf)
    return worth.groupBy("qid", "doc_id").agg(F.sum(F.col("c") * F.col("times")).alias("partial"))


def _floors(partials: DataFrame, k: int, signed: DataFrame) -> DataFrame:
    """Per query with at least k partial scores, just under the k-th best of them.

    `signed`: queries whose scores may sink as terms are added; they get none.
    """
    best_first = Window.partitionBy("qid").orderBy(F.col("partial").desc())
    return (
        partials.join(signed, "qid", "left_anti").withColumn("nth_best", F.row_number().over(best_first))
        .filter(F.col("nth_best") <= k)
        .groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("partial").alias("least"))
        .filter(F.col("n") == k)
        .select("qid", (F.col("least") * (1 - SLACK)).alias("floor"))
    )


def bounded_scores(
    index: SearchIndex, weighted: DataFrame, k: int, use_tf: bool, fits: bool
) -> DataFrame:
    """Exact scores of a set of documents that contains every query's top k.

    1. The k-th best sum over a query's rarest terms is a floor for its k-th score.
    2. Frequent terms that together stay well under the floor cannot lift a document
       into the top k by themselves: only documents with one of the other terms
       are summed, over those terms.
    3. These sums give a higher floor; what cannot reach it even with all the terms
       left out is dropped, and the few documents left are scored exactly.

    A partial score never exceeds the full one, so every floor is a valid bound. The
    exception is a term with more postings than the corpus has documents (postings that
    outlived their documents): its weight is negative, and its queries get no floor.
    """
    small = F.broadcast if fits else (lambda df: df)  # one row per query at most
    bounds = stored(term_bounds(weighted, index.avgdl, use_tf), "term-bounds")
    seeds = bounds.filter((F.col("cum_df") <= SEED_POSTINGS) | (F.col("nth") == 1))
    signed = stored(bounds.filter("idf < 0").select("qid").distinct(), "signed-queries")
    first_floors = _floors(_partial_sums(index, seeds, use_tf, fits), k, small(signed))
    terms = stored(
        bounds.join(small(first_floors), "qid", "left").withColumn(
            "needed",
            F.col("floor").isNull() | (F.col("rest_cap") >= F.col("floor") * LEFT_OUT_SHARE),
        ),
        "needed-terms",
    )
    left_out = terms.groupBy("qid").agg(
        F.coalesce(F.max("floor"), F.lit(float("-inf"))).alias("floor"),
        F.coalesce(F.sum(F.when(~F.col("needed"), F.col("cap"))), F.lit(0.0)).alias("rest"),
    )
    sums = _partial_sums(index, terms.filter("needed").drop("floor"), use_tf, fits)
    reaching = stored(
        sums.join(small(left_out), "qid").filter(F.col("partial") + F.col("rest") >= F.col("floor"))
        .select("qid", "doc_id", "partial", "rest"),
        "reaching",
    )
    final_floors = _floors(reaching, k, small(signed))
    contenders = (
        reaching.join(small(final_floors), "qid", "left")
        .filter(F.col("floor").isNull() | (F.col("partial") + F.col("rest") >= F.col("floor")))
        .select("qid", "doc_id")
    )
    return _score_documents(index, weighted, stored(contenders, "contenders"), use_tf, fits)


def _score_documents(
    index: SearchIndex, weighted: DataFrame, pairs: DataFrame, use_tf: bool, fits: bool
) -> DataFrame:
    """Scores of given `(qid, doc_id)` pairs over all terms of the query.

    The pairs carry their query's terms to the documents' buckets; the join is on
    `doc_id` alone, so the postings stay in the buckets they are stored in.
    """
    words = weighted.select("term").distinct()
    documents = pairs.select("doc_id").distinct()
    if fits_broadcast(documents):
        documents = F.broadcast(documents)
    own = (
        index.postings
        .join(documents, "doc_id", "left_semi")
        .join(F.broadcast(words) if fits else words, "term", "left_semi")
    )
    terms = weighted.groupBy("qid").agg(F.collect_list(F.struct("term", "pos", "idf")).alias("asked"))
    wanted = pairs.join(F.broadcast(terms) if fits else terms, "qid")
    met = own.join(wanted, "doc_id").withColumn("a", F.explode(F.filter("asked", lambda a: a["term"] == F.col("term"))))
    hits = met.select("qid", "doc_id", "term", "tf", "doc_length", "a.pos", "a.idf")
    return ranking.scores(ranking.with_contributions(hits, index.avgdl, use_tf))
