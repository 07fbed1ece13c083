"""What bounds the memory of a task: the text of a bucket, the rows of a range, no sort of hits."""

from pyspark.sql import functions as F

from harrow.operators import blocks, ranking
from harrow.operators import order as ordering
from harrow.operators.order import numbered
from harrow.plans import search as plans
from harrow.sources.index_store import build_index, default_buckets


def test_text_of_a_bucket_is_bounded(spark):
    for gigabytes in (1, 6, 60):
        size = gigabytes * 10 ** 9
        assert size / default_buckets(spark, size) <= 9_000_000
    assert default_buckets(spark, 20 * 10 ** 12) < 100_000  # Spark's limit


def test_hits_are_not_sorted_for_their_lengths(spark):
    index = build_index(spark.createDataFrame(
        [(n, f"u{n}", "", f"the word{n % 7}") for n in range(50)], "doc_id long, url string, title string, text string"))
    terms = ranking.query_terms(spark.createDataFrame([(1, "the word3")], "qid long, q string"))
    weighted = ranking.weighted_terms(terms, index.term_stats, index.n_docs, fits=True)
    hits = ranking.candidate_set(ranking.candidates(index.postings, weighted, True))
    plan = ranking.with_lengths(hits, index.documents)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [doc_id" in plan and "SortMergeJoin [doc_id" not in plan


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    seen = []
    monkeypatch.setattr(ordering, "stored", lambda df, label: seen.append((label, df)) or df.localCheckpoint())
    rows = spark.range(0, 5000, 1, 4).select((F.col("id") * 7919 % 5000).alias("x"))
    found = numbered(rows, [F.col("x")], "n")
    assert sorted(map(tuple, found.collect())) == [(x, x + 1) for x in range(5000)]
    ranges = dict(seen)["ranges"]
    assert ranges.groupBy("_range").count().agg(F.max("count")).first()[0] < 500


def test_a_task_scores_one_bucket(spark):
    index = build_index(spark.createDataFrame(
        [(n, f"u{n}", "", f"the word{n % 7} some") for n in range(200)], "doc_id long, url string, title string, text string"),
        buckets=40)
    terms = ranking.query_terms(spark.createDataFrame([(1, "the word3"), (2, "some the")], "qid long, q string"))
    weighted = ranking.weighted_terms(terms, index.term_stats, index.n_docs, fits=True).localCheckpoint()
    hits = ranking.candidates(index.postings, weighted, True)
    bounds = plans.term_bounds(weighted, index.avgdl, False).localCheckpoint()
    for found in (
        ranking.candidate_set(hits),
        ranking.scores(ranking.with_contributions(hits, index.avgdl)),
        plans._partial_sums(index, bounds, False, True),
        plans.best_documents(index, "the word3", 10),
        blocks.best_documents(index.postings, weighted, index.avgdl, 10),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "postings" in line)
        assert "Bucketed: true" in scan and "SelectedBucketsCount: 40 out of 40" in scan
        # what is hashed or sorted by document lies in its bucket: no exchange until the rows are digested or cut to k
        assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(qid#" not in plan.split("WindowGroupLimit")[-1]
