"""The plans that scale must stay the plans that run."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from harrow.operators import frontier, indexing, ranking
from harrow.plans import catalogue, search as plans
from harrow.sources.index_store import lookup


@pytest.fixture(scope="module")
def index(spark):
    return catalogue.documents_index(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def weighted(spark, index):
    asked = catalogue._benchmark(spark, "/root/testdata/sf0.001")
    return ranking.weighted_terms(ranking.query_terms(asked), index.term_stats, index.n_docs, True)


def test_lookup_is_pushed(index):
    assert "PushedFilters: [In(term, [and,the])]" in plan_of(lookup(index.postings, ["and", "the"]))


def test_scoring_does_not_shuffle_postings(index, weighted):
    hits = ranking.candidates(index.postings, weighted, True)
    plan = plan_of(ranking.scores(ranking.with_contributions(hits, index.avgdl)))
    top = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in top and "Bucketed: true" in plan


def test_top_k_is_limited_before_its_exchange(index, weighted):
    hits = ranking.candidates(index.postings, weighted, True)
    plan = plan_of(ranking.top_k(ranking.scores(ranking.with_contributions(hits, index.avgdl))))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    exchange = plan.index("Exchange hashpartitioning(qid")
    assert "WindowGroupLimit" in plan[exchange:]


def test_single_search_takes_ordered(index):
    plan = plan_of(plans.best_documents(index, "the and tion", 10))
    assert "TakeOrderedAndProject" in plan
    assert "Exchange" not in plan[plan.index("TakeOrderedAndProject"):plan.index("BroadcastHashJoin")]


def test_single_search_reads_metadata_of_its_results_only(index):
    plan = plan_of(plans.search(index, "the and tion", 5))
    assert "doc_id" in plan and "PushedFilters: [In(doc_id" in plan


def test_postings_are_counted_inside_buckets(index):
    plan = plan_of(indexing.count_terms(index.documents, "doc_length"))
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "ReadSchema: struct<doc_id:bigint,doc_length:int,text:string>" in plan


def test_lengths_join_inside_buckets(index, weighted, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = ranking.candidates(index.postings, weighted, True)
        plan = plan_of(ranking.with_lengths(hits, index.documents))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan[: plan.index("BroadcastHashJoin")]


def test_known_urls_are_not_broadcast_whole(spark):
    queue = spark.createDataFrame([(1, "http://a.example")], "seq long, url string")
    known = spark.read.schema("page_id long, url string").parquet("/root/testdata/sf0.001/pages.parquet")
    plan = plan_of(frontier.accept_urls(queue, known))
    assert plan.count("BroadcastHashJoin") == 2 and "LeftSemi, BuildRight" in plan and "LeftAnti, BuildRight" in plan


def test_scans_read_needed_columns_only(spark):
    folder = "/root/testdata/sf0.001"
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(catalogue.doc_lengths(spark, folder))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan_of(
        catalogue._pages(spark, folder).select("doc_id", "url").filter(F.length("url") > 3)
    )
