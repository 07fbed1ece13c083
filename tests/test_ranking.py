"""Ranks and ties against a small independent model in plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.operators import indexing, ranking, stats
from harrow.operators.highlight import highlighted
from harrow.operators.joins import spread_join
from harrow.operators.order import numbered
from harrow.plans import search as plans
from harrow.session import fits_broadcast
from harrow.sources.index_store import build_index, open_index

WORDS = "the and ing tion ent ion alpha beta gamma delta omega rare1 rare2 rare3".split()


def corpus(n=60, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        length = rng.choice([0, 3, 3, 5, 8, 20]) if i else 4
        text = " ".join(rng.choice(WORDS[: 3 + i % 12]) for _ in range(length))
        rows.append((i, f"http://h.example/{i}", "" if i % 3 else f"Title {i}", text))
    rows.append((n, "http://h.example/none", None, None))  # never fetched
    return rows


QUERIES = [
    (1, "the and tion tion"), (2, "rare1"), (3, "rare1 rare2 the"), (4, "a zz"), (5, "   "),
    (6, "The AND tion tion!"), (7, "nothing matches here"), (8, "the the the and ing ent ion alpha beta"),
    (9, "gamma the"), (10, "omega-gamma delta"), (11, "THE"), (12, "rare3 rare2 rare1 omega delta gamma"),
]


def tokens_of_query(q):
    return [t for t in re.sub(r"[^a-z0-9\s]", "", q.lower()).split() if len(t) > 2]


class Model:
    def __init__(self, rows):
        self.meta = {r[0]: r for r in rows}
        tokens = {r[0]: re.findall("[a-z0-9]{3,}", (r[3] or "").lower()) for r in rows}
        self.length = {d: len(t) for d, t in tokens.items()}
        self.docs = {}
        for d, t in tokens.items():
            for w in set(t):
                self.docs.setdefault(w, []).append(d)
        self.n = len(rows) or 1
        self.avg = (sum(self.length.values()) / len(rows) if rows else 0) or 100.0

    def top(self, q, k=10):
        score, first = {}, {}
        for pos, w in enumerate(tokens_of_query(q)):
            ids = self.docs.get(w, [])
            weight = math.log((self.n - len(ids) + 0.5) / (len(ids) + 0.5) + 1)
            for d in ids:
                dl = self.length[d] or self.avg
                score[d] = score.get(d, 0.0) + weight * 2.5 / (1 + 1.5 * (0.25 + 0.75 * (dl / self.avg)))
                first.setdefault(d, pos)
        return sorted(score.items(), key=lambda i: (-i[1], first[i[0]], str(i[0])))[:k]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def index(spark, rows):
    return build_index(spark.createDataFrame(rows, "doc_id long, url string, title string, text string"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid long, q string")


def expected(rows, k=10):
    model = Model(rows)
    return {
        (qid, rank): pair
        for qid, q in QUERIES
        for rank, pair in enumerate(model.top(q, k), 1)
    }


def compare(got, want):
    assert {(r["qid"], r["rank"]): r["id"] for r in got} == {key: d for key, (d, _) in want.items()}
    for r in got:
        assert r["score"] == pytest.approx(want[r["qid"], r["rank"]][1], rel=1e-12)


@pytest.mark.parametrize("bounded", [False, True, None])
@pytest.mark.parametrize("k", [1, 10])
def test_batch_matches_model(index, queries, rows, bounded, k):
    compare(plans.search_batch(index, queries, k=k, bounded=bounded).collect(), expected(rows, k))


@pytest.mark.parametrize("bounded", [False, True])
def test_batch_beyond_broadcast(index, queries, rows, bounded, no_broadcast):
    compare(plans.search_batch(index, queries, bounded=bounded).collect(), expected(rows))


@pytest.mark.parametrize("seed_postings", [1, 5, 50])
@pytest.mark.parametrize("share", [0.05, 1.0])
def test_bounds_are_exact_for_any_setting(index, queries, rows, seed_postings, share, monkeypatch):
    monkeypatch.setattr(plans, "SEED_POSTINGS", seed_postings)
    monkeypatch.setattr(plans, "LEFT_OUT_SHARE", share)
    compare(plans.search_batch(index, queries, k=3, bounded=True).collect(), expected(rows, 3))


@pytest.mark.parametrize("use_tf", [False, True])
def test_bounded_equals_exhaustive(index, queries, use_tf):
    got = [
        sorted(map(tuple, plans.search_batch(index, queries, k=4, use_tf=use_tf, bounded=b).collect()))
        for b in (False, True)
    ]
    assert got[0] == got[1]


def test_single_search_matches_model(index, rows):
    model = Model(rows)
    for _, q in QUERIES:
        got = plans.search(index, q).collect()
        want = model.top(q)
        assert [(r["rank"], r["id"]) for r in got] == [(n, d) for n, (d, _) in enumerate(want, 1)]
        assert [r["score"] for r in got] == pytest.approx([s for _, s in want], rel=1e-12)


def test_long_single_query(index, rows):
    q = " ".join(WORDS * 4)
    assert [r["id"] for r in plans.search(index, q).collect()] == [d for d, _ in Model(rows).top(q)]


def test_metadata_fallbacks(index, rows):
    for r in plans.search(index, "the and").collect():
        title, text = rows[r["id"]][2], rows[r["id"]][3]
        assert r["title"] == (title or rows[r["id"]][1])
        assert r["snippet"] == text[:200]


def test_missing_metadata_drops_after_the_cut(spark):
    ranked = spark.createDataFrame(
        [(1, 1, 5, 2.0), (1, 2, 6, 1.0), (1, 3, 7, 0.5)], "qid long, rank int, doc_id long, score double"
    )
    documents = spark.createDataFrame(
        [(5, "u5", "", None), (7, "u7", None, "")], "doc_id long, url string, title string, snippet string"
    )
    for fits in (True, False):
        got = ranking.with_metadata(ranked, documents, fits).orderBy("rank").collect()
        assert [(r["rank"], r["id"], r["title"], r["snippet"]) for r in got] == [
            (1, 5, "u5", "No preview available."), (3, 7, "u7", "No preview available."),
        ]


def test_ties_follow_first_token_then_id_string(spark):
    rows = [(9, "u", "", "aaa fill"), (10, "u", "", "aaa fill"), (2, "u", "", "bbb fill"), (1, "u", "", "bbb fill")]
    index = build_index(spark.createDataFrame(rows, "doc_id long, url string, title string, text string"))
    assert [r["id"] for r in plans.search(index, "aaa bbb").collect()] == [10, 9, 1, 2]
    assert [r["id"] for r in plans.search(index, "bbb aaa").collect()] == [1, 2, 10, 9]


@pytest.mark.parametrize("length", [None, 0, 50])
def test_unknown_length_counts_as_average(spark, length):
    hit = spark.createDataFrame([(1, 0, 1, 1.5, length)], "qid long, pos int, doc_id long, idf double, doc_length int")
    assert ranking.with_contributions(hit, 50.0).first()["c"] == pytest.approx(1.5 * 2.5 / 2.5)


def test_corpus_stats_defaults(spark):
    empty = spark.createDataFrame([], "doc_id long, doc_length int")
    assert tuple(stats.corpus_stats(empty).first()) == (1, 100.0)
    zeros = spark.createDataFrame([(1, 0), (2, None), (3, 0)], "doc_id long, doc_length int")
    assert tuple(stats.corpus_stats(zeros).first()) == (3, 100.0)
    some = spark.createDataFrame([(1, 0), (2, None), (3, 9)], "doc_id long, doc_length int")
    assert tuple(stats.corpus_stats(some).first()) == (3, 4.5)


def test_properties(index):
    terms = index.term_stats.collect()
    assert all(1 <= r["df"] <= index.n_docs for r in terms)
    assert index.postings.select("term", "doc_id").distinct().count() == index.postings.count()


def test_reopened_version(spark, index, queries, rows):
    again = open_index(spark, index.path)
    assert (again.n_docs, again.avgdl, again.buckets) == (index.n_docs, index.avgdl, index.buckets)
    compare(plans.search_batch(again, queries).collect(), expected(rows))


def test_empty_corpus(spark, queries):
    index = build_index(spark.createDataFrame([], "doc_id long, url string, title string, text string"))
    assert (index.n_docs, index.avgdl) == (1, 100.0)
    assert plans.search(index, "the").collect() == []
    assert plans.search_batch(index, queries).collect() == []


def test_responses_and_counts(spark, index, queries):
    import json

    results = plans.search_batch(index, queries, k=3)
    counts = {r["qid"]: r["result_count"] for r in ranking.result_counts(queries, results).collect()}
    assert counts[4] == counts[5] == counts[7] == 0 and counts[1] == 3
    asked = dict(QUERIES)
    for row in ranking.responses(queries, results, F.lit(12.3456)).collect():
        response = json.loads(row["response"])
        assert response["query"] == asked[row["qid"]].lower()
        assert response["meta"] == {"count": counts[row["qid"]], "latency_ms": 12.35}
        assert len(response["results"]) == counts[row["qid"]]
        assert all(set(r) == {"id", "url", "title", "snippet", "score"} for r in response["results"])
        ranked = [r["score"] for r in response["results"]]
        assert ranked == sorted(ranked, reverse=True)


def test_spread_join_cuts_heavy_keys(spark, no_broadcast):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id"
    )
    small = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = spread_join(big, small, "key", "n", "id", fits=False, rows_per_task=100)
    assert joined.count() == 3000
    assert joined.select("id").distinct().count() == 3000
    assert joined.filter("key = 'hot'").agg(F.max("n")).first()[0] == 1000
    assert not fits_broadcast(small)


def test_long_posting_lists_come_in_parts(spark):
    ids = [i * 7919 ** 3 % 10 ** 15 for i in range(1, 1200)]  # sparse ids of many lengths
    postings = spark.createDataFrame([("hot", i) for i in ids] + [("rare", 10), ("rare", 2), ("rare", 1)],
                                     "term string, doc_id long")
    strings = indexing.posting_strings(postings, max_ids=100)
    rows = strings.collect()
    hot = sorted((r["part"], r["first_pos"], r["doc_ids"]) for r in rows if r["term"] == "hot")
    assert [len(s.split(",")) for _, _, s in hot] == [100] * 11 + [99]
    assert [first for _, first, _ in hot] == list(range(0, 1200, 100))
    assert ",".join(s for _, _, s in hot) == ",".join(sorted(map(str, ids)))
    assert [r["doc_ids"] for r in rows if r["term"] == "rare"] == ["1,10,2"]
    parsed = [(r["pos"], r["doc_id"]) for r in indexing.parse_posting_strings(strings).collect() if r["term"] == "hot"]
    assert sorted(parsed) == list(enumerate(sorted(ids, key=str)))


def test_numbered_rows_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = numbered(rows, [F.col("v").desc()], "nth").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["nth"])] == sorted((r["v"] for r in got), reverse=True)
    assert sorted(r["nth"] for r in got) == list(range(1, 5001))
    assert numbered(rows.limit(0), [F.col("v")], "nth").count() == 0


def test_bounds_hold_where_lengths_are_missing(spark):
    """Postings of a document that lost its text, and of one without a row, count as average."""
    rng = random.Random(11)
    rows, postings = [], []
    for n in range(300):
        length = rng.choice([5, 9, 30, 200])
        rows.append((n, f"http://h.example/{n}", "", " ".join(["freq0", f"rare{n % 3}", *["fill"] * length]) if n else None))
        postings += [("freq0", n, 1), (f"rare{n % 3}", n, 1)]
    rows.append((301, "http://h.example/301", "", "rare0 freq0"))
    postings += [("rare0", 301, 1), ("freq0", 301, 1), ("rare0", 999, 1), ("freq0", 999, 1)]
    index = build_index(spark.createDataFrame(rows, "doc_id long, url string, title string, text string"),
                        postings=spark.createDataFrame(postings, "term string, doc_id long, tf int"))
    asked = spark.createDataFrame([(1, "rare0 freq0"), (2, "freq0 rare1"), (3, "rare2")], "qid long, q string")
    for seeds in (1, 50, 2000):
        for k in (1, 3, 40):
            plans.SEED_POSTINGS, kept = seeds, plans.SEED_POSTINGS
            try:
                both = [sorted(map(tuple, plans.search_batch(index, asked, k=k, bounded=b).collect())) for b in (True, False)]
            finally:
                plans.SEED_POSTINGS = kept
            assert both[0] == both[1]
    assert plans.search(index, "rare0 freq0", k=1).first()["id"] == 301


def test_search_of_any_depth(index, monkeypatch):
    shallow = [tuple(r) for r in plans.search(index, "the and ing tion", k=40).collect()]
    monkeypatch.setattr(plans, "MAX_PUSHED_IDS", 3)
    assert [tuple(r) for r in plans.search(index, "the and ing tion", k=40).collect()] == shallow


def test_many_copies_of_a_query(spark, index, no_broadcast):
    asked = spark.createDataFrame([(n, "the and tion tion") for n in range(50)] + [(99, "gamma the")], "qid long, q string")
    rows = plans.search_batch(index, asked, k=3).collect()
    assert len(rows) == 51 * 3
    assert len({tuple(r)[1:] for r in rows if r["qid"] < 50}) == 3


def test_highlight(spark):
    text = "filler words here. " * 20 + "the Apple pie and apple tart stand by grapple. " + "more filler. " * 20
    documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
    results = spark.createDataFrame([(1, 1, 1)], "qid long, rank int, id long")
    queries = spark.createDataFrame([(1, "apple tart!")], "qid long, q string")
    for fits in (True, False):
        preview = highlighted(results, queries, documents, fits).first()["preview"]
        assert "<b>Apple</b> pie and <b>apple</b> <b>tart</b> stand by grapple" in preview
        assert len(re.sub("</?b>", "", preview)) <= 150


def test_cut_words_are_not_marked(spark):
    text = "x" * 146 + " nation " + "y" * 66 + " then the end"
    documents = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    results = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 2)], "qid long, rank int, id long")
    queries = spark.createDataFrame([(1, "tion nat"), (2, "the"), (3, "?"), (4, "the")], "qid long, q string")
    got = {r["qid"]: r["preview"] for r in highlighted(results, queries, documents).collect()}
    assert "<b>" not in got[1] and got[1] == text[:150] and got[3] == text[:150] and got[4] == ""
    assert "then <b>the</b> end" in got[2]
