from harrow.functions.urls import SEED_URL
from harrow.operators import documents as docs
from harrow.operators import frontier as fr
from harrow.operators import indexing

QUEUE = [
    (1, "http://a.example"), (2, "http://b.example"), (3, "http://a.example"), (4, None),
    (5, "ftp://c.example.org"), (6, "http://b.example"), (7, "http://d.example"), (8, "http://D.example"),
]


def queue(spark):
    return spark.createDataFrame(QUEUE, "seq long, url string")


def check_accept(spark):
    known = spark.createDataFrame([(1, "http://b.example")], "doc_id long, url string")
    got = fr.accept_urls(queue(spark), known).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(1, "http://a.example"), (7, "http://d.example"), (8, "http://D.example")]


def test_accept_urls(spark):
    check_accept(spark)


def test_accept_urls_beyond_broadcast(spark, no_broadcast):
    check_accept(spark)


def test_seed(spark):
    assert fr.seed_frontier(queue(spark)).count() == len(QUEUE)
    seeded = fr.seed_frontier(queue(spark).filter("seq > 100")).collect()
    assert [(r["seq"], r["url"]) for r in seeded] == [(0, SEED_URL)]


def test_clean_and_parse(spark):
    assert fr.clean_queue(queue(spark)).count() == 7
    items = spark.createDataFrame([("12abc",), ("  -7",), ("x9",), ("99999999999",), (None,)], "item string")
    assert [r["doc_id"] for r in fr.parse_doc_ids(items).collect()] == [12, -7]


def log(spark):
    return spark.createDataFrame([
        (1, 1, "u1", "processing", None, None, None, None, None, None),
        (1, 2, None, "crawled", "f", 10, 20, None, None, None),
        (1, 3, None, None, None, None, None, 33, "t", "s"),
        (2, 1, "u2", "processing", None, None, None, None, None, None),
        (3, 1, "u3", "processing", None, None, None, None, None, None),
        (3, 2, None, "crawled", "f", 30, 5, None, None, None),
    ], "doc_id long, seq long, url string, status string, file_path string, offset long, "
       "length long, doc_length int, title string, snippet string")


def test_document_state(spark):
    state = {r["doc_id"]: r for r in docs.document_state(log(spark)).collect()}
    one = state[1]
    assert (one["status"], one["offset"], one["doc_length"], one["url"]) == ("crawled", 10, 33, "u1")
    assert state[2]["status"] == "processing" and state[2]["file_path"] is None


def test_lookups(spark):
    state = docs.document_state(log(spark))
    assert {r["doc_id"] for r in docs.documents_by_status(state, "crawled").collect()} == {1, 3}
    ids = spark.createDataFrame([(3,), (3,), (9,)], "doc_id long")
    assert [r["doc_id"] for r in docs.documents_by_ids(state, ids).collect()] == [3]
    assert [r["doc_id"] for r in docs.first_documents(state, 2).collect()] == [1, 2]
    indexed = spark.createDataFrame([(1,)], "doc_id long")
    assert [tuple(r) for r in docs.not_indexed(state, indexed).collect()] == [(3, "crawled_not_queued")]


def postings(spark, rows):
    return spark.createDataFrame(rows, "term string, doc_id long")


def check_postings(spark):
    old = postings(spark, [("a", 1), ("b", 1), ("a", 2)])
    new = postings(spark, [("a", 1), ("c", 1), ("a", 3)])
    assert sorted(map(tuple, indexing.unseen_postings(new, old).collect())) == [("a", 3), ("c", 1)]
    assert indexing.unseen_postings(new.filter("doc_id > 9"), old).count() == 0
    merged = sorted(map(tuple, indexing.merge_postings(old, new).collect()))
    assert merged == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)]


def test_postings_sets(spark):
    check_postings(spark)


def test_postings_sets_beyond_broadcast(spark, no_broadcast):
    check_postings(spark)


def check_duplicates(spark):
    rows = spark.createDataFrame([(4, "x"), (2, "x"), (3, "y"), (5, "x"), (6, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"]) for r in indexing.exact_duplicates(rows).collect()}
    assert got == {(2, 2), (4, 2), (5, 2)}


def test_exact_duplicates(spark):
    check_duplicates(spark)


def test_exact_duplicates_beyond_broadcast(spark, no_broadcast):
    check_duplicates(spark)


def test_folded_terms(spark):
    rows = spark.createDataFrame([(1, "Étude the étude réaile")], "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "term string")
    assert {r["term"] for r in indexing.folded_terms(rows, stop).collect()} == {"etude", "reaile"}
