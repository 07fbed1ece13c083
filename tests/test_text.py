import pytest
from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions.urls import is_valid_url


def one(spark, value, expression, kind="string"):
    row = spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()
    return row["r"]


@pytest.mark.parametrize("text, expected", [
    ("Red Green-BLUE", ["red", "green", "blue"]),
    ("x xy xyz 12 123 x1 x12", ["xyz", "123", "x12"]),
    ("up/down; left (right)? no.", ["down", "left", "right"]),
    ("réaile", ["aile"]),
    ("Kelvin", ["elvin"]),
    ("İstanbul", ["stanbul"]),
    ("x1y2 under_score", ["x1y2", "under", "score"]),
    ("the the", ["the", "the"]),
    ("", []),
])
def test_index_tokens(spark, text, expected):
    assert one(spark, text, tx.index_tokens) == expected
    assert one(spark, text, tx.token_count) == len(expected)


@pytest.mark.parametrize("query, expected", [
    ("Red Green", ["red", "green"]),
    ("green-blue", ["greenblue"]),
    ("réaile", ["raile"]),
    ("foo bar", ["foo", "bar"]),
    ("foo bar　baz\x1cqux", ["foo", "bar", "baz", "qux"]),
    ("tion tion", ["tion", "tion"]),
    ("a zz", []),
    ("Kelvin", ["kelvin"]),
    ("don't stop", ["dont", "stop"]),
    ("", []),
])
def test_query_tokens(spark, query, expected):
    assert one(spark, query, tx.query_tokens) == expected


@pytest.mark.parametrize("url, expected", [
    ("http://a.b", True), ("http://a", False), ("HTTP://a.example", False),
    ("ftp://a.example.org", False), ("https://example.com", True), ("https://", False),
    (" http://a.example", False), (None, False), ("http://é.b", True),
])
def test_valid_url(spark, url, expected):
    assert one(spark, url, is_valid_url) is expected


@pytest.mark.parametrize("path, expected", [
    ("/shared_data/a.gz", "a.gz"), ("c\\d.gz", "d.gz"), ("plain", "plain"), ("/", ""), ("a/b\\c", "c"),
])
def test_base_name(spark, path, expected):
    assert one(spark, path, tx.base_name) == expected


@pytest.mark.parametrize("item, expected", [
    ("12abc", 12), ("  -7", -7), ("+5", 5), ("x9", None), ("99999999999", None), ("", None),
    ("2147483647", 2147483647), ("2147483648", None),
])
def test_leading_int(spark, item, expected):
    assert one(spark, item, tx.leading_int) == expected


def test_snippet(spark):
    assert one(spark, " a\r\nb \t c ", tx.snippet) == "a b c"
    assert one(spark, "é" * 300, tx.snippet) == "é" * 200


def test_posting_ids(spark):
    assert one(spark, "1,10,2", tx.posting_ids) == [1, 10, 2]


def test_fallbacks(spark):
    rows = spark.createDataFrame([("", "u"), (None, "u"), ("t", "u")], "title string, url string")
    got = rows.select(tx.filled(F.col("title"), F.col("url")).alias("r")).collect()
    assert [r["r"] for r in got] == ["u", "u", "t"]
