import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.functions.markup import read_page
from harrow.operators.extract import extract_pages, nonempty_pages


def words(html):
    return re.findall("[A-Za-z0-9]+", read_page(html)[0])


@pytest.mark.parametrize("html, expected", [
    ("<ul><li>first<li>second<ul><li>inner</ul></ul>last", ["first", "second", "inner", "last"]),
    ("<div>before<script>if (x < y) { '<p>' }</script>after</div>", ["before", "after"]),
    ("<style media=print>@page { size: a4 }</style><h1>seen</h1><style>h2{}</style>", ["seen"]),
    ("nul\0splits", ["nul", "splits"]),
    ("a<b>c</b>d", ["a", "c", "d"]),
    ("foo<br>bar", ["foo", "bar"]),
    ("x<!-- y -->z", ["x", "z"]),
    ("foo</i>bar", ["foobar"]),
    ("foo</p>bar", ["foo", "bar"]),
    ("foo</br>bar", ["foo", "bar"]),
    ("one &amp; two", ["one", "two"]),
    ("cut off here&amp", ["cut", "off", "here"]),
    ("caf&eacute;s", ["caf", "s"]),
    ("<SCRIPT src=x>if (a</b>c) {}</Script >kept", ["kept"]),
    ("<script>never closed", []),
    ("1 < 2 and 3 > 2", ["1", "2", "and", "3", "2"]),
    ("<a title='x > y'>link</a>", ["link"]),
    ("<a title=it's>link</a> <b>it's</b>", ["link", "it", "s"]),
    ("<p>cut <a href=\"open", ["cut"]),
    ("<!DOCTYPE html>text", ["text"]),
    ("<textarea><b>raw</b></textarea>", ["b", "raw", "b"]),
    ("a<![CDATA[b]]>c", ["a", "c"]),
    ("", []),
])
def test_text(html, expected):
    assert words(html) == expected


@pytest.mark.parametrize("html, title", [
    ("<head><meta charset=utf-8><title lang=en>Tom &amp; Jo\n</title></head>", "Tom & Jo\n"),
    ("<title>A</title><title>B</title>", "B"),
    ("<title>A</title><title> </title>", "A"),
    ("<title>a &lt;b&gt; c</title>", "a <b> c"),
    ("<title></title>", ""),
    ("<p>none</p>", ""),
])
def test_title(html, title):
    assert read_page(html)[1] == title


def test_title_is_part_of_text():
    assert words("intro<title>named page</title>body") == ["intro", "named", "page", "body"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>/!-'\"= scripttle&;", max_size=60))
def test_any_input_is_read(html):
    text, title = read_page(html)
    assert isinstance(text, str) and isinstance(title, str)


def test_extract_job(spark):
    pages = spark.createDataFrame([
        (1, "u1", "<title>T</title><p>kept\u0000too</p>"), (2, "u2", ""), (3, "u3", None), (4, "u4", "x"),
    ], "doc_id long, url string, html string")
    got = {r["doc_id"]: r for r in extract_pages(nonempty_pages(pages)).collect()}
    assert set(got) == {1, 4}
    assert got[1]["title"] == "T" and got[1]["text"].split() == ["T", "kept", "too"]
