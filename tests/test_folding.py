"""Accent and case folding against the rule on strings and against another Unicode implementation."""

import sys
import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.functions.folding import fold, folded
from harrow.operators import indexing


def folds(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = {row["n"]: row["out"] for row in rows.select("n", fold(F.col("text")).alias("out")).collect()}
    return [found[n] for n in range(len(texts))]


@pytest.mark.parametrize("text, expected", [
    ("Étions àçê ÿ", "etions ace y"), ("ő č ệ Ž Ń", "o c e z n"), ("é ố Ñ", "e o n"),
    ("ộ = ộ", "o = o"), ("Straße STRASSE GROẞ", "strasse strasse gross"), ("ﬁle ﬂag", "file flag"),
    ("ΆΣΣ άσς", "ασσ ασσ"), ("Ёлка Й", "елка и"), ("K İ", "k i"), ("北京 한글", "北京 한글"), ("", ""), (None, None),
])
def test_examples(spark, text, expected):
    assert folds(spark, [text]) == [expected]


def test_every_character_by_the_rule(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}|" for c in chars[at:at + 5000]) for at in range(0, len(chars), 5000)]
    for text, out in zip(texts, folds(spark, texts)):
        assert out.split("|") == [folded(c) for c in text.split("|")]


def test_accents_as_the_database_has_them():
    """Every Latin, Greek and Cyrillic letter; the rule also unites characters that differ in case only."""
    chars = [chr(c) for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)] if unicodedata.category(chr(c))[0] == "L"]
    connection = duckdb.connect()
    connection.register("chars", pd.DataFrame({"c": chars}))
    for char, bare in connection.execute("SELECT c, lower(strip_accents(c)) FROM chars").fetchall():
        assert folded(bare) == folded(char)


def test_terms(spark):
    documents = spark.createDataFrame([(1, "Ősz ŐSZ ősz Người THE"), (2, None)], "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "term string")
    rows = indexing.folded_terms(documents, stop).collect()
    assert sorted((r["doc_id"], r["term"]) for r in rows) == [(1, "nguoi"), (1, "osz")]
