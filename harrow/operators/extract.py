"""HTML extraction over a table of pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import text as tx
from harrow.functions.markup import read_page

SLICE_ROWS = 100  # pages of a batch that are Python objects at once
_PAGE = pa.struct([("text", pa.string()), ("title", pa.string())])


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("title", T.StringType())]))
def _read_pages(html: pa.Array) -> pa.Array:
    parts = [_read_some(html.slice(start, SLICE_ROWS).to_pylist()) for start in range(0, len(html), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], _PAGE)


def _read_some(pages: list[str | None]) -> pa.Array:
    rows = []
    for page in pages:
        if page is None:
            rows.append(None)
        else:
            text, title = read_page(page)
            rows.append({"text": text, "title": title})
    return pa.array(rows, _PAGE)


def page_content(html: Column) -> Column:
    """`struct<text,title>`; a NUL character counts as white space.

    Only the html column crosses to Python, in Arrow batches.
    """
    return _read_pages(F.translate(html, "\u0000", " "))


def extract_pages(pages: DataFrame) -> DataFrame:
    """`(doc_id, url, html)` -> `(doc_id, url, title, text)`."""
    return pages.select("doc_id", "url", page_content(F.col("html")).alias("page")).select(
        "doc_id", "url", "page.title", "page.text"
    )


def extract_all(pages: DataFrame) -> DataFrame:
    """The same for every page; a failed or empty download keeps its row, without text and title."""
    return extract_pages(pages.withColumn("html", F.nullif("html", F.lit(""))))


def nonempty_pages(pages: DataFrame) -> DataFrame:
    """Failed or empty downloads carry no page."""
    return pages.filter(F.col("html") != "")


def index_metadata(extracted: DataFrame) -> DataFrame:
    """`(doc_id, doc_length, title, snippet)` of freshly extracted documents."""
    return extracted.select(
        "doc_id",
        tx.token_count(F.col("text")).alias("doc_length"),
        "title",
        tx.snippet(F.col("text")).alias("snippet"),
    )
