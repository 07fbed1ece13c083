"""Text columns: the two tokenizers, snippets, posting strings, queue items.

Everything here is Column -> Column and stays on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
MIN_TOKEN_LENGTH = 3
INDEX_TOKEN = "[A-Za-z0-9]{3,}"
QUERY_DELETED = "[^a-z0-9 ]"
UNICODE_SPACE = (
    "[\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
SNIPPET_LENGTH = 200
NO_PREVIEW = "No preview available."


def raw_tokens(text: Column) -> Column:
    """Maximal ASCII alphanumeric runs of three or more, case kept.

    Case is folded after extraction: folding first would turn some non-ASCII
    letters into ASCII ones and so join runs that must stay apart.
    """
    return F.regexp_extract_all(text, F.lit(INDEX_TOKEN), F.lit(0))


def index_tokens(text: Column) -> Column:
    return F.transform(raw_tokens(text), F.lower)


def token_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(raw_tokens(text))).cast("int")


def query_tokens(query: Column) -> Column:
    """Query-side tokens: punctuation is deleted rather than treated as a gap."""
    spaced = F.regexp_replace(F.lower(query), UNICODE_SPACE, " ")
    words = F.split(F.regexp_replace(spaced, QUERY_DELETED, ""), " ")
    return F.filter(words, lambda word: F.length(word) >= MIN_TOKEN_LENGTH)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def snippet(text: Column) -> Column:
    """First 200 characters of the text, whitespace runs collapsed."""
    return F.substring(collapse_space(text), 1, SNIPPET_LENGTH)


def filled(value: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def posting_ids(posting_string: Column) -> Column:
    """``'1,10,2'`` -> ``[1, 10, 2]``."""
    return F.split(posting_string, ",").cast("array<bigint>")


def leading_int(item: Column) -> Column:
    """Decimal id at the start of a queue item, NULL when absent or out of range."""
    return F.regexp_extract(item, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1).try_cast("int")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)
