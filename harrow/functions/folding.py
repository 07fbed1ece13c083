"""Accent removal and case folding for all of Unicode, as columns.

A character is taken apart by canonical decomposition, its combining marks are dropped, what is
left is put together again and case-folded, until nothing changes. That is a rule on single
characters, so the whole of it is one `translate` (combining marks that stand alone in the text are
deleted by it) and, for the few characters that fold to several, replacements made only in texts
that have one. The table is computed from the Unicode data that come with Python. Syllables and
ideographs that only compose or unify are left to normal forms: Hangul stays as it is.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(text: str) -> str:
    apart = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(c for c in apart if unicodedata.category(c) != "Mn"))


def folded(text: str) -> str:
    """The rule itself, on a string."""
    while True:
        after = _bare(_bare(text).casefold())
        if after == text:
            return text
        text = after


@lru_cache(maxsize=1)
def _table() -> tuple[str, str, dict[str, str]]:
    """Characters to translate and what to, deleted ones last; and those that become several."""
    single, gone, several = {}, [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        after = folded(char)
        if after == char:
            continue
        if not after:
            gone.append(char)
        elif len(after) == 1:
            single[char] = after
        else:
            several[char] = after
    ascii_upper = {chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}
    single = ascii_upper | single
    return "".join(single) + "".join(gone), "".join(single.values()), several


def fold(text: Column) -> Column:
    """A text column without accents and case; NULL stays NULL."""
    chars, to, several = _table()
    long = text
    for char, after in several.items():
        long = F.replace(long, F.lit(char), F.lit(after))
    expanded = F.when(text.rlike("[" + "".join(several) + "]"), long).otherwise(text)
    return F.translate(expanded, chars, to)
