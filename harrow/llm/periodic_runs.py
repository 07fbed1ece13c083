"""Periodic runs of words inside a text: loops, stuck templates, repeated refrains.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends, at least `max(LEAST_WORDS, LEAST_ROUNDS * q)` words long. Inside it the words
q apart agree for at least `max(6 - q, 3q)` places: the overlap that a lag guarantees.

Seed and extend along diagonals. Lags are dealt into classes of 1..5, 6..18, 19..57, and
so on; a class takes k-grams of the overlap that its smallest lag guarantees (5, 18, 57),
which is also its greatest lag. As k >= q, no k-gram of a run comes back after fewer than
q words, so the occurrence pairs to look at are each k-gram and its last occurrence before,
at most k words back: a pair per word and class, never all pairs of a frequent k-gram. A
pair that lies beyond what its lag has covered is extended both ways word by word and
moves that lag's furthest covered place. Because the pair is the nearest one, what is
long enough has no smaller period. Only places whose k-gram recurs can start a longer
k-gram that does, so the later classes look at few places.

Words are numbered exactly within a batch; k-grams are compared by 64-bit hashes and
every extension by the words. Rows keep their number and partition, nothing is shuffled.
A NULL or blank text has no words and no runs. Texts of any length are handled whole;
batches are cut by bytes, so that a very long text is alone in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import ODD, folded, in_byte_slices, mixed, utf8

LEAST_WORDS = 6
LEAST_ROUNDS = 4
_FIRST = LEAST_WORDS - 1  # words that agree at lag 1

RUN = "struct<start:long,length:long,period:long>"
OUT = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_ROUNDS * period)


def _wider(grams: np.ndarray, width: int, places: np.ndarray, wide: int) -> np.ndarray:
    """Hashes of the `wide`-grams at `places` from those of all `width`-grams, which may overlap."""
    total = grams[places]
    for step in (*range(width, wide - width, width), wide - width):
        total = mixed(total * ODD + grams[places + step])
    return total


def _nearest_pairs(
    grams: np.ndarray, places: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(place, lag)` of each gram and its last occurrence before in its text; and the places whose gram recurs there."""
    order = np.argsort(grams, kind="stable")  # equal grams stay in order of their places
    ordered, sorted_grams = places[order], grams[order]
    same = (sorted_grams[1:] == sorted_grams[:-1]) & (owner[ordered[1:]] == owner[ordered[:-1]])
    at, before = ordered[1:][same], ordered[:-1][same]
    recurs = np.zeros(len(grams), bool)
    recurs[order[1:][same]] = recurs[order[:-1][same]] = True
    return at, at - before, places[recurs]


def _agreeing(words: np.ndarray, at: int, lag: int, begin: int, end: int) -> tuple[int, int]:
    """The widest stretch around `at` where words agree with those `lag` before, as `[from, to)`."""
    low, high, step = at, at, 64
    while high < end:
        stop = min(end, high + step)
        differ = np.flatnonzero(words[high:stop] != words[high - lag:stop - lag])
        if len(differ):
            high += int(differ[0])
            break
        high, step = stop, step * 2
    step = 64
    while low > begin + lag:
        start = max(begin + lag, low - step)
        differ = np.flatnonzero(words[start:low] != words[start - lag:low - lag])
        if len(differ):
            low = start + int(differ[-1]) + 1
            break
        low, step = start, step * 2
    return low, high


def find_runs(words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """`(start, length, period)` of all runs of a batch of texts.

    `words` are the word numbers of all texts in a row, `starts` where each text begins and,
    last, where all end. Starts of runs count from the beginning of the batch.
    """
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(starts[1:], sizes) - np.arange(len(words))  # words from a place to the end of its text
    places = np.flatnonzero(left >= _FIRST)
    if not len(places):
        return []
    every, narrow = folded(mixed(words.astype(np.uint64)), _FIRST), _FIRST  # of all places, and how wide
    grams, width, least_lag = every[places], _FIRST, 1
    found = []
    while len(places):
        at, lag, places = _nearest_pairs(grams, places, owner)
        of_class = (lag >= least_lag) & (lag <= width)
        at, lag = at[of_class], lag[of_class]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.ones(len(at), bool)  # a pair right behind one of the same lag lies on its stretch
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}  # lag -> the end of its furthest stretch; pairs of a lag come in order
        for place, q in zip(at[first].tolist(), lag[first].tolist()):
            if place < covered.get(q, 0):
                continue
            text = owner[place]
            low, high = _agreeing(words, place, q, int(starts[text]), int(starts[text + 1]))
            covered[q] = high
            if high - low + q >= least_length(q):
                found.append((low - q, high - low + q, q))
        least_lag = width + 1
        width = (LEAST_ROUNDS - 1) * least_lag
        places = places[(left[places] >= width) & (sizes[owner[places]] >= least_length(least_lag))]
        if len(places) * (width // narrow) > 8 * len(words):
            while narrow < width:  # many places: hashes of all, one class after the other
                wide = (LEAST_ROUNDS - 1) * (narrow + 1)
                every = _wider(every, narrow, np.arange(len(every) - (wide - narrow)), wide)
                narrow = wide
        grams = _wider(every, narrow, places, width) if narrow < width else every[places]
    return sorted(found)


def _numbered_words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    split = [(text or b"").split() for text in texts]  # bytes are cut at 0x20 and 0x09-0x0D only
    numbers: dict[bytes, int] = {}
    for words in split:
        for word in dict.fromkeys(words):
            numbers.setdefault(word, len(numbers))
    starts = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(words) for words in split], out=starts[1:])
    codes = np.fromiter((numbers[word] for words in split for word in words), np.int64, int(starts[-1]))
    return split, codes, starts


def runs_of_texts(texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text: its number of words, its runs by start and period, and the kept words."""
    split, codes, starts = _numbered_words(texts)
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in find_runs(codes, starts):
        text = int(np.searchsorted(starts, start, side="right")) - 1
        by_text.setdefault(text, []).append((start - int(starts[text]), length, period))
    result = []
    for number, words in enumerate(split):
        runs = by_text.get(number, [])
        kept = words
        if runs:
            keep = np.ones(len(words), bool)
            for start, length, period in runs:
                keep[start + period:start + length] = False
            kept = [words[at] for at in np.flatnonzero(keep).tolist()]
        result.append((len(words), runs, b" ".join(kept)))
    return result


_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_byte_slices(batches, 1):
        found = runs_of_texts(utf8(batch.column(1)))
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in row[1]] for row in found]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([row[0] for row in found], pa.int64()), pa.array(runs, pa.list_(_RUN_TYPE)),
            pa.array([row[2] for row in found], pa.binary()).cast(pa.string()),
        ], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """Per row of `documents`: its words, its runs, and its text with each run cut to its first round, see `OUT`."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_find, OUT)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda word: word != "")


def looped(documents: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by doc_id, falls into a loop: the text to look at in a trial.

    With h the CRC-32 of the decimal doc_id and g = h div 10, a text with h % 10 = 0 goes round from word
    a = g % n on in p = 1 + (n - a) div (3 + g % 8) words. Other texts, and those without doc_id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", "text", (h % 10 == 0).alias("_turns"), ((h - h % 10) / 10).cast("long").alias("_g"))
    words, n = _words(F.col("text")), F.size(_words(F.col("text")))
    around = F.expr("""
        array_join(transform(_words, (w, i) -> get(_words, cast(
            if(i < _a, i, _a + (i - _a) % (1 + (size(_words) - _a) div (3 + _g % 8))) as int))), ' ')""")
    some = F.col("_turns") & (n > 0)
    return rows.withColumn("_words", F.when(some, words)).withColumn(
        "_a", F.when(F.col("_words").isNotNull(), F.col("_g") % F.size("_words"))).select(
        "doc_id", F.when(F.col("_words").isNotNull(), around).otherwise(F.col("text")).alias("text"))


def run_report(documents: DataFrame) -> DataFrame:
    """One row per document: the number of its runs, the longest one, digests of all runs and of the kept words."""
    found = periodic_runs(looped(documents))
    order = "array_sort(runs, (a, b) -> case when a.length <> b.length then int(sign(b.length - a.length))" \
            " when a.start <> b.start then int(sign(a.start - b.start)) else int(sign(a.period - b.period)) end)"
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    best = found.withColumn("_best", F.expr(f"get({order}, 0)"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[
            F.col(f"_best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.expr(listed).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
