"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import periodic_runs
from harrow.llm.queries import op11_periodic_runs


def all_runs(words):
    """Every run, found by trying each period at each place."""
    found = []
    for period in range(1, len(words) // 4 + 1):
        at = period
        while at < len(words):
            stop = at
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            start, length = at - period, stop - at + period
            stretch = words[start:stop]
            if length >= max(6, 4 * period) and not any(
                    stretch[smaller:] == stretch[:-smaller] for smaller in range(1, period)):
                found.append((start, length, period))
            at = max(stop, at) + 1
    return sorted(found)


def row_of(doc_id, text):
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [word for word in words if word]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    kept = " ".join(word for i, word in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def looping(rng, size):
    """Words with loops in loops: blocks repeated, cut off, and joined."""
    words = [rng.choice("abc") for _ in range(rng.randrange(1, 4))]
    while len(words) < size:
        words = words * rng.randrange(1, 7) + [rng.choice("abcd") for _ in range(rng.randrange(0, 9))]
        words = words[rng.randrange(0, 3):]
    return words[:size]


def as_bytes(words):
    return " ".join(words).encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
def test_small_alphabets(texts):
    for words, (n, runs, _) in zip(texts, periodic_runs.runs_of_texts([as_bytes(w) for w in texts])):
        assert n == len(words) and runs == all_runs(words)


@pytest.mark.parametrize("seed", range(60))
def test_loops_in_loops(seed):
    rng = random.Random(seed)
    texts = [looping(rng, rng.randrange(1, 500)) for _ in range(5)]
    for words, (_, runs, kept) in zip(texts, periodic_runs.runs_of_texts([as_bytes(w) for w in texts])):
        assert runs == all_runs(words)
        gone = {i for start, length, period in runs for i in range(start + period, start + length)}
        assert kept == as_bytes([word for i, word in enumerate(words) if i not in gone])


@pytest.mark.parametrize("period", [1, 2, 5, 6, 7, 18, 19, 57, 58, 174, 175])
def test_edges_of_the_lag_classes(period):
    """Every period around the borders of the classes, at its least length and one word under it."""
    rng = random.Random(period)
    block = [f"w{rng.random()}" for _ in range(period)]
    least = max(6, 4 * period)
    for length in (least - 1, least, least + 3):
        words = ["before"] * 2 + (block * 12)[:length] + ["after"]
        _, runs, _ = periodic_runs.runs_of_texts([as_bytes(words)])[0]
        assert runs == ([(2, length, period)] if length >= least else [])


def test_a_very_long_loop_and_one_word_all_over():
    rng = random.Random(3)
    block = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    texts = [as_bytes(block * 5), b"word " * 300_000, as_bytes(["a", "b"] * 100_000), as_bytes(["x", *block])]
    found = periodic_runs.runs_of_texts(texts)
    assert [row[1] for row in found] == [
        [(0, 150_000, 30_000)], [(0, 300_000, 1)], [(0, 200_000, 2)], []]
    assert found[1][2] == b"word"


def test_report_against_brute_force(spark, odd_documents, odd_rows):
    rng = random.Random(8)
    rows = [row for row in odd_rows if len(row[1] or "") < 10_000]
    rows += [(n, " \n".join(looping(rng, rng.randrange(1, 120)))) for n in range(100, 220)]
    rows += [(7, "a b a b a b a b a b a b"), (8, "x\x1cy " * 6), (9, "A a " * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = periodic_runs.run_report(frame)
    assert found.columns == COLUMNS
    key = str
    assert sorted(map(tuple, found.collect()), key=key) == sorted((row_of(*row) for row in rows), key=key)
    assert periodic_runs.run_report(odd_documents).count() == len(odd_rows)  # clashing names, a very long text


def test_empty_table(no_documents):
    assert periodic_runs.run_report(no_documents).collect() == []


def test_query_against_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {row["doc_id"]: tuple(row) for row in op11_periodic_runs(spark, folder).select(*COLUMNS).collect()}
    short = [row for row in rows if len(row["text"] or "") < 8_000]
    assert len(found) == len(rows) and any(row[1] for row in found.values())
    for row in short:
        assert found[row["doc_id"]] == row_of(row["doc_id"], row["text"])
