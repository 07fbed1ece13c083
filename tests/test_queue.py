"""The ordered queue, the stream over it, and hand-offs with a bounded number of tries."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import frontier as fr
from harrow.operators import handoff
from harrow.session import new_path
from harrow.sources import queue
from harrow.streaming import batches, crawl


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def frontier(spark, low, high, seed=0):
    rng = random.Random(seed)
    rows = [(seq, rng.choice([f"http://host.example/{rng.randrange(200)}", "short", None])) for seq in range(low, high)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "seq long, url string").repartition(5)


def test_segments_hold_every_row_once_in_order(spark):
    path = new_path(spark, "queue")
    for low, high in ((0, 1000), (1000, 1001), (2000, 2500)):
        queue.publish(frontier(spark, low, high), path, segment_rows=100)
    found = sorted(map(tuple, queue.segments(spark, path).select("first", "last", "rows").collect()))
    assert sum(row[2] for row in found) == 1501 and len(found) > 10
    assert all(before[1] < after[0] for before, after in zip(found, found[1:]))
    kept = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    expected = frontier(spark, 0, 1000).union(frontier(spark, 1000, 1001)).union(frontier(spark, 2000, 2500))
    assert rows_of(kept.select("seq", "url")) == rows_of(expected)


def test_a_queue_only_grows_at_its_end(spark):
    path = new_path(spark, "queue")
    queue.publish(spark.createDataFrame([], "seq long, url string"), path)
    queue.publish(frontier(spark, 0, 10), path)
    with pytest.raises(ValueError, match="not behind 9"):
        queue.publish(frontier(spark, 9, 20), path)
    with pytest.raises(ValueError, match="needs a seq"):
        queue.publish(spark.createDataFrame([(None, "http://a.example")], "seq long, url string"), path)


def accepted(spark, table):
    return batches.read_table(spark, table, crawl.ACCEPTED)


def test_first_come_over_batches_and_restarts(spark):
    """Small batches, three runs over one checkpoint: what one batch job over all accepts."""
    path, table, checkpoint = (new_path(spark, name) for name in ("queue", "accepted", "stream"))
    known = spark.createDataFrame(
        [(10**6 + n, f"http://host.example/{n}", "crawled") for n in range(0, 200, 9)], "doc_id long, url string, status string")
    parts = [(0, 400), (400, 405), (405, 900)]
    for part, (low, high) in enumerate(parts):
        queue.publish(frontier(spark, low, high, part), path, segment_rows=60)
        crawl.accept_queue(spark, path, table, checkpoint, known, rows_per_batch=100)
    crawl.accept_queue(spark, path, table, checkpoint, known, rows_per_batch=7)  # nothing new
    whole = None
    for part, (low, high) in enumerate(parts):
        rows = frontier(spark, low, high, part)
        whole = rows if whole is None else whole.union(rows)
    expected = fr.accept_urls(whole, known).select(F.col("seq").alias("doc_id"), "url", F.lit("processing").alias("status"))
    found = accepted(spark, table)
    assert rows_of(found.select("doc_id", "url", "status")) == rows_of(expected.union(known))
    order = found.filter("batch_id >= 0").groupBy("batch_id").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("batch_id").collect()
    assert len(order) >= 3 and all(a["high"] < b["low"] for a, b in zip(order, order[1:]))


def test_a_batch_reads_no_accepted_url(spark, monkeypatch):
    """The accepted table is spoilt between two runs: the second takes no notice."""
    path, table, checkpoint = (new_path(spark, name) for name in ("queue", "accepted", "stream"))
    queue.publish(frontier(spark, 0, 300), path, segment_rows=50)
    crawl.accept_queue(spark, path, table, checkpoint, rows_per_batch=100)
    monkeypatch.setattr(batches, "read_table", None)
    first = {row["url"] for row in spark.read.schema(crawl.ACCEPTED).parquet(table).collect()}
    queue.publish(frontier(spark, 300, 600, 1), path, segment_rows=50)  # URLs of the same hosts
    crawl.accept_queue(spark, path, table, checkpoint, rows_per_batch=100)
    rows = spark.read.schema(crawl.ACCEPTED).parquet(table).collect()
    assert first and len({row["url"] for row in rows}) == len(rows) > len(first)


def test_a_replayed_batch_changes_nothing(spark):
    """The last batch is run again from the offset log, as after a crash before its commit."""
    from harrow.sources.storage import located
    path, table, checkpoint = (new_path(spark, name) for name in ("queue", "accepted", "stream"))
    queue.publish(frontier(spark, 0, 400), path, segment_rows=50)
    crawl.accept_queue(spark, path, table, checkpoint, rows_per_batch=150)
    before = rows_of(accepted(spark, table).select("doc_id", "url", "status"))
    fs, place = located(f"{checkpoint}/commits")
    import pyarrow.fs as pafs
    last = max((f for f in fs.get_file_info(pafs.FileSelector(place)) if f.base_name.isdigit()), key=lambda f: int(f.base_name))
    fs.delete_file(last.path)
    fs.delete_file(f"{place}/.{last.base_name}.crc")
    crawl.accept_queue(spark, path, table, checkpoint, rows_per_batch=150)
    assert rows_of(accepted(spark, table).select("doc_id", "url", "status")) == before


# --- hand-offs ---------------------------------------------------------------

def items(spark, ids):
    return spark.createDataFrame([(n, f"item {n}") for n in ids], "doc_id long, name string")


def failing(tries, seen):
    """Ids fail as often as `tries` says; `seen` gets the ids of each try."""
    def deliver(frame, attempt):
        given = [row["doc_id"] for row in frame.collect()]
        seen.append((attempt, sorted(given)))
        rows = [(n, f"try {attempt}" if tries.get(n, 0) >= attempt else None) for n in given]
        return frame.sparkSession.createDataFrame(rows, "doc_id long, reason string")
    return deliver


def test_tries_are_bounded_and_only_failures_come_again(spark):
    seen = []
    log = new_path(spark, "log")
    outcomes = handoff.hand_over(items(spark, [1, 2, 3, 4, None]), failing({2: 1, 3: 2, 4: 9}, seen), log)
    assert seen == [(1, [1, 2, 3, 4]), (2, [2, 3, 4]), (3, [3, 4])]
    assert rows_of(handoff.hand_over_state(outcomes)) == [
        (1, 1, "queued", None), (2, 2, "queued", None), (3, 3, "queued", None), (4, 3, "crawled_not_queued", "try 3")]
    dead = handoff.dead_letter_rows(handoff.hand_over_state(outcomes), seq=7)
    assert [(r["doc_id"], r["seq"], r["status"], r["url"]) for r in dead.collect()] == [(4, 7, "crawled_not_queued", None)]
    handoff.hand_over(items(spark, [1, 2, 3, 4]), failing({}, seen), log)  # all tries are finished
    assert len(seen) == 3


def test_an_interrupted_run_goes_on(spark):
    seen = []
    log = new_path(spark, "log")

    def breaking(frame, attempt):
        if attempt == 2 and len(seen) == 1:
            raise RuntimeError("lost")
        return failing({2: 1}, seen)(frame, attempt)

    with pytest.raises(RuntimeError):
        handoff.hand_over(items(spark, [1, 2]), breaking, log)
    seen_before = list(seen)
    state = handoff.hand_over_state(handoff.outcomes_of(spark, log))
    assert rows_of(state) == [(1, 1, "queued", None), (2, 1, "crawled", "try 1")]  # still to be tried
    seen.append(None)
    outcomes = handoff.hand_over(items(spark, [1, 2]), breaking, log)
    assert seen_before == [(1, [1, 2])] and seen[2:] == [(2, [2])]
    assert rows_of(handoff.hand_over_state(outcomes)) == [(1, 1, "queued", None), (2, 2, "queued", None)]


def test_ids_with_several_rows_and_no_items(spark):
    outcomes = handoff.hand_over(items(spark, [5, 5]), failing({5: 9}, []), new_path(spark, "log"), most=2)
    assert rows_of(handoff.hand_over_state(outcomes, most=2)) == [(5, 2, "crawled_not_queued", "try 2")]
    assert handoff.hand_over(items(spark, []), failing({}, []), new_path(spark, "log")).collect() == []
