"""Folded segments of the document log against a plain fold of all rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from harrow import schemas
from harrow.operators import documents as docs
from harrow.session import new_path
from harrow.sources import log_state

NAMES = [field.name for field in log_state.COLUMNS]


def random_rows(rng, n, seqs):
    """Log rows in no order; a document has each `seq` once."""
    rows = []
    for seq in rng.sample(seqs, n):
        values = ["u", "crawled", "f", 1, 2, 3, "t", "s"]
        rows.append((rng.choice([None, *range(8)]), seq, *[
            (f"{value}{seq}" if isinstance(value, str) else value * 1000 + seq) if rng.random() < 0.4 else None for value in values]))
    return rows


def plain_fold(rows):
    state = {}
    for row in sorted(rows, key=lambda row: row[1]):
        document = state.setdefault(row[0], [None] * len(NAMES))
        for at, value in enumerate(row[2:]):
            if value is not None:
                document[at] = value
    return {key: tuple(values) for key, values in state.items()}


def as_dict(state):
    return {r["doc_id"]: tuple(r[name] for name in NAMES) for r in state.collect()}


@pytest.mark.parametrize("fanout", [2, 3])
def test_state_after_every_batch(spark, fanout):
    rng, path, seen = random.Random(fanout), new_path(spark, "log"), []
    seqs = list(range(1000))
    rng.shuffle(seqs)
    folds = []
    for batch in range(7):
        rows = random_rows(rng, 0 if batch == 3 else 12, seqs[batch * 20:batch * 20 + 20])
        seen += rows
        version = log_state.append_log(spark.createDataFrame(rows, schemas.DOC_LOG), path, batch, fanout)
        folds.append(plain_fold(seen))
        assert as_dict(log_state.current_state(spark, path)) == folds[-1]
        assert len(version.segments) <= fanout * 3
    full = spark.createDataFrame(seen, schemas.DOC_LOG)
    assert as_dict(docs.document_state(full)) == folds[-1]
    for number in (1, 4):  # earlier versions stay as they were
        assert as_dict(log_state.current_state(spark, path, number)) == folds[number - 1]
    ids = spark.createDataFrame([(2,), (2,), (5,), (99,), (None,)], "doc_id long")
    assert as_dict(log_state.current_state(spark, path, ids=ids)) == {key: row for key, row in folds[-1].items() if key in (2, 5)}


def test_a_batch_counts_once_and_reads_only_itself(spark):
    path = new_path(spark, "log")
    first = spark.createDataFrame([(1, 5, "new"), (1, 3, "old"), (2, 1, "x")], "doc_id long, seq long, status string")
    log_state.append_log(first, path, 0)
    again = spark.createDataFrame([(1, 9, "wrong")], "doc_id long, seq long, status string")
    assert log_state.append_log(again, path, 0).number == 1
    segment = f"{path}/segments/00000002"
    os.makedirs(segment)  # an attempt that was lost before it was published
    with open(f"{segment}/part-lost.parquet", "wb") as lost:
        lost.write(b"half")
    late = spark.createDataFrame([(1, 4, "late", "u"), (2, None, "no seq", None)], "doc_id long, seq long, status string, url string")
    log_state.append_log(late, path, 1)
    got = {r["doc_id"]: (r["status"], r["url"]) for r in log_state.current_state(spark, path).collect()}
    assert got == {1: ("new", "u"), 2: ("x", None)}
    sizes = [spark.read.parquet(f"{path}/segments/{n:08d}").count() for n in (1, 2)]
    assert sizes == [2, 2]


def test_empty_state_and_ties(spark):
    path = new_path(spark, "log")
    assert log_state.current_state(spark, path).count() == 0
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "b", "y"), (1, 1, "a", "x")], "doc_id long, seq long, status string, other string")
    log_state.append_log(rows, path, 0)
    assert [r["status"] for r in log_state.current_state(spark, path).collect()] == ["b"]


def test_a_stream_of_log_rows(spark):
    path, folder, done = (new_path(spark, name) for name in ("log", "rows", "done"))
    rows = spark.createDataFrame([(n % 5, n, f"s{n}") for n in range(40)], "doc_id long, seq long, status string")
    rows.repartition(6).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    stream.writeStream.foreachBatch(lambda batch, number: log_state.append_log(batch, path, number) and None).option(
        "checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
    assert log_state.read_version(path).number > 1
    got = log_state.current_state(spark, path).filter(F.col("status").isNotNull())
    assert {r["doc_id"]: r["status"] for r in got.collect()} == {n % 5: f"s{n}" for n in range(35, 40)}
