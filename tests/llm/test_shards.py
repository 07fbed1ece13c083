"""Histogram shards against a plain sort."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from harrow.llm import shards
from tests.conftest import plan_of


def expected(rows, n, tolerance=shards.TOLERANCE):
    """`(doc_id, size, crc, shard, slot)` by sorting all rows and cutting at running bytes."""
    def key(row):
        digest = int(hashlib.md5((row[1] or "").encode()).hexdigest()[:15], 16)
        return digest, row[0] if row[0] is not None else -2**63
    ordered = sorted(rows, key=key)
    sizes = [len((row[1] or "").encode()) + 1 for row in ordered]
    begins = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    total = begins[-1]
    groups = {}
    for at, row in enumerate(ordered):
        low, _ = groups.get(key(row)[0], (begins[at], None))
        groups[key(row)[0]] = low, begins[at + 1]
    cuts = []
    for i in range(1, n):
        target = i * total // n
        low, high = next((b for b in groups.values() if b[0] <= target < b[1]), (0, 0))
        nearest = low if target - low <= high - target else high
        cuts.append(nearest if abs(nearest - target) <= int(total * tolerance / n) else target)
    result, slots = [], [0] * n
    for at, (row, size) in enumerate(zip(ordered, sizes)):
        shard = sum(cut <= begins[at] for cut in cuts)
        result.append((row[0], size, zlib.crc32((row[1] or "").encode()), shard, slots[shard]))
        slots[shard] += 1
    return sorted(result, key=str)


def found(frame, n=8):
    report = shards.shard_report(frame, n)
    assert report.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = report.collect()
    assert all(row["law"] == "bytes" and row["grown_shard"] is None for row in rows)
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows), key=str)


def test_odd_documents(spark, odd_documents, odd_rows):
    frame = odd_documents.withColumns({name: odd_documents.doc_id for name in ("size", "shard", "slot", "_k0", "_part")})
    assert found(frame) == expected(odd_rows, 8)


def test_small_tables(spark, no_documents):
    assert found(no_documents) == []
    for rows in ([(1, None)], [(None, "a")], [(1, "a"), (2, "b"), (2**63 - 1, "c"), (-2**63 + 1, "c")]):
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows, 8)


@pytest.mark.parametrize("n", [1, 3, 8, 20])
def test_hot_groups(spark, n):
    """A text that a third of all rows hold, and one row that is repeated as often: both are cut."""
    rng = random.Random(n)
    rows = [(doc_id, "the same text " * 9) for doc_id in range(400)] + [(-5, "repeated row " * 9)] * 400
    rows += [(1000 + at, "x" * rng.randrange(300)) for at in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(frame, n) == expected(rows, n)


def test_bytes_are_near_equal(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    report = shards.shard_report(frame).collect()
    sizes = np.zeros(8)
    for row in report:
        sizes[row["shard"]] += row["size"]
    longest = max(row["size"] for row in report)
    assert abs(sizes - sizes.mean()).max() <= longest + shards.TOLERANCE * sizes.mean()


def test_groups_stay_together_within_the_tolerance(spark):
    rows = [(at, f"text {at // 4} " + "y" * 40) for at in range(40_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    report = shards.shard_report(frame).collect()
    by_text = {}
    for row in report:
        by_text.setdefault(row["text_crc32"], set()).add(row["shard"])
    assert all(len(held) == 1 for held in by_text.values())


def test_parts_of_shards(spark, odd_rows):
    """Many parts: one exchange, a row number within parts only, the same result."""
    rng = random.Random(2)
    rows = odd_rows + [(1000 + at % 300, "z" * rng.choice([9, 9, rng.randrange(500)])) for at in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed = shards.sharded(frame, 4, part_bytes=10_000)
    plan = plan_of(placed)
    assert plan.count("Exchange") == 1
    got = sorted(((r["doc_id"], r["size"], zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"])
                  for r in placed.collect()), key=str)
    assert got == expected(rows, 4)
    parts = placed.rdd.getNumPartitions()
    assert parts > 10
