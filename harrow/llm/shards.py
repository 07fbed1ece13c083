"""Sharding by histogram sort: shards of near equal bytes with equal texts side by side.

Rows are ordered by (hash of the text, doc_id, a number that tells repeated rows apart). The
splitters between shards are found by counting: a histogram job counts the exact bytes and
rows in cells between candidate boundaries, over all partitions at once; the cells that a
target falls into are probed more finely in the next job, and a cell of one key value goes on
with the next part of the key, so that a group of copies that is larger than a shard is
cut, too. Only counts of cells come to the driver, at most `CELLS` rows a round. Then rows are
exchanged once.

Splitter i stands at `i / shards` of all bytes. If that place lies in a group of equal texts
with an edge no farther than `TOLERANCE` of a shard's bytes, the nearer edge (the lower one of
two as near) is taken and the group stays whole; else the cut is before the first row that
begins at or behind the place. So the result follows from the rows alone, not from their
partitions or the probes.

A shard is exchanged in parts of some `part_bytes` (`max_parts` at most in all), each a range
of the order with a task to itself, whatever is frequent. As the histogram tells how many rows
are before each part, slots are numbered within parts only.

A NULL text counts as empty (size 1). Rows without doc_id come first in their group; rows of
one doc_id and text are interchangeable. Input columns named like a result column give way to
it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.session import stored

SHARDS = 8
TOLERANCE = 0.001
CELLS = 8192
PART_BYTES = 128 * 1024 * 1024
MAX_PARTS = 1024
_LEAST, _GREATEST = -(2**63), 2**63 - 1
_LEVELS = ("_k0", "_k1", "_k2")
RESULT = ("size", "shard", "slot")


@dataclass
class Span:
    """Keys that start with `prefix` and go on with a value from `low` to `high`."""
    prefix: tuple[int, ...]
    low: int
    high: int
    bytes_below: int
    rows_below: int
    width: int = 0  # of a cell

    @property
    def level(self) -> int:
        return len(self.prefix)


@dataclass
class Cell:
    least: int
    greatest: int
    size: int
    rows: int


@dataclass(order=True)
class Splitter:
    """Rows with keys from `key` on are not below."""
    key: tuple[int, int, int]
    rows_below: int
    bytes_below: int


def _padded(key: tuple[int, ...], value: int) -> tuple[int, int, int]:
    return key + (value,) * (len(_LEVELS) - len(key))


def _counter(spans: list[Span]):
    """Task side of a round: bytes and rows by span and cell, one row for each cell that has rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_prefix: dict[tuple[int, ...], list[int]] = {}
        for number, span in enumerate(spans):
            by_prefix.setdefault(span.prefix, []).append(number)
        held: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            keys = [np.asarray(batch.column(level)) for level in range(len(_LEVELS))]
            sizes = np.asarray(batch.column(len(_LEVELS)))
            for prefix, numbers in by_prefix.items():
                chosen = np.arange(len(sizes))
                for level, value in enumerate(prefix):
                    chosen = chosen[keys[level][chosen] == value]
                values = keys[len(prefix)][chosen]
                lows = np.array([spans[n].low for n in numbers], np.int64)  # in order, apart
                highs = np.array([spans[n].high for n in numbers], np.int64)
                widths = np.array([spans[n].width for n in numbers], np.uint64)
                which = np.searchsorted(lows, values, side="right") - 1
                inside = (which >= 0) & (values <= highs[which])
                which, values, chosen = which[inside], values[inside], chosen[inside]
                if not len(values):
                    continue
                # differences may pass 2**63: unsigned wrap-around gives them right
                cell = (values.view(np.uint64) - lows[which].view(np.uint64)) // widths[which]
                code = which.astype(np.uint64) * np.uint64(2 * CELLS) + cell
                order = np.argsort(code, kind="stable")
                code, values, weights = code[order], values[order], sizes[chosen[order]]
                begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                rows = np.diff(np.append(begins, len(code)))
                for c, least, greatest, size, n in zip(
                        code[begins].tolist(), np.minimum.reduceat(values, begins).tolist(),
                        np.maximum.reduceat(values, begins).tolist(), np.add.reduceat(weights, begins).tolist(),
                        rows.tolist()):
                    key = numbers[c // (2 * CELLS)], c % (2 * CELLS)
                    was = held.get(key)
                    if was is None:
                        held[key] = [least, greatest, size, n]
                    else:
                        held[key] = [min(was[0], least), max(was[1], greatest), was[2] + size, was[3] + n]
        columns = list(zip(*[(*key, *value) for key, value in held.items()])) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, pa.int64()) for column in columns],
            names=["span", "cell", "least", "greatest", "size", "rows"])
    return count


def _counted(keys: DataFrame, spans: list[Span]) -> list[list[Cell]]:
    """One round: the cells of each span that have rows, in order."""
    for span in spans:
        cells = max(2, CELLS // len(spans))
        span.width = (span.high - span.low) // cells + 1
    counts = keys.mapInArrow(
        _counter(spans), "span long, cell long, least long, greatest long, size long, rows long")
    total = counts.groupBy("span", "cell").agg(
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    found: list[list[Cell]] = [[] for _ in spans]
    for row in sorted(total.collect(), key=lambda row: (row["span"], row["cell"])):  # at most CELLS rows
        found[row["span"]].append(Cell(row["least"], row["greatest"], row["size"], row["rows"]))
    return found


def find_splitters(keys: DataFrame, targets: list[tuple[int, int, bool]], first: Span, ranges: list[tuple[int, int]]):
    """A splitter for each `(bytes, tolerance, exact)`, found by probing `keys(_k0, _k1, _k2, size)`.

    An exact target is refined to its group of equal texts before the tolerance counts, and to its
    row beyond; another one takes any cell's edge within its tolerance. `ranges` are the least and
    the greatest value of each part of the key.
    """
    found: dict[int, Splitter] = {}
    open_targets = {n: first for n in range(len(targets))}
    while open_targets:
        spans = sorted({(s.prefix, s.low): s for s in open_targets.values()}.values(), key=lambda s: (s.prefix, s.low))
        cells_of = {(s.prefix, s.low): cells for s, cells in zip(spans, _counted(keys, spans))}
        made: dict[tuple, Span] = {}
        still: dict[int, Span] = {}
        for n, span in open_targets.items():
            target, tolerance, exact = targets[n]
            below, rows = span.bytes_below, span.rows_below
            cells = cells_of[span.prefix, span.low]
            for at, cell in enumerate(cells):
                if target < below + cell.size or at == len(cells) - 1:
                    break
                below, rows = below + cell.size, rows + cell.rows
            before, after = target - below, below + cell.size - target
            one_value = cell.least == cell.greatest
            last = one_value and span.level == len(_LEVELS) - 1
            edge = not exact or (one_value and span.level == 0)
            if last:
                before_it = before <= 0 if exact else before <= after
            elif edge and min(before, after) <= tolerance:
                before_it = before <= after
            else:
                low, high = (ranges[span.level + 1] if one_value else (cell.least, cell.greatest))
                prefix = span.prefix + ((cell.least,) if one_value else ())
                still[n] = made.setdefault((prefix, low), Span(prefix, low, high, below, rows))
                continue
            if before_it:
                found[n] = Splitter(_padded(span.prefix + (cell.least,), _LEAST), rows, below)
            else:  # behind all rows with that value; no row has the greatest number as its last part
                key = _padded(span.prefix + (cell.greatest,), _GREATEST)
                found[n] = Splitter((*key[:2], key[2] + 1) if last else key, rows + cell.rows, below + cell.size)
        open_targets = still
    return [found[n] for n in range(len(targets))]


def _places(splitters: list[Splitter], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted splitters are at or below each key."""
    bounds = np.array([splitter.key for splitter in splitters], np.int64).reshape(-1, len(_LEVELS))
    result = np.zeros(len(keys[0]), np.int64)

    def place(level: int, low: int, high: int, rows: np.ndarray) -> None:
        """`rows` agree with splitters `low` to `high` up to this level."""
        values, column = keys[level][rows], bounds[low:high, level]
        left = low + np.searchsorted(column, values, side="left")
        right = low + np.searchsorted(column, values, side="right")
        if level == len(_LEVELS) - 1:
            result[rows] = right
            return
        result[rows] = left
        for value in np.unique(values[left < right]).tolist():
            same = values == value
            place(level + 1, int(left[same][0]), int(right[same][0]), rows[same])

    place(0, 0, len(bounds), np.arange(len(result)))
    return result


def _dealer(splitters: list[Splitter], shard_of: list[int], first_slots: list[int]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, starts = np.array(shard_of, np.int32), np.array(first_slots, np.int64)
        for batch in batches:
            parts = _places(splitters, [np.asarray(batch.column(level)) for level in range(len(_LEVELS))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(parts, pa.int32()), pa.array(shards[parts]), pa.array(starts[parts])],
                names=[*batch.schema.names, "_part", "_shard", "_start"])
    return deal


def sharded(
    documents: DataFrame,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    part_bytes: int = PART_BYTES,
    max_parts: int = MAX_PARTS,
    carried: list[str] | None = None,
) -> DataFrame:
    """Columns of `documents` (`carried`, or all) with `size`, `shard` and `slot`, the place in the shard."""
    carried = [name for name in carried or documents.columns if name not in RESULT]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select(
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("_k0"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("_k1"),
        F.monotonically_increasing_id().alias("_k2"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        *[F.col(f"`{name}`").alias(f"_c{at}") for at, name in enumerate(carried)])
    rows = stored(keyed, "shard_keys")
    keys = rows.select(*_LEVELS, "_size")
    ends = keys.agg(*[f(name).alias(f"{name}_{f.__name__}") for name in _LEVELS for f in (F.min, F.max)],
                    F.sum("_size").alias("bytes")).first()
    total = ends["bytes"] or 0
    ranges = [(ends[f"{name}_min"] or 0, ends[f"{name}_max"] or 0) for name in _LEVELS]
    parts = max(1, min(max_parts // shards, -(-total // (shards * part_bytes))))
    step = total // (shards * parts)
    targets = []
    for at in range(1, shards * parts if total else 0):
        exact = at % parts == 0
        targets.append(
            (at // parts * total // shards, int(total * tolerance / shards), True) if exact
            else (at * total // (shards * parts), step // 2, False))
    found = find_splitters(keys, targets, Span((), *ranges[0], 0, 0), ranges)
    exact = [splitter for splitter, target in zip(found, targets) if target[2]]
    splitters = sorted(found)
    shard_of, first_slots = [0], [0]  # of the part behind each splitter
    for splitter in splitters:
        shard = sum(other.key <= splitter.key for other in exact)
        shard_of.append(shard)
        first_slots.append(splitter.rows_below - (exact[shard - 1].rows_below if shard else 0))
    schema = T.StructType([
        *rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_shard", T.IntegerType()),
        T.StructField("_start", T.LongType())])
    dealt = rows.mapInArrow(_dealer(splitters, shard_of, first_slots), schema)
    return _numbered(dealt.repartitionById(len(splitters) + 1, F.col("_part"))).select(
        *[F.col(f"_c{at}").alias(name) for at, name in enumerate(carried)],
        F.col("_size").alias("size"), F.col("_shard").alias("shard"), "slot")


def _numbered(placed: DataFrame) -> DataFrame:
    """Add `slot`; the rows of a part are in one task already."""
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*_LEVELS))
    return placed.withColumn("slot", F.col("_start") + within - 1)


def shard_report(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its size, the checksum of its text, its shard and slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long"), F.col("text"), F.crc32(text.cast("binary")).alias("text_crc32"))
    found = sharded(rows, shards, carried=["doc_id", "text_crc32"])
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
