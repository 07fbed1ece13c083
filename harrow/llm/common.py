"""Shared parts of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.session import fits_broadcast

ODD = np.uint64(0x9E3779B97F4A7C15)


class Memo(dict):
    """`memo[key]` is `make(key)`, remembered for some `limit` to twice `limit` recent keys.

    Texts repeat their words, so a task computes most words once. Forgetting a key
    only means computing it again.
    """

    def __init__(self, make: Callable, limit: int):
        self.make = make
        self.limit = limit
        self.older: dict = {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is computed of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def in_byte_slices(
    batches: Iterator[pa.RecordBatch], text: int, limit: int = 2_000_000
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of column `text` and one value that passes the limit."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        groups = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def folded(values: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` neighbours; order counts."""
    last = len(values) - width + 1
    total = values[:last].copy()
    for step in range(1, width):
        total = mixed(total * ODD + values[step:last + step])
    return mixed(total ^ np.uint64(width))


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in `ids(key)`; rows without a key stay.

    The ids are broadcast if their measured size allows it, else both sides shuffle.
    """
    ids = ids.select(key)
    if fits_broadcast(ids):
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_anti").select(*rows.columns)


def only(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is in `ids(key)`, by the same rule as `without`."""
    ids = ids.select(key)
    if fits_broadcast(ids):
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi").select(*rows.columns)
