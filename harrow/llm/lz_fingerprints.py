"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases: each is the longest phrase
seen before and one more byte. The set of phrases is hashed and its 64 least hashes are
the fingerprint; the share of common hashes among the least of two fingerprints
together estimates how alike the phrase sets are, as a shared dictionary of a
compressor would.

Each text is compared with an edited one, whose last half is taken from the next
document, and with that next document. Documents are dealt by ranges of doc_id and
sorted in their range; the first document of a range is also sent to the range before
it, so a text is shuffled once and no range needs another.

NULL text is empty. Rows without doc_id come first; rows of one doc_id are ordered by
text. A single row is its own next document. Two empty fingerprints are alike (1.0).
Texts of any length are parsed whole; a task holds the phrases of one text at a time,
some 30 bytes for each byte of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 64
RANGE_BYTES = 16 * 1024 * 1024  # text of a range, as far as documents are about equally long
MOST_RANGES = 100_000  # beyond that, ranges grow; their rows are streamed
_LOWEST = -(2**63)

OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class Phrases:
    """Parse of a text that can be continued, and taken back to where it was."""

    def __init__(self):
        self.steps: dict[int, int] = {}
        self.found: list[bytes] = []
        self.node = self.start = 0
        self.keys: list[int] = []

    def read(self, data: bytes, begin: int) -> None:
        """Go on with `data[begin:]`; phrases may have begun before."""
        steps, keys, found = self.steps, self.keys, self.found
        node, start = self.node, self.start
        get = steps.get
        size = len(steps) + 1
        for at in range(begin, len(data)):
            key = node << 8 | data[at]
            node = get(key)
            if node is None:
                steps[key] = size
                size += 1
                keys.append(key)
                found.append(data[start:at + 1])
                start = at + 1
                node = 0
        self.node, self.start = node, start

    def mark(self) -> tuple[int, int, int]:
        return len(self.keys), self.node, self.start

    def back_to(self, mark: tuple[int, int, int]) -> None:
        size, self.node, self.start = mark
        for key in self.keys[size:]:
            del self.steps[key]
        del self.keys[size:]
        del self.found[size:]

    def least(self) -> np.ndarray:
        """The smallest 32-bit hashes of the phrases, in order."""
        hashed = np.fromiter(map(xxhash.xxh32_intdigest, self.found), np.uint32, len(self.found))
        if len(hashed) > 4 * LEAST:
            hashed = np.partition(hashed, 2 * LEAST)[:2 * LEAST]
            return np.unique(hashed)[:LEAST]
        return np.unique(hashed)[:LEAST]


def fingerprint(text: bytes) -> np.ndarray:
    parse = Phrases()
    parse.read(text, 0)
    return parse.least()


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases among all phrases of two texts."""
    one, two = set(a.tolist()), set(b.tolist())
    least = sorted(one | two)[:LEAST]
    if not least:
        return 1.0
    both = one & two
    return sum(value in both for value in least) / len(least)


def edited(text: str, following: str) -> tuple[str, str]:
    """The kept and the new part of the edited text."""
    cut = len(text) // 2
    return text[:len(text) - cut], following[:cut]


def row_of(doc_id, text: str, own: np.ndarray | None, following: str, after: np.ndarray | None) -> tuple[tuple, np.ndarray]:
    """The result row; `own` and `after` are fingerprints already known. Also the text's own one."""
    kept, new = edited(text, following)
    kept_bytes = kept.encode("utf-8", "surrogatepass")
    parse = Phrases()
    parse.read(kept_bytes, 0)
    mark = parse.mark()
    if own is None:
        parse.read(kept_bytes + text[len(kept):].encode("utf-8", "surrogatepass"), len(kept_bytes))
        own = parse.least()
        parse.back_to(mark)
    changed = kept_bytes + new.encode("utf-8", "surrogatepass")
    parse.read(changed, len(kept_bytes))
    other = parse.least()
    if after is None:
        after = fingerprint(following.encode("utf-8", "surrogatepass"))
    row = (doc_id, len(text), hashlib.sha256(changed).hexdigest(), as_text(own), as_text(other),
           likeness(own, other), likeness(own, after))
    return row, after


def _order(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(_LOWEST).to_numpy(zero_copy_only=False)


def _range_starts(splits: np.ndarray):
    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            ids = _order(batch.column(0))
            parts = np.searchsorted(splits, ids, side="right")
            for part in np.unique(parts).tolist():
                first = int(ids[parts == part].min())
                least[part] = min(first, least.get(part, first))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], names=["part", "first"])
    return starts


def _dealer(splits: np.ndarray, firsts: dict[int, int], before: dict[int, int]):
    """Rows with their range; a range's first rows also with the range before."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(sorted(firsts.values()), np.int64)
        for batch in batches:
            ids = _order(batch.column(0))
            parts = np.searchsorted(splits, ids, side="right").astype(np.int32)
            yield _dealt(batch, parts, 0)
            again = np.flatnonzero(np.isin(ids, starts))
            if len(again):
                copies = batch.take(pa.array(again))
                yield _dealt(copies, np.array([before[part] for part in parts[again].tolist()], np.int32), 1)
    return deal


def _dealt(batch: pa.RecordBatch, parts: np.ndarray, tail: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(parts), pa.array(np.full(len(parts), tail, np.int32)), batch.column(0), batch.column(1)],
        names=["part", "tail", "doc_id", "text"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ranges: each row with the one after it in its range."""
    held = own = None  # the row that waits for its next one, and its fingerprint
    for batch in batches:
        rows = []
        for part, tail, doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
            if held is not None and held[0] == part:
                row, own = row_of(held[1], held[2], own, text or "", None)
                rows.append(row)
                held = (part, doc_id, text or "") if not tail else None
            elif not tail:
                held, own = (part, doc_id, text or ""), None
        columns = list(zip(*rows)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=[field.split()[0] for field in OUT.split(", ")])


def compared(documents: DataFrame) -> DataFrame:
    """One row per document, see `OUT`.

    The number of ranges follows the bytes of the texts, and each range is a task of its own.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, 1 + size // RANGE_BYTES)
    shares = [n / ranges for n in range(1, ranges)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * ranges)).alias("s")).first()["s"]
    splits = np.unique(np.array(found or [], np.int64))
    starts = rows.select("doc_id").mapInArrow(_range_starts(splits), "part int, first long").groupBy("part").agg(
        F.min("first").alias("first")).collect()  # a row per range
    firsts = {row["part"]: row["first"] for row in starts}
    filled = sorted(firsts)
    before = {part: filled[at - 1] for at, part in enumerate(filled)}  # the first range follows the last
    dealt = rows.mapInArrow(_dealer(splits, firsts, before), "part int, tail int, doc_id long, text string")
    placed = dealt.repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")
    return placed.mapInArrow(_compare, OUT)
