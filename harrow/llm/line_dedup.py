"""Reversible line deduplication with sharded cuckoo filters.

A line's key is a hash of the line, stripped of ASCII white space and with A-Z folded.
Exact tables say which documents hold which key; adding a document appends its
references, deleting it appends them with the opposite sign. Keys that enough
documents hold are *common*: their lines go from all documents but the largest
doc_id that holds them.

Cuckoo filters, one per shard of the key space, hold the common keys: two candidate
buckets of four 16-bit fingerprints per key, so keys can be taken out again. When
documents come or go, only keys that cross the threshold are put in or out, and only
as the exact counts say so, which is what makes a deletion from the filter safe. The
lines of documents are tested against the filters first; the few that hit are
confirmed in the exact table. A shard whose filter fills up is rebuilt larger.

Every row of `documents` counts as one document. NULL text is one empty line, as is
an empty text. Rows without doc_id keep a common line only if all its holders lack one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import mixed, utf8
from harrow.operators.joins import spread_join
from harrow.session import broadcast_limit, fits_broadcast, new_path, stored
from harrow.sources.storage import list_files, located

MIN_CHARS = 40
MIN_DOCUMENTS = 5
SHARDS = 64
KEYS_PER_SHARD = 100_000
SLOTS = 4
KICKS = 400
_SPACE = b" \t\n\v\f\r"

_REFERENCES = "key binary, doc_id long, sign int"
_FILTERS = "shard int, data binary"


# --- lines -------------------------------------------------------------------


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte key of a line long enough to count, else None."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    return [line_key(line, min_chars) for line in (text or b"").split(b"\n")]


def _reference_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = set(line_keys(text, min_chars))
                own.discard(None)
                keys.extend(own)
                ids.extend([doc_id] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())],
                                             names=["key", "doc_id"])
    return rows


# --- cuckoo filter -----------------------------------------------------------


class CuckooFilter:
    """Set of 16-byte keys with deletion: `buckets` x 4 fingerprints, a power of two of buckets."""

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def sized_for(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < max(keys, 1):
            buckets *= 2
        return cls(buckets)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets of keys given as `(n, 2)` words."""
        prints = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints = np.where(prints == 0, np.uint16(1), prints)
        first = (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        offset = mixed(np.asarray(prints, np.uint64)) & np.uint64(len(self.table) - 1)
        return bucket ^ offset.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """False if the filter is full; it must be rebuilt larger then."""
        for mark, first, second in zip(*self._places(keys)):
            if not self._add(mark, int(first), int(second)):
                return False
        return True

    def _add(self, mark, first: int, second: int) -> bool:
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = second
        for kick in range(KICKS):
            slot = (kick * 7 + bucket) % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self._other(np.int64(bucket), mark))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that are known to be inside."""
        for mark, first, second in zip(*self._places(keys)):
            for bucket in (first, second):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def key_words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def filled(keys: np.ndarray, room: int = 0) -> CuckooFilter:
    size = max(len(keys), room)
    while True:
        made = CuckooFilter.sized_for(size)
        if made.add(keys):
            return made
        size = 2 * size + 8


# --- the index ---------------------------------------------------------------


def shard_of(shards: int):
    """The shard of a key, from its first four bytes."""
    return F.pmod(F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class LineIndex:
    """One version: reference folders, the common keys and the filters built from them."""

    spark: SparkSession
    references: tuple[str, ...] = ()
    common: str | None = None
    filters: str | None = None
    min_chars: int = MIN_CHARS
    min_documents: int = MIN_DOCUMENTS
    shards: int = SHARDS

    def reference_rows(self) -> DataFrame:
        return self.spark.read.schema(_REFERENCES).parquet(*self.references)

    def common_keys(self) -> DataFrame:
        rows = self.spark.read.schema("key binary, uses long, last_id long").parquet(self.common)
        return rows.withColumn("shard", shard_of(self.shards))


def _written(frame: DataFrame, label: str) -> str:
    path = new_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return path


def references_of(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_reference_rows(min_chars), "key binary, doc_id long")


def _common(references: DataFrame, min_documents: int, signed: bool) -> DataFrame:
    """`(key, uses, last_id)` of the keys that enough documents hold.

    A line of very many documents is summed on the map side. After deletions, the
    references of one document and key are netted first.
    """
    if signed:
        references = references.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0")
    else:
        references = references.withColumn("n", F.lit(1).cast("long"))
    counted = references.groupBy("key").agg(F.sum("n").alias("uses"), F.max("doc_id").alias("last_id"))
    return counted.filter(F.col("uses") >= min_documents)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    made = filled(key_words(pdf["key"].tolist()))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "data": [made.to_bytes()]})


def _change_shard(key, old: pd.DataFrame, crossing: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.from_bytes(old["data"].iloc[0]) if len(old) else CuckooFilter(1)
    gone = crossing.loc[~crossing["present"], "key"].tolist()
    come = crossing.loc[crossing["present"], "key"].tolist()
    if gone:
        made.remove(key_words(gone))
    if come and not made.add(key_words(come)):
        made = filled(key_words(now["key"].tolist()), 2 * len(now))
    return pd.DataFrame({"shard": [int(key[0])], "data": [made.to_bytes()]})


def add_documents(index: LineIndex, documents: DataFrame) -> LineIndex:
    """The index with the lines of more documents."""
    return _changed(index, documents, 1)


def delete_documents(index: LineIndex, documents: DataFrame) -> LineIndex:
    """The index as if the documents had not been added; their texts must be those added."""
    return _changed(index, documents, -1)


def _changed(index: LineIndex, documents: DataFrame, sign: int) -> LineIndex:
    rows = references_of(documents, index.min_chars).withColumn("sign", F.lit(sign))
    folder = _written(rows, "line-references")
    grown = replace(index, references=(*index.references, folder))
    first = not index.references and sign > 0
    common = _written(_common(grown.reference_rows(), index.min_documents, signed=not first), "common-lines")
    grown = replace(grown, common=common)
    n = grown.common_keys().count()
    crowded = n > 4 * KEYS_PER_SHARD * index.shards
    if first or crowded:  # more shards for more keys, all filters anew
        grown = replace(grown, shards=max(index.shards, -(-n // KEYS_PER_SHARD)))
        keys = grown.common_keys().select("shard", "key")
        made = keys.groupBy("shard").applyInPandas(_build_shard, _FILTERS)
    else:
        before = index.common_keys().select("shard", "key")
        after = grown.common_keys().select("shard", "key")
        crossing = (
            after.join(before, ["shard", "key"], "left_anti").withColumn("present", F.lit(True))
            .unionByName(before.join(after, ["shard", "key"], "left_anti").withColumn("present", F.lit(False)))
        )
        made = _changed_filters(index.spark.read.schema(_FILTERS).parquet(index.filters), crossing, after)
    return replace(grown, filters=_written(made, "line-filters"))


def _changed_filters(old: DataFrame, crossing: DataFrame, after: DataFrame) -> DataFrame:
    """Each shard's filter with its crossing keys put in or out; all its keys serve a rebuild."""
    none = F.lit(None)
    rows = (
        old.select("shard", "data", none.cast("binary").alias("key"), none.cast("boolean").alias("present"))
        .unionByName(crossing.select("shard", none.cast("binary").alias("data"), "key", "present"))
        .unionByName(after.select("shard", none.cast("binary").alias("data"), "key", none.cast("boolean").alias("present")))
    )

    def change(key, pdf: pd.DataFrame) -> pd.DataFrame:
        is_filter, is_crossing = pdf["data"].notna(), pdf["present"].notna()
        crossing_rows = pdf[is_crossing].assign(present=lambda rows: rows["present"].astype(bool))
        return _change_shard(key, pdf[is_filter], crossing_rows, pdf[~is_filter & ~is_crossing])

    return rows.groupBy("shard").applyInPandas(change, _FILTERS)


# --- using it ----------------------------------------------------------------


def _load_filters(path: str) -> dict[int, CuckooFilter]:
    fs, root = located(path)
    found = {}
    for name, _ in list_files(path, ".parquet"):
        for row in pq.read_table(f"{root}/{name}", filesystem=fs).to_pylist():
            found[row["shard"]] = CuckooFilter.from_bytes(row["data"])
    return found


def _prober(path: str, shards: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None
        for batch in batches:
            if filters is None:
                filters = _load_filters(path)
            if not batch.num_rows:
                continue
            keys = key_words(batch.column(0).to_pylist())
            shard = np.ascontiguousarray(keys[:, 0]).view(">u4")[::2] % shards
            hit = np.zeros(len(keys), bool)
            for number in np.unique(shard).tolist():
                if number in filters:
                    own = np.flatnonzero(shard == number)
                    hit[own] = filters[number].contains(keys[own])
            yield batch.filter(pa.array(hit))
    return probe


def dropped_lines(index: LineIndex, references: DataFrame) -> DataFrame:
    """`(doc_id, keys)`: the keys whose lines go from a document, for `references(key, doc_id)`.

    Filters are loaded by tasks if they fit; else every reference goes to the exact table.
    """
    rows = references.select("key", "doc_id")
    sizes = index.spark.read.schema(_FILTERS).parquet(index.filters)
    if (sizes.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0) <= broadcast_limit(index.spark):
        rows = rows.mapInArrow(_prober(index.filters, index.shards), "key binary, doc_id long")
    common = index.common_keys().select("key", "uses", "last_id")
    hits = spread_join(rows, common, "key", "uses", "doc_id")
    gone = hits.filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    return gone.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _cleaner(min_chars: int, texts: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, hashes, kept_texts = [], [], [], []
            for text, keys in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                lines = (text or b"").split(b"\n")
                kept = lines
                if keys:
                    keys = set(keys)
                    kept = [line for line in lines if line_key(line, min_chars) not in keys]
                joined = b"\n".join(kept)
                totals.append(len(lines))
                gone.append(len(lines) - len(kept))
                hashes.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined)
            columns = [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes)]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if texts:
                columns, names = [batch.column(3), pa.array(kept_texts, pa.binary()).cast(pa.string())], ["_row", "text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return clean


def _marked(index: LineIndex, documents: DataFrame, references: DataFrame) -> DataFrame:
    drops = stored(dropped_lines(index, references), "dropped-lines")
    drops = drops.withColumnRenamed("doc_id", "_id").withColumnRenamed("keys", "_keys")
    if fits_broadcast(drops):
        drops = F.broadcast(drops)
    return documents.join(drops, documents["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")


def line_index(documents: DataFrame, **options) -> LineIndex:
    return add_documents(LineIndex(documents.sparkSession, **options), documents)


def line_report(documents: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """`(doc_id, n_lines, n_dropped, kept_sha256)` of every row."""
    index = index or line_index(documents)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = _marked(index, rows, index.reference_rows()).select("doc_id", "text", "_keys")
    return marked.mapInArrow(
        _cleaner(index.min_chars, False), "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


def without_common_lines(documents: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """The rows with their text cleaned; other columns and row count as they were."""
    index = index or line_index(documents)
    others = [name for name in documents.columns if name != "text"]
    packed = documents.select(  # no column of the input may meet one of ours
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(*others).alias("_row"))
    packed = _marked(index, packed, index.reference_rows()).select("doc_id", "text", "_keys", "_row")
    layout = f"_row {packed.schema['_row'].dataType.simpleString()}, text string"
    cleaned = packed.mapInArrow(_cleaner(index.min_chars, True), layout)
    return cleaned.select(*[F.col("text") if name == "text" else F.col("_row")[name].alias(name) for name in documents.columns])
