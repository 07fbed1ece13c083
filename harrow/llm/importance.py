"""Quality by importance resampling.

Two generative models over hashed n-grams (words and word pairs in 10,000 buckets):
one of the target texts, one of all texts. A document's log weight is the sum of
`log p_target - log p_raw` over its n-grams. With Gumbel noise added, the k largest
keys are a sample without replacement in proportion to the weights.

Counts run over every text; the two models have a fixed size. The k-th key is found
by counting key prefixes, 65,536 at most at a time, so nothing is sorted in one place.

Documents without text have weight 0. Noise depends on doc_id and seed alone, so a
repeated row gets one key and one decision (k may then be passed by the repeats).
Ties at the k-th key go to the smaller doc_id; a NULL doc_id comes after all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import folded, mixed, utf8
from harrow.session import hinted, stored

BUCKETS = 10_000
SMOOTHING = 1.0
SEED = 1
_DIGIT = 16


def features(text: bytes | None) -> np.ndarray:
    """Buckets of a text's words and word pairs, A-Z folded, repeats kept."""
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, np.int64)
    hashed = mixed(np.fromiter(map(crc32, words), np.uint64, len(words)))
    found = [hashed % np.uint64(BUCKETS)]
    if len(words) > 1:
        found.append(folded(hashed, 2) % np.uint64(BUCKETS))
    return np.concatenate(found).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            counts = np.bincount(features(text), minlength=BUCKETS)
            raw += counts
            if good:
                target += counts
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"]
    )


def ngram_counts(documents: DataFrame, target_ids: DataFrame) -> DataFrame:
    """`(bucket, raw, target)` over all documents and over those named in `target_ids(doc_id)`."""
    wanted = hinted(target_ids.select("doc_id").distinct().withColumn("_good", F.lit(True)))
    marked = documents.select("doc_id", "text").join(wanted, "doc_id", "left").select(
        F.col("text").cast("string"), F.coalesce("_good", F.lit(False)).alias("_good")
    )
    parts = marked.mapInArrow(_count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The models' log ratio per bucket; `BUCKETS` rows come to the driver."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def gumbel(ids: list[int | None], seed: int = SEED) -> np.ndarray:
    given = np.array([-1 if one is None else one for one in ids], np.int64).view(np.uint64)
    uniform = ((mixed(mixed(given) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(uniform))


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Longs that order as the given doubles do."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _scorer(ratios: np.ndarray, seed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text) for text in utf8(batch.column(1))]
            weights = np.array([ratios[one].sum() for one in found], np.float64)
            keys = weights + gumbel(batch.column(0).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(one) for one in found], pa.int64()), pa.array(weights),
                 pa.array(keys), pa.array(ordered_bits(keys))],
                names=["doc_id", "n_features", "log_weight", "sample_key", "_order"],
            )
    return score


def weighted(documents: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(
        _scorer(ratios, seed),
        "doc_id long, n_features long, log_weight double, sample_key double, _order long",
    )


def nth_largest(rows: DataFrame, value: Column, n: int) -> tuple[int, int]:
    """The n-th largest long, and how many rows holding it are among the n (n from 1 to the row count)."""
    known: Column = F.lit(True)
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        counted = (
            rows.filter(known).groupBy(F.shiftright(value, shift).alias("digit"))
            .agg(F.count(F.lit(1)).alias("n")).collect()  # 2 ** 16 rows at most
        )
        for row in sorted(counted, key=lambda r: -r["digit"]):
            if row["n"] >= n:
                found = row["digit"]
                break
            n -= row["n"]
        known = F.shiftright(value, shift) == found
    return found, n


def resample(documents: DataFrame, target_ids: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """`(doc_id, n_features, log_weight, sample_key, selected)` of every document; k are selected."""
    ratios = log_ratios(ngram_counts(documents, target_ids))
    rows = stored(weighted(documents, ratios, seed), "weights")
    total = rows.count()
    if k >= total or k < 1:
        return rows.drop("_order").withColumn("selected", F.lit(k >= 1))
    edge, within = nth_largest(rows, F.col("_order"), k)
    smaller_first = -F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    last, _ = nth_largest(rows.filter(F.col("_order") == edge), smaller_first, within)
    chosen = (F.col("_order") > edge) | ((F.col("_order") == edge) & (smaller_first >= last))
    return rows.withColumn("selected", chosen).drop("_order")


def resample_by_labels(documents: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """Target: documents labelled good. k: the share of good labels, of all documents.

    Without labels there is no target, and nothing is selected.
    """
    rated = labels.select("doc_id", "quality").filter("quality IS NOT NULL")
    share = rated.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("s")).first()["s"] or 0.0
    k = round(share * documents.count())
    return resample(documents, rated.filter("quality = 1"), k, seed)
