"""Near-duplicate documents by one-permutation MinHash.

1. A text becomes its set of hashed 5-word shingles. One hash of each shingle fills
   256 bins; an empty bin copies from a bin chosen by a random sequence of its own
   (optimal densification), so short texts are compared as fairly as long ones.
2. Texts with equal sets are one class from here on. 51 bands of 5 bins put classes
   into buckets; a pair at similarity 0.75 shares a bucket but for one in a million.
3. In each bucket one class is the centre and is paired with each other member: a
   star has as many edges as the bucket has members. The centre is the class that
   meets most others, which is the original of a family of edited copies.
4. Pairs are confirmed on full sets and joined to components. Where a bucket still
   falls into several components, its members get 2,048 one-bit minima; pairs between
   components whose bits allow the similarity (by 4.5 standard deviations) are
   confirmed, too, so no link is lost to the star shape, and few pairs are made.

Rows without a doc_id are groups of their own (component NULL, kept). Texts without
words are linked with nothing. A doc_id names one text: rows that repeat it get one
component and one decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import folded, in_slices, mixed, only, utf8, without
from harrow.operators.joins import spread_join
from harrow.session import fits_broadcast, stored

WORDS = 5
PERCENT = 75
BINS = 256
BAND_ROWS = 5
BANDS = BINS // BAND_ROWS
ATTEMPTS = 4096
ROWS_PER_TASK = 100_000
# One-bit minima, 64 to a long, and how far from 0.75 a linked pair's share may stray.
BIT_WORDS = 32
DEVIATIONS = 4.5
BLOCK = 4096

_SHARE = (1 + PERCENT / 100) / 2
_BITS = 64 * BIT_WORDS
MOST_DIFFERENT = int(_BITS * (1 - _SHARE) + DEVIATIONS * (_BITS * _SHARE * (1 - _SHARE)) ** 0.5)

_NONE = np.empty(0, np.uint64)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
_FACTORS = mixed(np.arange(1000, 1000 + _BITS, dtype=np.uint64)) | np.uint64(1)


def _attempt(number: int) -> np.ndarray:
    """The bin that each bin asks at its nth attempt."""
    asked = np.arange(BINS, dtype=np.uint64) * np.uint64(ATTEMPTS) + np.uint64(number)
    return (mixed(asked) >> np.uint64(56)).astype(np.int64)


_ASKED = [_attempt(number) for number in range(ATTEMPTS)]


def shingle_set(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = text.lower().split() if text else ()  # on bytes: A-Z, and \x20 \x09-\x0d
    if not words:
        return _NONE
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(folded(hashed, min(width, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin: its least hash, or that of the bin it copies from."""
    at = np.searchsorted(shingles, _EDGES)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & ((least >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64))
    values = np.where(filled, least, np.uint64(0))
    empty = np.flatnonzero(~filled)
    for asked in _ASKED:
        if not len(empty):
            return values
        found = filled[asked[empty]]
        values[empty[found]] = least[asked[empty[found]]]
        empty = empty[~found]
    values[empty] = shingles[0]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    total = _BAND.copy()
    for row in range(BAND_ROWS):
        total = mixed(total + rows[:, row])
    return total.view(np.int64)


def minimum_bits(shingles: np.ndarray) -> np.ndarray:
    """A bit of the least shingle under each of many orders, packed into longs."""
    least = np.full(_BITS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 512):
        part = shingles[at:at + 512]
        least = np.minimum(least, (part[:, None] * _FACTORS).min(axis=0))
    return np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        sizes, keys, bands = [], [], []
        for text in utf8(batch.column(1)):
            shingles = shingle_set(text)
            sizes.append(len(shingles))
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            bands.append(band_keys(signature(shingles)) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "bands"],
        )


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        sets = [shingle_set(text).view(np.int64) for text in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
        )


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        sets = [shingle_set(text) for text in utf8(batch.column(1))]
        bits = np.array([minimum_bits(one) for one in sets]).reshape(len(sets), BIT_WORDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([band_keys(signature(one)) for one in sets], pa.list_(pa.int64())),
             *(pa.array(bits[:, word]) for word in range(BIT_WORDS))],
            names=["id", "bands", *(f"w{word}" for word in range(BIT_WORDS))],
        )


def signed(documents: DataFrame) -> DataFrame:
    """`(doc_id, n_shingles, set_key, bands)`; the last two NULL without words."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signed, "doc_id long, n_shingles long, set_key binary, bands array<long>"
    )


def shingle_classes(rows: DataFrame) -> DataFrame:
    """`(set_key, id, n_shingles, copies, bands)`: texts of equal sets under their least doc_id."""
    return (
        rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n_shingles"),
             F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    )


def bucket_members(classes: DataFrame) -> DataFrame:
    """`(bucket, members, band, id, n_shingles)` of the buckets that hold two classes or more."""
    rows = classes.select("id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return spread_join(rows, stored(shared, "buckets"), "bucket", "members", "id")


def _comparable(edges: DataFrame) -> DataFrame:
    """Pairs whose set sizes allow the similarity; each pair once, the smaller id first."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return edges.filter(small * 100 >= large * PERCENT).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    ).distinct()


def star_edges(members: DataFrame) -> DataFrame:
    """Each bucket's centre paired with its other members: `(a, b, n_a, n_b)`."""
    met = members.groupBy("id").agg(F.sum(F.col("members") - 1).alias("met"))
    centres = (
        members.join(met, "id").groupBy("bucket")
        .agg(F.max(F.struct("met", (-F.col("id")).alias("order"), "n_shingles")).alias("c"),
             F.max("members").alias("members"))
        .select("bucket", (-F.col("c.order")).alias("a"), F.col("c.n_shingles").alias("n_a"), "members")
    )
    rows = members.select("bucket", F.col("id").alias("b"), F.col("n_shingles").alias("n_b"))
    paired = spread_join(rows, stored(centres, "centres"), "bucket", "members", "b", rows_per_task=ROWS_PER_TASK)
    return _comparable(paired.filter("a <> b"))


def cross_pairs(members: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of bucket members in different components whose bits allow the similarity.

    A pair is made in the first bucket it shares only. The members of a large bucket
    are compared block by block: each row meets every block of the other side.
    """
    words = [f"w{word}" for word in range(BIT_WORDS)]
    rows = members.join(bits, "id").withColumn(
        "blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int"))
    left = rows.select(
        "bucket", "band", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("component").alias("c_a"),
        F.col("bands").alias("bands_a"), *[F.col(word).alias(f"a_{word}") for word in words],
    )
    right = rows.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("component").alias("c_b"),
        F.col("bands").alias("bands_b"), *[F.col(word).alias(f"b_{word}") for word in words],
    )
    different = sum((F.bit_count(F.col(f"a_{word}").bitwiseXOR(F.col(f"b_{word}"))) for word in words), F.lit(0))
    earlier = F.exists(
        F.sequence(F.lit(0), F.col("band") - 1), lambda at: F.get("bands_a", at) == F.get("bands_b", at))
    met_before = F.when(F.col("band") > 0, earlier).otherwise(F.lit(False))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    pairs = left.hint("shuffle_hash").join(
        right, (left["bucket"] == right["bucket"]) & (left["block"] == right["block"])
        & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & (small * 100 >= large * PERCENT)
        & (different <= MOST_DIFFERENT) & ~met_before,
    )
    return pairs.select("a", "b", "n_a", "n_b")


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that reach the similarity on their full sets: `(a, b)`."""
    uses = edges.groupBy("b").agg(F.count(F.lit(1)).alias("uses"))
    sized = sets.join(uses, sets["id"] == uses["b"]).select("b", "uses", F.col("shingles").alias("_sb"))
    narrow = spread_join(edges, sized, "b", "uses", "a", fits=False, rows_per_task=ROWS_PER_TASK)
    uses = edges.groupBy("a").agg(F.count(F.lit(1)).alias("uses"))
    sized = sets.join(uses, sets["id"] == uses["a"]).select("a", "uses", F.col("shingles").alias("_sa"))
    both = spread_join(narrow.drop("uses"), sized, "a", "uses", "b", fits=False, rows_per_task=ROWS_PER_TASK)
    shared = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    union = F.col("n_a") + F.col("n_b") - shared
    return both.filter(shared * 100 >= union * PERCENT).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """`(id, component)` of every linked id, by least-label spreading with jumps.

    Each round takes the least label among neighbours and then the label of that
    label; the rounds grow with the logarithm of a chain's length.
    """
    ways = stored(
        links.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct(),
        "ways",
    )
    labels = stored(
        ways.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels"
    )
    while True:
        fits = fits_broadcast(labels)
        known = labels.select(F.col("id").alias("other"), F.col("component").alias("heard"))
        if fits:
            heard = ways.join(F.broadcast(known), "other")
        else:
            uses = ways.groupBy("other").agg(F.count(F.lit(1)).alias("uses"))
            heard = spread_join(ways, known.join(uses, "other"), "other", "uses", "id", fits=False)
        best = heard.groupBy("id").agg(F.min("heard").alias("heard"))
        near = stored(
            labels.join(best, "id").select("id", "component", F.least("component", "heard").alias("next")),
            "near-labels",
        )
        # the label of the label: many ids share one label, so it is spread
        far = near.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        if fits:
            jumped = near.join(F.broadcast(far), "next")
        else:
            uses = near.groupBy("next").agg(F.count(F.lit(1)).alias("uses"))
            jumped = spread_join(near, far.join(uses, "next"), "next", "uses", "id", fits=False)
        moved = stored(
            jumped.select("id", F.col("beyond").alias("after"), (F.col("beyond") < F.col("component")).alias("moved")),
            "labels",
        )
        labels = moved.select("id", F.col("after").alias("component"))
        if moved.filter("moved").isEmpty():
            return labels


def unresolved(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with components, of the buckets that still hold several components."""
    if fits_broadcast(found):
        found = F.broadcast(found)
    placed = stored(
        members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed"
    )
    several = (
        placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high").select("bucket")
    )
    several = placed.join(stored(several, "several"), "bucket", "left_semi")
    return stored(several.select(*members.columns, "component"), "unresolved")


def linked_classes(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """`(id, component)` of the classes that are linked with another class."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    members = stored(bucket_members(classes), "members")
    edges = stored(star_edges(members), "edges")
    links = stored(confirmed(edges, paired_sets(texts, edges)), "links")
    found = components(links)
    rows = unresolved(members, found)
    if rows.isEmpty():
        return found
    ids = stored(rows.select(F.col("id").alias("doc_id")).distinct(), "ids")
    layout = ", ".join(f"w{word} long" for word in range(BIT_WORDS))
    bits = stored(only(texts, ids).mapInArrow(_with_bits, f"id long, bands array<long>, {layout}"), "bits")
    edges = stored(cross_pairs(rows, bits), "edges")
    more = stored(confirmed(edges, paired_sets(texts, edges)), "links")
    return components(links.unionByName(more)) if not more.isEmpty() else found


def paired_sets(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """`(id, shingles)` of the documents that stand for a paired class."""
    ids = stored(edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct(), "ids")
    return stored(only(texts, ids).mapInArrow(_with_sets, "id long, shingles array<long>"), "sets")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` for every row of `documents(doc_id, text)`."""
    rows = stored(signed(documents), "signed")
    classes = stored(shingle_classes(rows), "classes")
    found = linked_classes(documents, classes)
    if fits_broadcast(found):
        found = F.broadcast(found)
    owners = classes.select("set_key", "id", "copies").join(found, "id", "left").select(
        "set_key", "copies", F.coalesce("component", "id").alias("component_id")
    )
    narrow = rows.select("doc_id", "n_shingles", "set_key")
    alone = F.col("set_key").isNull() | F.col("doc_id").isNull()
    linked = spread_join(
        narrow.filter(~alone), stored(owners, "owners"), "set_key", "copies", "doc_id"
    ).select("doc_id", "n_shingles", "component_id")
    rest = narrow.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without those whose group is stood for by another one."""
    gone = stored(near_duplicates(documents).filter("NOT kept").select("doc_id"), "near-copies")
    return without(documents, gone)
