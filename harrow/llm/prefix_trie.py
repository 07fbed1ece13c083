"""The trie of conversation prefixes, by collapsing whole sequences.

A node is a distinct sequence of first turns, known by its depth and two 64-bit sums (exclusive
or) of hashes of (place, SHA-256 of role and text) over its turns. Such sums run along a
conversation like any running total, so that a conversation of any length is worked on in blocks.

1. Identical conversations collapse into one weighted sequence, for which the conversation
   with the smallest id stands; the others are never expanded.
2. Sequences that are a proper prefix of another one are dropped by an anti-join: the rest
   are the leaves.
3. The prefixes of the weighted sequences are summed up by node.
4. Each node is owned by the smallest leaf below it. Sums over subtrees are then sums, over the
   leaves below a node, of what a leaf owns at or under the node's depth: a running
   total along each leaf's path and one grouping. No node meets its descendants.

A node that a third of all conversations share is one group of partial sums; where rows are
joined to it, they are spread (`spread_join`). The list of conversations that end at a node
is kept in chunks of bounded size; its digest streams over the chunks in order.

Turns are ordered by `turn` (NULL first), those of equal turn by the SHA-256 of role and text;
repeated rows are turns of their own. NULL role or text is empty. Rows without conv_id belong to
no conversation and are left out. Texts count whole, by their UTF-8 bytes. No conversations, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.joins import spread_join
from harrow.operators.order import numbered
from harrow.session import hinted, stored

FAMILY = 5
LEADS = 9
BLOCK = 1024
CHUNK = 4096
_KEY = ("depth", "k1", "k2")


def _node(depth: Column, k1: Column, k2: Column) -> Column:
    return F.struct(depth.cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"))


def _root() -> Column:
    return _node(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


# --- conversations -----------------------------------------------------------

def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns numbered over all conversations, and a row per conversation: its first number and its turns."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"))  # parts repeated rows, which are interchangeable
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    found = numbered(turns, order, "number").select("conv_id", "digest", "bytes", "number")
    heads = found.groupBy("conv_id").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n_turns"))
    return found, stored(heads, "conversations")


def _hashes(place: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), place, F.col("digest")).alias(f"h{seed}") for seed in (1, 2)]


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences of conversations as they are: their turns and a row per conversation."""
    turns, heads = placed_turns(conversations)
    members = heads.withColumn("size", F.col("n_turns"))
    place = F.col("number") - F.col("first")
    rows = spread_join(turns, members, "conv_id", "n_turns", "number")
    return rows.select("conv_id", place.alias("place"), "first", "size", "bytes", *_hashes(place)), members


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences of conversations that begin like the first of their family of five.

    With h = CRC-32 of the decimal conv_id, modulo 9: the first h turns of conversation
    conv_id - conv_id % 5 (as many as it has, none without it), then the conversation's
    own turns after its first h.
    """
    turns, heads = placed_turns(conversations)
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADS
    heads = heads.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": lead})
    bases = heads.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    led = F.least(F.col("h"), F.coalesce(F.col("base_turns"), F.lit(0)))
    heads = heads.join(hinted(bases), "base", "left").withColumn("led", led).withColumn(
        "size", F.col("led") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)))
    heads = stored(heads.select("conv_id", "first", "n_turns", "base", "h", "led", "size"), "members")
    rows = spread_join(turns, heads, "conv_id", "n_turns", "number").withColumn("at", F.col("number") - F.col("first"))
    place = F.col("led") + F.col("at") - F.col("h")
    own = rows.filter("at >= h").select("conv_id", place.alias("place"), "first", "size", "bytes", *_hashes(place))
    begun = rows.filter((F.col("at") < LEADS - 1) & (F.col("conv_id") % FAMILY == 0)).select(
        F.col("conv_id").alias("base"), F.col("at").alias("place"), "digest", "bytes")
    # at most 8 turns of a base meet at most 9 conversations
    taken = begun.join(heads.select("conv_id", "base", "first", "size", "h"), "base").filter("place < h").select(
        "conv_id", "place", "first", "size", "bytes", *_hashes(F.col("place")))
    return own.unionByName(taken), heads


# --- the trie ----------------------------------------------------------------

def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its node, its parent's node, and whether the conversation ends here."""
    turns = stored(turns.withColumn("block", F.floor(F.col("place") / BLOCK)), "turns")
    full = turns.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2")).filter(F.col("n") == BLOCK)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    carried = full.select(
        "conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("c1").over(before).alias("c1"),
        F.bit_xor("c2").over(before).alias("c2"))  # a row per full block
    within = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = turns.withColumns({f"k{n}": F.bit_xor(f"h{n}").over(within) for n in (1, 2)})
    summed = summed.join(hinted(stored(carried, "carried")), ["conv_id", "block"], "left").withColumns(
        {f"k{n}": F.col(f"k{n}").bitwiseXOR(F.coalesce(f"c{n}", F.lit(0).cast("long"))) for n in (1, 2)})
    parent = [F.col(f"k{n}").bitwiseXOR(F.col(f"h{n}")) for n in (1, 2)]
    return stored(summed.select(
        "conv_id", "first", "size", "bytes", _node(F.col("place") + 1, F.col("k1"), F.col("k2")).alias("node"),
        _node(F.col("place"), *parent).alias("parent")), "prefixes")


def _suffix_sums(owned: DataFrame) -> DataFrame:
    """`(node, saved)` rows: for each node of a leaf's path, what the leaf owns there and below."""
    owned = stored(owned.withColumn("block", F.floor(F.col("node.depth") / BLOCK)), "owned")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    totals = owned.filter("block > 0").groupBy("conv_id", "block").agg(F.sum("value").alias("total"))
    carried = totals.select("conv_id", (F.col("block") - 1).alias("block"), F.sum("total").over(later).alias("carry"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("node.depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = owned.withColumn("saved", F.sum("value").over(within))
    return summed.join(hinted(stored(carried, "carried")), ["conv_id", "block"], "left").select(
        "node", (F.col("saved") + F.coalesce("carry", F.lit(0))).alias("saved"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the lists of members that end at them, in chunks.

    `turns(conv_id, place, first, size, bytes, h1, h2)` and `members(conv_id, first, size)` come from `plain` or
    `rebuilt`. Nodes: `node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`. Lists:
    `node, chunk, conv_ids`, ascending within and along the chunks.
    """
    prefixes = _prefixes(turns)
    whole = prefixes.filter("node.depth = size").select("conv_id", "first", "size", "node").unionByName(
        members.filter("size = 0").select("conv_id", "first", F.col("size").cast("long"), _root().alias("node")))
    whole = stored(whole, "whole")
    # ids ascend with `first`, and no two are the same: a chunk holds at most CHUNK ids
    ends = whole.groupBy("node", F.floor(F.col("first") / CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("conv_ids"))
    sequences = stored(whole.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), "sequences")

    standing = sequences.select("conv_id", "n", F.col("size").alias("weight"))
    paths = spread_join(prefixes, standing, "conv_id", "weight", "node").select(
        "conv_id", "n", "size", "bytes", "node", "parent")
    roots = sequences.select(
        "conv_id", "n", "size", F.lit(0).cast("long").alias("bytes"), _root().alias("node"),
        F.lit(None).cast(prefixes.schema["parent"].dataType).alias("parent"))
    paths = stored(paths.unionByName(roots), "paths")
    proper = paths.filter("node.depth < size").select("node").distinct()
    leaves = stored(sequences.join(proper, "node", "left_anti").select("conv_id", "size"), "leaves")
    leaf_paths = stored(spread_join(
        paths.select("conv_id", "node"), leaves.withColumn("weight", F.col("size") + 1), "conv_id", "weight", "node"
    ).select("conv_id", "node"), "leaf_paths")

    nodes = paths.groupBy("node").agg(
        F.min("conv_id").alias("least"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("parent").alias("parent"))
    below = leaf_paths.groupBy("node").agg(F.count(F.lit(1)).alias("n_leaves"), F.min("conv_id").alias("owner"))
    nodes = stored(nodes.join(below, "node"), "nodes")

    values = nodes.select("node", "owner", "n_leaves", ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"))
    owned = spread_join(leaf_paths, values, "node", "n_leaves", "conv_id").select(
        "conv_id", "node", F.when(F.col("owner") == F.col("conv_id"), F.col("value")).otherwise(0).alias("value"))
    saved = _suffix_sums(owned).groupBy("node").agg(F.sum("saved").alias("saved_tokens"))

    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(saved, "node").join(children, "node", "left").select(
        "node", "parent", "least", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens"), "nodes")
    above = nodes.filter("n_children > 0").select(
        F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    linked = spread_join(nodes.filter("parent is not null"), above, "parent", "weight", "node")
    top = nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["node", F.col("least").alias("conv_id"), F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs",
               "n_children", "n_leaves", "saved_tokens"]
    return linked.select(*columns).unionByName(top.select(*columns)), ends


# --- digests -----------------------------------------------------------------

def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows `(key, joined ids)` in order: the SHA-256 over all rows of a key, joined by commas."""
    key, hashed = None, None
    for batch in batches:
        done = []
        for *found, ids in zip(*(column.to_pylist() for column in batch.columns)):
            if found != key:
                if key is not None:
                    done.append((*key, hashed.hexdigest()))
                key, hashed = found, hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
        yield _digests(done)
    if key is not None:
        yield _digests([(*key, hashed.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, kinds)], names=[*_KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """`(node, ends_sha256)`: the digest of the whole list of a node, read chunk by chunk."""
    rows = ends.select(*[F.col(f"node.{name}").alias(name) for name in _KEY], "chunk",
                       F.concat_ws(",", F.transform("conv_ids", lambda c: c.cast("string"))).alias("ids"))
    ordered = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").drop("chunk")
    return ordered.mapInArrow(_digest, "depth long, k1 long, k2 long, ends_sha256 string").select(
        _node(*map(F.col, _KEY)).alias("node"), "ends_sha256")


def trie_report(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    nodes, ends = prefix_trie(*rebuilt(conversations))
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(end_digests(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
