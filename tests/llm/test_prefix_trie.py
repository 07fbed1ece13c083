"""The conversation trie against one built of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from harrow.llm import prefix_trie
from tests.conftest import plan_of
from tests.llm.conftest import CLASHING

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """Conversations of (conv_id, turn, role, text) rows."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, digest, (role, text)))
    return {conv_id: [row[3] for row in sorted(found)] for conv_id, found in turns.items()}


def remainder(a, b):  # with the sign of a, as in SQL
    return abs(a) % b * (1 if a >= 0 else -1)


def led(own):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - remainder(c, 5), [])[:h[c]] + own[c][h[c]:] for c in own}


def trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for conv_id, turns in sequences.items():
        ends[tuple(turns)].append(conv_id)
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv_id)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        leaf = not children[node]
        value = (len(found) - 1) * len(node[-1][1].encode()) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += leaf
            saved[node[:depth]] += value
    return sorted(
        ((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children[node], leaves[node],
          saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
         for node, found in members.items()), key=str)


def odd_turns():
    rng = random.Random(11)
    rows = []
    for conv_id in [*range(-7, 40), 10**15, 10**15 + 3, 2**63 - 1]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv_id, turn, rng.choice(["user", "model"]), rng.choice(["a", "b é 北", ""])))
    rows += [(50, None, None, None), (50, None, "user", "x"), (50, 3, "user", None), (50, 3, "model", ""), (50, 3, "model", "")]
    rows += [(c, 0, "user", "short") for c in (61, 62, 63)]  # no conversation 60: turnless where h > 0
    rows += [(c, t, "user", f"turn {t}") for c in range(70, 95) for t in range(9)]  # copies
    rows += [(None, 1, "user", "of nobody"), (None, None, None, None)]
    return rows


def frame_of(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    clashing = [*CLASHING, "node", "depth", "place", "first", "size", "bytes", "digest", "number", "base", "h", "led"]
    return frame.withColumns({name: F.lit(f"x-{name}") for name in clashing})


def test_odd_conversations(spark):
    rows = odd_turns()
    found = prefix_trie.trie_report(frame_of(spark, rows))
    assert found.columns == COLUMNS
    expected = trie(led(ordered(rows)))
    assert any(row[1] == 0 and row[7] != hashlib.sha256(b"").hexdigest() for row in expected)  # some are turnless
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_without_broadcasts_and_in_small_parts(spark, no_broadcast, monkeypatch):
    """Blocks of three turns, chunks of ids and parts of heavy keys: every cut is met."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    monkeypatch.setattr(
        prefix_trie, "spread_join", lambda *a: join(*a, rows_per_task=4))
    join = prefix_trie_join
    rows = odd_turns()
    found = prefix_trie.trie_report(frame_of(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == trie(led(ordered(rows)))


prefix_trie_join = prefix_trie.spread_join


@pytest.mark.parametrize("length", [1023, 1024, 1025, 2500])
def test_long_conversations(spark, length):
    rows = [(c, t, "user", f"t{t}") for c in (1, 2) for t in range(length)] + [(3, t, "user", f"t{t}") for t in range(length - 1)]
    nodes, ends = prefix_trie.prefix_trie(*prefix_trie.plain(frame_of(spark, rows)))
    expected = {(r[0], r[1]): r[3:7] for r in trie(ordered(rows))}
    found = {(r["conv_id"], r["depth"]): (r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
             for r in nodes.collect()}
    assert found == expected
    assert sorted((r["node"]["depth"], r["conv_ids"]) for r in ends.collect()) == [(length - 1, [3]), (length, [1, 2])]


def test_empty_table(spark):
    assert prefix_trie.trie_report(frame_of(spark, [])).collect() == []


def test_copies_are_not_expanded(spark):
    """Many copies of one conversation: prefixes are made of one of them."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 2000, 5) for t in range(4)]
    found = prefix_trie.trie_report(frame_of(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == trie(ordered(rows))  # ids divisible by 5 stay as they are
    assert "CartesianProduct" not in plan_of(prefix_trie.trie_report(frame_of(spark, rows)))
