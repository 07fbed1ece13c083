import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import near_duplicates as nd
from harrow.sources.tables import read_table


def plain_sets(rows):
    found = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        if len(words) >= 5:
            found.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
        else:
            found.append({tuple(words)} if words else set())
    return found


def brute_force(rows):
    """Component per row by comparing all pairs; rows without an id stay alone."""
    sets = plain_sets(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(root(i)) if doc_id is not None else None) for i, (doc_id, _) in enumerate(rows)]


def found(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


def test_odd_rows(odd_documents, odd_rows):
    result = nd.near_duplicates(odd_documents)
    assert found(result) == sorted(brute_force(odd_rows), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in result.collect())
    kept = nd.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == result.filter("kept").count()


def families(seed, sizes, length, edits):
    """Texts edited at random from common originals."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"t{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(length)] = f"t{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,edits", [(150, 12), (30, 4), (8, 2)])
def test_families_of_edited_copies(spark, length, edits):
    rows = families(length, [1, 2, 5, 60], length, edits)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(documents)) == sorted(brute_force(rows), key=str)


def test_without_broadcasts(spark, no_broadcast):
    rows = families(3, [40, 3], 60, 8) + [(1000 + n, "the same words once more for all") for n in range(30)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(documents)) == sorted(brute_force(rows), key=str)


def test_chain_becomes_one_component(spark):
    base = [f"c{n}" for n in range(400)]
    rows = [(n, " ".join(base[n * 8:n * 8 + 100])) for n in range(30)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(documents)) == sorted(brute_force(rows), key=str)


def test_all_of_a_small_table(spark, folder):
    documents = read_table(spark, folder, "documents")
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(nd.near_duplicates(documents)) == sorted(brute_force(rows), key=str)


def test_no_rows(no_documents):
    assert nd.near_duplicates(no_documents).count() == 0
    assert nd.keep_one(no_documents).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 100, 3000])
def test_signatures_estimate_similarity(size):
    rng = np.random.default_rng(size)
    shared = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, size // 3, dtype=np.uint64)])) for _ in range(2))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((nd.signature(a) == nd.signature(b)).mean() - true) < 0.15
    different = sum(int(x).bit_count() for x in (nd.minimum_bits(a) ^ nd.minimum_bits(b)).view(np.uint64))
    assert abs(1 - 2 * different / (64 * nd.BIT_WORDS) - true) < 0.1


def test_cross_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    rows = families(9, [25], 80, 14)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(documents)) == sorted(brute_force(rows), key=str)


def test_star_edges_are_few(spark):
    rows = families(4, [80], 200, 4)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    classes = nd.shingle_classes(nd.signed(documents))
    members = nd.bucket_members(classes)
    edges = nd.star_edges(members)
    assert edges.count() < 6 * classes.count()
    assert edges.filter(F.col("a") >= F.col("b")).isEmpty()
