"""A grown index against a plain model and against one built at once."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.plans import search as plans
from harrow.session import new_path
from harrow.sources import grown_index
from harrow.sources.index_store import build_index

COLUMNS = "doc_id long, url string, title string, text string"
WORDS = [f"word{n}" for n in range(30)]


def batches_of(seed, count, again=0.4):
    """Batches of documents; some are fetched again with other texts, some are empty or missing."""
    rng = random.Random(seed)
    batches, known = [], []
    for number in range(count):
        fresh = list(range(1000 * number, 1000 * number + rng.randrange(0, 8)))
        old = [n for n in known if rng.random() < again]
        known += fresh
        batches.append([
            (n, f"http://host.example/{n}", f"title {number}", rng.choice(
                [None, "", " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))])) for n in fresh + old])
    return batches


class Model:
    """What all batches together should say."""

    def __init__(self):
        self.documents, self.postings = {}, {}

    def add(self, batch):
        for doc_id, url, title, text in batch:
            words = (text or "").split()
            self.documents[doc_id] = (doc_id, url, title, len(words))
            for word in set(words):
                self.postings[word, doc_id] = words.count(word)

    def rows(self):
        return sorted((w, d, n, self.documents[d][3]) for (w, d), n in self.postings.items())

    def frequencies(self):
        found = {}
        for word, _ in self.postings:
            found[word] = found.get(word, 0) + 1
        return sorted(found.items())


def frame(spark, batch):
    return spark.createDataFrame(batch, COLUMNS)


def said_by(index):
    return (
        sorted(map(tuple, index.documents.select("doc_id", "url", "title", "doc_length").collect())),
        sorted(map(tuple, index.postings.select("term", "doc_id", "tf", "doc_length").collect())),
        sorted(map(tuple, index.term_stats.select("term", "df").collect())),
    )


@pytest.mark.parametrize("seed, fanout", [(1, 2), (2, 3)])
def test_every_version_against_a_model(spark, seed, fanout):
    path, model, kept = new_path(spark, "grown"), Model(), []
    for number, batch in enumerate(batches_of(seed, 6)):
        index = grown_index.grow(frame(spark, batch), path, batch=number, fanout=fanout)
        model.add(batch)
        documents = sorted(model.documents.values())
        expected = documents, model.rows(), model.frequencies()
        assert said_by(index) == expected
        lengths = [row[3] for row in documents]
        assert index.n_docs == max(1, len(lengths))
        assert index.avgdl == (sum(lengths) / len(lengths) if sum(lengths) else 100.0)
        kept.append(expected)
    version = grown_index.read_version(path)
    assert len(version.segments) < 6 and any(segment.level > 0 for segment in version.segments)
    for number, expected in enumerate(kept, 1):  # earlier versions are as they were
        assert said_by(grown_index.open_grown(spark, path, number)) == expected


def test_searches_as_an_index_built_at_once(spark):
    batches = batches_of(5, 5)
    path, model = new_path(spark, "grown"), Model()
    latest = {}
    for number, batch in enumerate(batches):
        grown_index.grow(frame(spark, batch), path, batch=number)
        model.add(batch)
        latest |= {row[0]: row for row in batch}
    postings = spark.createDataFrame([(w, d, n) for (w, d), n in model.postings.items()], "term string, doc_id long, tf int")
    built = build_index(frame(spark, sorted(latest.values())), postings=postings)
    grown = grown_index.open_grown(spark, path)
    rng = random.Random(1)
    asked = spark.createDataFrame([(n, " ".join(rng.choices(WORDS, k=3))) for n in range(20)], "qid long, q string")
    for bounded in (False, True):
        one, two = (
            sorted(map(tuple, plans.search_batch(index, asked, k=4, use_tf=True, bounded=bounded).collect()))
            for index in (built, grown))
        assert one == two and one
    assert [tuple(r) for r in plans.search(built, "word1 word2").collect()] == [
        tuple(r) for r in plans.search(grown, "word1 word2").collect()]


def test_replays_and_empty_batches(spark):
    path = new_path(spark, "grown")
    assert said_by(grown_index.open_grown(spark, path)) == ([], [], [])
    assert grown_index.open_grown(spark, path).n_docs == 1
    batch = [(1, "u", "t", "word1 word1")]
    grown_index.grow(frame(spark, batch), path, batch=0)
    grown_index.grow(frame(spark, batch), path, batch=0)
    grown_index.grow(frame(spark, []), path, batch=1)
    version = grown_index.read_version(path)
    assert (version.number, version.through, len(version.segments), version.n_docs) == (2, 1, 1, 1)


def test_without_broadcasts(spark, no_broadcast):
    path, model = new_path(spark, "grown"), Model()
    for number, batch in enumerate(batches_of(9, 3)):
        index = grown_index.grow(frame(spark, batch), path, batch=number, fanout=2)
        model.add(batch)
    assert said_by(index) == (sorted(model.documents.values()), model.rows(), model.frequencies())


def test_new_documents_read_no_segment(spark, monkeypatch):
    """A batch of ids beyond the published ones opens no earlier table."""
    path = new_path(spark, "grown")
    grown_index.grow(frame(spark, [(1, "u", "t", "word1")]), path, batch=0)
    opened = []
    monkeypatch.setattr(grown_index._Tables, "_live", lambda *args: opened.append(args))
    monkeypatch.setattr(grown_index, "opened", lambda *args: None)
    grown_index.grow(frame(spark, [(2, "u", "t", "word1")]), path, batch=1)
    assert not opened
    monkeypatch.undo()
    assert grown_index.open_grown(spark, path).term_stats.select(F.col("df")).first()["df"] == 2
