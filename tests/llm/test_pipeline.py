"""The pipeline against its parts done by brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import language_id, packing
from harrow.llm.queries import WORD_BPE, tokenizer_file
from harrow.sources.tables import read_table

from .test_near_duplicates import brute_force
from .test_text_operators import dedup

FOLDER = "/root/testdata/sf0.01"


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again, the input first."""
    docs = read_table(spark, FOLDER, "documents")
    results = [docs]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        results.append(docs)
    return results


def test_columns_stay(stages):
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_languages(stages):
    """What the rule says of each text, one by one; the tables' own documents are clean."""
    before, after = texts(stages[0]), texts(stages[1])
    rule = language_id.learned_rejection(stages[0])
    kept = [row for row in before if all(map(rule.keeps, language_id.judged(rule.memo(), [row[1]])))]
    assert sorted(after) == sorted(kept) == sorted(row for row in before if any(map(str.isalpha, row[1])))


def test_lines(stages):
    import hashlib
    after = sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(stages[2]))
    assert after == sorted((row[0], row[3]) for row in dedup(texts(stages[1])))
    assert stages[2].filter(F.col("n_chars") != F.char_length("text")).isEmpty()


def test_one_of_each(stages):
    kept = {doc_id for doc_id, _ in texts(stages[3])}
    assert kept == {doc_id for doc_id, _, component in brute_force(texts(stages[2])) if doc_id == component}


def test_no_leaks(spark, stages):
    items = [r["text"].strip() for r in read_table(spark, FOLDER, "benchmark").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    assert sorted(after) == sorted((i, t) for i, t in before if not any(item in t for item in items))


def test_packed(stages):
    expected = packing.pieces(stages[4], tokenizer_file(WORD_BPE))
    got = stages[5].select(*expected.columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_run_is_the_stages_in_order(spark, stages):
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select(columns).collect())) == sorted(
        map(tuple, stages[5].select(columns).collect()))


def test_empty_and_odd_tables(spark, odd_rows, no_documents):
    wide = spark.createDataFrame(
        [(i, t, ["en", "fr", None][n % 3], "s", 0) for n, (i, t) in enumerate(odd_rows)],
        "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1))
    for docs in (no_documents, wide):
        for name, stage in corpus_pipeline.STAGES:
            docs = docs.sparkSession.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        assert {"sequence_id", "offset"} <= set(docs.columns)
