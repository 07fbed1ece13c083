"""The language stage rejects what no learned language explains."""

import base64
import random
import string

from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import language_id
from harrow.sources.tables import read_table

FOLDER = "/root/testdata/sf0.01"


def planted():
    rng = random.Random(7)
    noise = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(600)) for _ in range(8)]
    blobs = [base64.b64encode(rng.randbytes(3000)).decode() for _ in range(8)]
    hexes = [" ".join(rng.randbytes(30).hex() for _ in range(60)) for _ in range(8)]
    scripts = [
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", "Привет",
        "中华人民共和国是世界上人口最多的国家之一。", "ประเทศไทยเป็นประเทศในเอเชียตะวันออกเฉียงใต้",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι", "Все счастливые семьи похожи, see the note",
    ]
    return noise + blobs + hexes + scripts


def test_language_stage_rejects(spark):
    docs = read_table(spark, FOLDER, "documents")
    extra = spark.createDataFrame(
        [(10 ** 9 + n, text) for n, text in enumerate(planted())], "doc_id long, text string").select(
        F.col("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit("planted").alias("source"),
        F.char_length("text").alias("n_chars"))
    both = docs.unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema]))
    kept = {str(r["doc_id"]) for r in corpus_pipeline.in_a_language(spark, both, FOLDER).select("doc_id").collect()}
    clean = {str(r["doc_id"]) for r in docs.select("doc_id").collect()}
    assert kept == clean


def test_floors_are_of_all_training_documents(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.25, 0.5]), rng.choice([0, 1, 50, 900])) for _ in range(3000)]
    wanted = {}
    for lang in "ab":
        found = sorted((c, n) for one, c, n in rows if one == lang and n)
        total, so_far = sum(n for _, n in found), 0
        for certainty, n in found:
            so_far += n
            if so_far >= language_id.FLOOR_SHARE * total:
                wanted[lang] = certainty
                break
    table = spark.createDataFrame(rows, "lang string, certainty double, words long")
    assert language_id.learned_floors(table) == wanted


def test_words_are_counted_in_all_training_documents(spark):
    rows = [(n, "en", "again") for n in range(2000)] + [(2001, None, "again"), (2002, "de", "wieder again")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    own = docs.filter(~language_id.held_out(F.col("doc_id")))
    found = {(r["lang"], r["word"]): r["n"] for r in language_id.training_words(docs).collect()}
    assert found[("en", "again")] == own.filter("lang = 'en'").count() > 1000


def test_vocabulary_is_the_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(language_id, "VOCABULARY", 3)
    text = " ".join("ab" + chr(97 + n) for n in range(26) for _ in range(n + 1))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(text).alias("text"))
    assert {r["word"] for r in language_id.training_words(docs).collect()} == {"abx", "aby", "abz"}
