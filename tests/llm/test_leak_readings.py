"""Leaks that depend on what stands before a name, on case, on lines and on numbers."""

import random

import duckdb
from pyspark.sql import functions as F

from harrow.llm import decontamination
from harrow.llm.oracles import BENCHMARK_LEAKS

ITEMS = [
    (1, "Alice buys 5 apples and 3 pears. Alice eats 2 of them before lunch. How many are left?"),
    (2, "What is the capital city of the French Republic today?"),
    (3, "How many moons of the planet Saturn have been named after giants"),
]
TEXTS = [
    (1, "Bob buys 7 apples and 4 pears. Bob eats 1 of them before lunch. How many are left?", 1),
    (2, "we ask What is the capital city of the French Republic today? and more", 2),
    (3, "HOW MANY MOONS OF THE PLANET SATURN HAVE BEEN NAMED AFTER GIANTS", 3),
    (4, "How many\nmoons of the planet\n  Saturn have been\nnamed after giants", 3),
    (5, "Bob buys 7 apples\nand 4 pears.\nBob eats 1 of them before\nlunch. How many are left?", 1),
    (6, "Bob buys 7 apples and 4 pears. Carl eats 1 of them before lunch. How many are left?", None),
    (7, "What is the capital of the old republic", None),
]


def twin(texts, items):
    """What the SQL finds; slot counts and windows as well."""
    connection = duckdb.connect()
    for table, key, rows in (("documents", "doc_id", [row[:2] for row in texts]), ("benchmark", "item_id", items)):
        connection.execute(f"CREATE TABLE {table} ({key} BIGINT, text VARCHAR)")
        connection.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)
    cursor = connection.execute(BENCHMARK_LEAKS)
    columns = [column[0] for column in cursor.description]
    return sorted(tuple(dict(zip(columns, row))[name] for name in NAMES) for row in cursor.fetchall())


NAMES = ["doc_id", "item_id", "n_matched", "n_windows", "n_slots", "n_changed"]


def found(spark, texts, items):
    documents = spark.createDataFrame([row[:2] for row in texts], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.leak_report(documents, benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(rows) == len(pairs)
    assert sorted(tuple(row[name] for name in NAMES) for row in rows) == twin(texts, items)
    kept = {r["doc_id"] for r in decontamination.without_leaks(documents, benchmark).collect()}
    assert kept == {row[0] for row in texts} - {doc_id for doc_id, _ in pairs}
    return pairs


def test_names_case_and_lines(spark):
    assert found(spark, TEXTS, ITEMS) == {(doc_id, item) for doc_id, _, item in TEXTS if item}


SHORT = [
    (10, "What is 12 + 5 * 3 - 8 / 2?"), (11, "请问中华人民共和国的首都是哪座城市"), (12, "ประเทศไทยมีเมืองหลวงชื่ออะไร"),
    (13, "Who wrote Hamlet?"), (14, "3 | 14 | 15 | 92 | 65 | 35 | 89 | 79 | 32 | 38 | 46 | 26 | 43 | 38"),
]
SHORT_TEXTS = [
    (20, "homework: What is 12 + 5 * 3 - 8 / 2? Answer below", 10),
    (21, "homework: What is 12 + 5 * 3 + 8 / 2? Answer below", None),
    (22, "今天的问题是请问中华人民共和国的首都是哪座城市谢谢", 11), (23, "中华人民共和国的首都", None),
    (24, "คำถามประเทศไทยมีเมืองหลวงชื่ออะไรครับ", 12), (25, "tell me who wrote hamlet and why", 13),
    (26, "who wrote a hamlet", None), (27, f"row {SHORT[4][1]} end", 14), (28, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", None),
]


def test_numbers_and_scripts_without_spaces(spark):
    assert found(spark, SHORT_TEXTS, SHORT) == {(doc_id, item) for doc_id, _, item in SHORT_TEXTS if item}


NEW = [
    (30, "How many legs do two spiders and three horses and one small dog have when they stand together"),
    (31, "The quick river runs slowly past seven old broken stone bridges before it meets the cold sea near a quiet harbour town"),
    (32, "Photosynthesis?"), (33, "!!!"), (34, "Hamlet's"),
]
NEW_TEXTS = [
    (40, "How many legs do five spiders and nine horses and four small dog have when they stand together", 30),
    (41, "How many legs do 5 spiders and 9 horses and 4 small dog have when they stand together", 30),
    (42, "The quick river runs slowly past seven old broken stone bridges just shortly before it meets the cold sea near a quiet harbour town", 31),
    (43, "we learn what photosynthesis is", None), (44, "1)\nPHOTOSYNTHESIS!\nend", 32), (45, "!!!", None),
]


def test_number_words_inserted_words_and_short_items(spark):
    assert found(spark, NEW_TEXTS, NEW) == {(doc_id, item) for doc_id, _, item in NEW_TEXTS if item}


WAYS = (decontamination.TYPED, decontamination.NAMED, decontamination.PLAIN)


def test_tokens_are_lowered_once(spark):
    """One walk over a text and one lower case per token, in each reading."""
    text = spark.createDataFrame([("A",)], "text string")
    for way in WAYS:
        made = text.select(decontamination.templates(decontamination.raw_tokens(F.col("text"), way), way).alias("made"))
        plan = made._jdf.queryExecution().optimizedPlan().expressions().toString()
        assert plan.count("regexp_extract_all(") == 1 and plan.count("lower(") == 1


def test_tokens_of_mixed_letters(spark):
    """Words are the same runs of letters whichever alphabet they begin, go on or end in."""
    other = r"(?=[^\x00-\x7F])"
    latin = r"A-Za-zÀ-ÖØ-öø-ɏ"
    value = rf"[{latin}]++(?:{other}[\p{{L}}\p{{M}}]++)?|[0-9]+(?:[.,][0-9]+)*|[%$]|{other}(?:[\p{{L}}\p{{M}}]+|[€£°])"
    spaced = decontamination._SPACED
    wide = {
        decontamination.TYPED: rf"(?<=[\p{{Ll}}0-9,;]) \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*|{value}",
        decontamination.NAMED: rf"{decontamination._NAME}(?![\p{{L}}\p{{M}}])|{value}",
        decontamination.PLAIN: decontamination.PLAIN_TOKENS.replace(f"[a-zA-Z]++(?:{other}{spaced}++)?", f"[{latin}]++(?:{other}{spaced}++)?"),
    }
    rng = random.Random(3)
    alphabet = "abzABZéÉßŠƀɏɐжЖ京日ไก́İİıΣσ×÷ªµ0159.,;%$€£° -*\n\U0001D400\U0001F600"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)] + ["in Berlin Mitte, two Ännchen; see Ärzte 3.5 km"]
    rows = spark.createDataFrame([(text,) for text in texts], "text string")
    for way in WAYS:
        before = F.regexp_extract_all("text", F.lit(wide[way]), F.lit(0))
        now = decontamination.raw_tokens(F.col("text"), way)
        assert rows.filter(~before.eqNullSafe(now)).limit(3).collect() == []


def test_long_runs_of_numbers_and_names(spark):
    """Java's matcher calls itself once for each repetition of a plain group, which overflows its stack."""
    rows = spark.createDataFrame([
        ("in " + "Ab " * 50_000 + "now",), ("1" + ",2" * 50_000,), ("we met " + "Aé Ob\n" * 50_000,)], "text string")
    counts = {
        decontamination.TYPED: [(3, 150_000), (1, 100_001), (100_001, None)],
        decontamination.NAMED: [(3, 150_000), (1, 100_001), (3, None)],
        decontamination.PLAIN: [(50_002, 3), (1, 100_001), (100_002, None)],
    }
    for way, expected in counts.items():
        raw = decontamination.raw_tokens(F.col("text"), way)
        made = rows.select(F.size(decontamination.templates(raw, way)), F.array_max(F.transform(raw, F.length))).collect()
        assert [row[0] for row in made] == [number for number, _ in expected]
        assert all(longest is None or abs(row[1] - longest) <= 1 for row, (_, longest) in zip(made, expected))


def test_hashes_of_templates(spark):
    """Hashes made in fewer walks are those of the templates, whatever a token begins with."""
    rng = random.Random(7)
    tokens = [*decontamination.UNITS, *decontamination.NUMBER_WORDS, "Km", "KM", "Twenty", "Foo", "Baz BarX", "éa", "aé",
              "\U0001D400b", "ϒa", "ǅa", "3.5", "x1", "Straße", "İx", "ΑΣ", "京", "in Berlin Mitte"]
    texts = ["".join(rng.choice(tokens) + rng.choice([" ", ". ", "\n", "", ", "]) for _ in range(30)) for _ in range(500)]
    rows = spark.createDataFrame([(text,) for text in [*texts, ""]], "text string")
    for way in WAYS:
        raw = decontamination.raw_tokens(F.col("text"), way)
        before = F.transform(decontamination.templates(raw, way), lambda token: F.xxhash64(token))
        assert rows.filter(~before.eqNullSafe(decontamination.hashed_templates(raw, way))).limit(3).collect() == []


def test_windows_are_looked_up_token_by_token(spark):
    """Tokens are cut and hashed once; where windows begin is asked in compiled rows, not in functions over arrays."""
    items = spark.createDataFrame([(number, text) for number, text in ITEMS], "item_id long, text string")
    items = items.withColumn("item_key", F.xxhash64("text"))
    texts = spark.createDataFrame([row[:2] for row in TEXTS], "doc_id long, text string")
    for way in WAYS:
        index = decontamination.item_windows(decontamination.with_templates(items, way), way).localCheckpoint()
        plan = decontamination.window_matches(texts, index, [5, 8], way)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1 and "sequence(" not in plan and "posexplode(tokens" in plan
