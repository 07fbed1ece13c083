"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence) and units
turn into typed placeholders, all else into lower-case words. Windows of 8 template
tokens of the benchmark are joined by hash with those of all documents. Where windows
meet on one line (the same distance between their places), the values in the slots of
document and item are laid side by side: a question asked anew with other numbers or
names replaces each value by one other value throughout, so a value with two
replacements refutes the match.

All of it is column functions, explodes and joins. A text is cut into tokens once per reading, the
tokens are hashed, and windows are hashes of these numbers. A document leaks an item if within
`DRIFT` places of one line at least 6 windows match (all, of an item with fewer) and the slots agree:
a few words put in or left out move what follows to a near line. Windows with less than half
literal words are too common to prove anything and are left out; items shorter than a window
are one window of their own length, from 5 tokens on (of plain tokens from 3 on).

Texts are read in three ways, and a document leaks an item that it leaks in any of them
(the row is of the first way that finds the pair):

* `TYPED`   names are capitalised words behind a lower-case letter, digit, comma or semicolon;
* `NAMED`   every run of capitalised words is a name, wherever it stands and however lines
            break, so that a question with other names at sentence starts has one template;
* `PLAIN`   lower-case words and numbers as they are, without slots: verbatim copies, in any
            case and behind any words. No share of literal words is asked for, operators
            are tokens, too, and scripts without spaces are read by character.

In the first two, numbers may be written as words. Items of one or two plain tokens are too short to
tell from common words: a document leaks one (`SHORT`) that has a line of its own with just these tokens.
Items without any token match nothing.

NULL texts match nothing. Very long texts are read whole. Rows without doc_id and repeated rows are
judged by their own text; equal rows give one result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import only, without
from harrow.operators.joins import spread_join
from harrow.session import fits_broadcast, hinted, stored

WINDOW = 8
LEAST_WINDOWS = 6
LEAST_TOKENS = 5
LEAST_PLAIN = 3
# Openings of windows that the plan may hold as literals; with more, every place of a text is looked up.
MAX_OPENINGS = 50_000
# Placeholders, unit words, and the shape of tokens and names.
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
UNITS = (
    "% $ € £ ° km cm mm kg mg lb lbs oz ml kwh mph kmh usd eur gbp meter meters metre metres mile miles "
    "gram grams litre litres liter liters dollar dollars euro euros percent degrees"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
TYPED, NAMED, PLAIN, SHORT = 0, 1, 2, 3
# ASCII is asked for first: the classes of all letters, and what looks behind or ahead, are slow to ask.
# Groups are repeated possessively (`*+`): Java's matcher calls itself once for every other repetition, and a
# long list of numbers or names would overflow its stack. Nothing is given back where a group ends like this.
_OTHER = r"(?=[^\x00-\x7F])"
_WORD_OR_VALUE = (
    rf"[a-zA-Z]++(?:{_OTHER}[\p{{L}}\p{{M}}]++)?|[0-9]+(?:[.,][0-9]+)*+|[%$]|{_OTHER}(?:[\p{{L}}\p{{M}}]+|[€£°])"
)
# Capitalised words up to the first that goes on with other letters.
_CAPITALISED = r"\p{Lu}[\p{Ll}\p{M}]++(?![\p{L}\p{M}])"
_NAME = rf"{_CAPITALISED}(?:\s++{_CAPITALISED})*+"
_MAY_BE_CAPITAL = r"(?=[^\x00-@\[-\x7F])"
# A name behind a word begins with the space before it.
TYPED_TOKENS = rf" (?=\p{{Lu}})(?<=[\p{{Ll}}0-9,;] )\p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)*+|{_WORD_OR_VALUE}"
NAMED_TOKENS = rf"{_MAY_BE_CAPITAL}{_NAME}|{_WORD_OR_VALUE}"
DRIFT = 4

# Read by character: scripts that put no spaces between words.
UNSPACED = "".join(f"\\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
_SPACED = f"[\\p{{L}}\\p{{M}}&&[^{UNSPACED}]]"
PLAIN_TOKENS = (
    rf"[a-zA-Z]++(?:{_OTHER}{_SPACED}++)?|[0-9]+(?:[.,][0-9]+)*+|[-%*/^+<=>|~$]"
    rf"|{_OTHER}(?:[{UNSPACED}&&[\p{{L}}\p{{N}}]]\p{{M}}*|{_SPACED}+|\p{{Nd}}+|\p{{Sm}}|\p{{Sc}}|°)"
)


def raw_tokens(text: Column, way: int = TYPED) -> Column:
    pattern = {TYPED: TYPED_TOKENS, NAMED: NAMED_TOKENS}.get(way, PLAIN_TOKENS)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def template_token(token: Column, lower: Column, way: int) -> Column:
    """The placeholder or lower-case word of a token, which is given in lower case, too."""
    is_name = lower.startswith(" ") if way == TYPED else (lower != token) & token.rlike(f"^{_NAME}$")
    fixed = F.when(lower.isin(UNITS), F.lit(UNIT)).otherwise(F.lit(NUMBER))
    return (
        F.when(is_name, F.lit(NAME)).when(lower.isin(NUMBER_WORDS + UNITS), fixed)
        .when((lower >= "0") & (lower < ":"), F.lit(NUMBER)).otherwise(lower)
    )


def templates(raw: Column, way: int) -> Column:
    """The placeholder or lower-case word of each token; every token is put in lower case once."""
    if way == PLAIN:
        return F.transform(raw, F.lower)
    if way == TYPED:  # a name is told by the space before it, in lower case as well
        return F.transform(F.transform(raw, F.lower), lambda word: template_token(word, word, way))
    # one walk over the tokens: an expression named twice would be evaluated twice
    both = F.transform(raw, lambda token: F.struct(token.alias("token"), F.lower(token).alias("lower")))
    return F.transform(both, lambda pair: template_token(pair["token"], pair["lower"], way))


def hashed_templates(raw: Column, way: int) -> Column:
    """The hashes of `templates(raw, way)`, made in fewer walks over the tokens.

    Names and numbers are told by how a token begins. Units and number words are told by their hashes,
    which are cheaper to look up than words.
    """
    def word(token: Column) -> Column:
        return F.xxhash64(F.lower(token))

    if way == PLAIN:
        return F.transform(raw, word)
    name, number, unit = (F.xxhash64(F.lit(fixed)) for fixed in (NAME, NUMBER, UNIT))

    def first_look(token: Column) -> Column:
        is_number = (token >= "0") & (token < ":")
        if way == TYPED:
            return F.when(token.startswith(" "), name).when(is_number, number).otherwise(word(token))
        is_name = (F.lower(token) != token) & token.rlike(f"^{_NAME}$")
        return (
            F.when((token >= "a") & (token < "{"), word(token)).when(is_number, number)
            .when(is_name, name).otherwise(word(token))
        )

    units, words = ([F.xxhash64(F.lit(fixed)) for fixed in some] for some in (UNITS, UNITS + NUMBER_WORDS))

    def fixed_words(hashed: Column) -> Column:
        return F.when(hashed.isin(words), F.when(hashed.isin(units), unit).otherwise(number)).otherwise(hashed)

    return F.transform(F.transform(raw, first_look), fixed_words)


def slot_value(token: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(token, r"\s+", " ")))


def with_templates(rows: DataFrame, way: int = TYPED) -> DataFrame:
    """Adds `raw` and `template`, token by token."""
    return rows.withColumn("raw", raw_tokens(F.col("text"), way)).withColumn(
        "template", templates(F.col("raw"), way))


def window_hash(tokens: Column, at: Column, length: int) -> Column:
    """The hash of the run of `length` hashed tokens from `at` on; NULL where the text ends before."""
    run = F.xxhash64(*[F.get(tokens, at + (step - 1)) for step in range(length)])
    return F.when(F.size(tokens) >= at + (length - 1), run)


def is_literal(token: Column) -> Column:
    return ~token.isin(NUMBER, NAME, UNIT)


def item_windows(items: DataFrame, way: int = TYPED) -> DataFrame:
    """`(item_id, item_key, length, item_at, hash)` of the benchmark's provable windows."""
    sized = items.withColumn("length", F.least(F.size("template"), F.lit(WINDOW))).filter(
        F.col("length") >= (LEAST_PLAIN if way == PLAIN else LEAST_TOKENS))
    placed = sized.withColumn("item_at", F.explode(F.sequence(F.lit(1), F.size("template") - F.col("length") + 1)))
    window = placed.withColumn("_w", F.slice("template", F.col("item_at"), F.col("length")))
    if way != PLAIN:
        window = window.filter(F.size(F.filter("_w", is_literal)) * 2 >= F.col("length"))
    # like `window_hash`: the tokens of shorter windows are followed by NULL, which changes no hash
    tokens = window.withColumn("_t", F.transform("_w", lambda token: F.xxhash64(token)))
    run = F.xxhash64(*[F.get("_t", F.lit(step)) for step in range(WINDOW)])
    return tokens.select("item_id", "item_key", "length", "item_at", run.alias("hash"),
                         F.xxhash64(F.get("_t", F.lit(0)), F.get("_t", F.lit(1))).alias("opening"))


def window_matches(documents: DataFrame, index: DataFrame, lengths: list[int], way: int) -> DataFrame:
    """`(doc_id, doc_key, item_id, item_key, item_at, line)` for every equal window; each text is read once."""
    tokens = hashed_templates(raw_tokens(F.col("text"), way), way)
    parts = documents.select("doc_id", F.xxhash64("text").alias("doc_key"), tokens.alias("tokens"))
    # explode_outer: the filter that an inner explode implies would be evaluated below, tokens and all, once more.
    # A row per token costs less than a function over the array: Spark compiles it, and only the rows kept are made.
    placed = parts.select("doc_id", "doc_key", "tokens", F.posexplode_outer("tokens").alias("begin", "token"))
    openings = index.select("opening").distinct().limit(MAX_OPENINGS + 1).collect()
    if len(openings) <= MAX_OPENINGS:
        opening = F.xxhash64("token", F.get("tokens", F.col("begin") + 1))
        placed = placed.filter(opening.isin([row["opening"] for row in openings]))
    at = F.col("begin") + 1
    windows = F.array(*[
        F.struct(at.alias("at"), window_hash(F.col("tokens"), at, length).alias("hash")) for length in lengths])
    own = placed.select("doc_id", "doc_key", F.explode_outer(windows).alias("w")).select(
        "doc_id", "doc_key", "w.hash", "w.at").filter("hash IS NOT NULL")
    wanted = index.drop("length", "opening")
    if fits_broadcast(wanted):
        met = own.join(F.broadcast(wanted), "hash")
    else:
        held = own.join(wanted.select("hash").distinct(), "hash", "left_semi")
        uses = held.groupBy("hash").agg(F.count(F.lit(1)).alias("uses"))
        met = spread_join(own, wanted.join(uses, "hash"), "hash", "uses", "doc_key", fits=False)
    return met.select("doc_id", "doc_key", "item_id", "item_key", "item_at",
                      (F.col("at") - F.col("item_at")).alias("line"))


def near_lines(matches: DataFrame, pair: list[str]) -> DataFrame:
    """`places(item_at, line)` of the windows on lines that lie near one another, each window once.

    Lines are taken in overlapping bands, twice as wide as the drift that is always bridged.
    """
    band = F.floor(F.col("line") / DRIFT)
    banded = matches.withColumn("band", F.explode(F.array(band, band - 1)))
    places = banded.groupBy(*pair, "band", "item_at").agg(F.min("line").alias("line"))
    return places.groupBy(*pair, "band").agg(F.collect_list(F.struct("item_at", "line")).alias("places"))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(doc_id, doc_key, item_id, n_matched, n_windows, n_slots, n_changed)`, one row per leaking pair.

    `n_matched` of the item's `n_windows` windows match on the best line; `n_changed` of
    its `n_slots` slot values there are other ones.
    """
    asked = stored(
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
        .distinct().withColumn("item_key", F.xxhash64("text")), "items")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    found = None
    for way in (TYPED, NAMED, PLAIN):
        own = leaks_read(texts, asked, way).withColumn("way", F.lit(way))
        found = own if found is None else found.unionByName(own)
    found = found.unionByName(short_leaks(texts, asked).withColumn("way", F.lit(SHORT)))
    pair = ["doc_id", "doc_key", "item_id"]
    counts = [name for name in found.columns if name not in (*pair, "way")]
    return found.groupBy(*pair).agg(F.min_by(F.struct(*counts), "way").alias("b")).select(
        *pair, *[F.col(f"b.{name}") for name in counts])


def leaks_read(texts: DataFrame, asked: DataFrame, way: int) -> DataFrame:
    """The rows of `leaks` that one way of reading finds."""
    items = stored(with_templates(asked, way), "item-templates")
    index = stored(item_windows(items, way), "item-windows")
    sizes = index.groupBy("item_id", "item_key", "length").agg(F.count(F.lit(1)).alias("n_windows"))
    lengths = sorted(row["length"] for row in index.select("length").distinct().collect())  # WINDOW values at most
    pair = ["doc_id", "doc_key", "item_id", "item_key"]
    lines = near_lines(window_matches(texts, index, lengths or [WINDOW], way), pair)
    if fits_broadcast(sizes):
        sizes = F.broadcast(sizes)
    strong = lines.join(sizes, ["item_id", "item_key"]).withColumn("n_matched", F.size("places"))
    strong = stored(strong.filter(F.col("n_matched") >= F.least("n_windows", F.lit(LEAST_WINDOWS))), "lines")
    if way != PLAIN:
        return slots_agree(strong, texts, items, way)
    best = strong.groupBy("doc_id", "doc_key", "item_id").agg(F.max(F.struct("n_matched", "n_windows")).alias("b"))
    return best.select("doc_id", "doc_key", "item_id", "b.n_matched", "b.n_windows",
                       F.lit(0).alias("n_slots"), F.lit(0).alias("n_changed"))


def short_leaks(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `leaks` of items with fewer plain tokens than a window needs: lines that are the item."""
    def plain(text):
        return F.lower(F.array_join(raw_tokens(text, PLAIN), " "))

    items = stored(asked.select("item_id", plain(F.col("text")).alias("line"), F.size(raw_tokens(F.col("text"), PLAIN)).alias("n"))
                   .filter((F.col("n") > 0) & (F.col("n") < LEAST_PLAIN)).select("item_id", "line"), "short-items")
    if items.isEmpty():
        texts = texts.limit(0)  # no text need be read
    lines = texts.select("doc_id", F.xxhash64("text").alias("doc_key"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", "doc_key", plain(F.col("line")).alias("line")).filter("line <> ''")
    met = lines.join(hinted(items), "line").select("doc_id", "doc_key", "item_id").distinct()
    one, none = F.lit(1), F.lit(0)
    return met.select("*", one.alias("n_matched"), one.cast("long").alias("n_windows"), none.alias("n_slots"), none.alias("n_changed"))


def slots_agree(lines: DataFrame, texts: DataFrame, items: DataFrame, way: int = TYPED) -> DataFrame:
    """The lines on which no slot value of the item has two replacements, best line per pair."""
    keyed = texts.select(F.xxhash64("text").alias("doc_key"), "text")
    uses = stored(lines.groupBy("doc_key").agg(F.count(F.lit(1)).alias("uses")), "leaking-texts")
    own = only(keyed, uses, "doc_key").dropDuplicates(["doc_key"]).join(uses, "doc_key")
    rows = spread_join(
        lines, stored(own.select("doc_key", "uses", raw_tokens(F.col("text"), way).alias("doc_raw")), "leaking-tokens"),
        "doc_key", "uses", "band",
    )
    asked = items.select("item_id", "item_key", F.col("raw").alias("item_raw"), "template")
    if fits_broadcast(asked):
        asked = F.broadcast(asked)
    rows = rows.join(asked, ["item_id", "item_key"])
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(
        F.sequence(p["item_at"], p["item_at"] + F.col("length") - 1),
        lambda at: F.struct(at.alias("at"), p["line"].alias("line"))))))
    slots = F.filter(covered, lambda slot: ~is_literal(F.get("template", slot["at"] - 1)))
    rows = rows.withColumn("_slots", slots).withColumn("_pairs", F.transform("_slots", lambda slot: F.struct(
        slot_value(F.get("item_raw", slot["at"] - 1)).alias("asked"),
        slot_value(F.get("doc_raw", (slot["at"] + slot["line"] - 1).cast("int"))).alias("found"))))
    one_each = F.size(F.array_distinct("_pairs")) == F.size(F.array_distinct(F.transform("_pairs", lambda p: p["asked"])))
    changed = F.size(F.filter("_pairs", lambda p: p["asked"] != p["found"]))
    return rows.filter(one_each).groupBy("doc_id", "doc_key", "item_id").agg(
        F.max(F.struct("n_matched", (-changed).alias("kept"), "n_windows", F.size("_slots").alias("n_slots"))).alias("b")
    ).select("doc_id", "doc_key", "item_id", "b.n_matched", "b.n_windows", "b.n_slots", (-F.col("b.kept")).alias("n_changed"))


def leak_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(doc_id, item_id, n_matched, n_windows, n_slots, n_changed)` of every leaking pair."""
    return leaks(documents, benchmark).drop("doc_key").distinct()


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text leaks no benchmark item."""
    gone = stored(leaks(documents, benchmark).select(F.col("doc_key").alias("_text_key")).distinct(), "leaking")
    keyed = documents.withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    return without(keyed, gone, "_text_key").drop("_text_key")
