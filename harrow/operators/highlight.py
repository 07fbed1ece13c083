"""Query-aware previews for result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.operators.joins import attach

# Fixed values.
WINDOW = 150
STEP = 75
_OPEN, _CLOSE = "\ue000", "\ue001"


def word_matches(text: Column, words: Column) -> Column:
    """`array<struct<at,size>>` of the alphanumeric runs of a text that are one of the words.

    The whole text is matched once, so a run is never cut; `at` counts from 1.
    """
    pattern = F.concat(
        F.lit("(?i)(?<![A-Za-z0-9])(?:"), F.array_join(words, "|"), F.lit(")(?![A-Za-z0-9])")
    )
    plain = F.translate(text, _OPEN + _CLOSE, "  ")
    pieces = F.split(F.regexp_replace(plain, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)
    start = F.struct(
        (F.length(pieces[0]) + 1).alias("next"),
        F.array().cast("array<struct<at:int,size:int>>").alias("found"),
    )

    def step(seen: Column, piece: Column) -> Column:
        size = F.instr(piece, _CLOSE) - 1
        return F.struct(
            (seen["next"] + F.length(piece) - 1).alias("next"),
            F.array_append(seen["found"], F.struct(seen["next"].alias("at"), size.alias("size"))).alias("found"),
        )

    found = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda seen: seen["found"])
    return F.when(F.size(words) > 0, found).otherwise(start["found"])


def highlighted(
    results: DataFrame, queries: DataFrame, documents: DataFrame, fits: bool = False
) -> DataFrame:
    """`(qid, rank, id, preview)`: the 150 characters with most matches, terms in <b>.

    Works on the k result rows of each query only; windows overlap by half and the
    earliest of equally dense ones is taken. Only words that lie in a window as a whole
    count for it and are marked. `fits`: results are known to fit a broadcast.
    """
    words = F.array_distinct(tx.query_tokens(F.col("q")))
    asked = results.select("qid", "rank", "id").join(queries.select("qid", words.alias("words")), "qid")
    texts = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = attach(asked, texts, "id", "qid", fits).withColumn(
        "text", tx.collapse_space(F.col("text"))
    )
    rows = rows.withColumn("found", word_matches(F.col("text"), F.col("words")))

    def inside(at: Column) -> Column:
        return F.filter("found", lambda m: (m["at"] >= at) & (m["at"] + m["size"] <= at + WINDOW))

    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(STEP))
    windows = F.transform(starts, lambda at: F.struct(F.size(inside(at)).alias("matches"), (-at).alias("before")))
    best = rows.withColumn("begin", -F.array_max(windows)["before"])
    marked = F.aggregate(
        inside(F.col("begin")),
        F.struct(F.col("begin").alias("next"), F.lit("").alias("out")),
        lambda seen, m: F.struct(
            (m["at"] + m["size"]).alias("next"),
            F.concat(
                seen["out"], F.substring(F.col("text"), seen["next"], m["at"] - seen["next"]), F.lit("<b>"),
                F.substring(F.col("text"), m["at"], m["size"]), F.lit("</b>"),
            ).alias("out"),
        ),
        lambda seen: F.concat(seen["out"], F.substring(F.col("text"), seen["next"], F.col("begin") + WINDOW - seen["next"])),
    )
    return best.select("qid", "rank", "id", marked.alias("preview"))
