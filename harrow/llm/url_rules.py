"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is `host/path`: it fits its host, all subdomains, and paths that start with
its path. A pattern is literal text with `*` for anything, searched for in host and
path, without case. Both become regular expressions. Of a rule's whole literal tokens
the one that fewest URLs hold is its index key; the tokens of a URL fetch the rules
that can fit at all, and only those run their expression. Rules without a whole token
are fetched by every URL.

Everything is column functions, explodes and joins. The fitting rule with the longest
text wins, block before allow among equals; `host/path` rules come before patterns.
A URL that is NULL or lacks `://` has an empty host and path. Repeated rows stay
repeated, and rows without a page_id are judged as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators.joins import spread_join
from harrow.session import stored

# The rules of the registered query.
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
PATTERNS = [
    ("block", "/ads/"),
    ("block", "/adserver/*"),
    ("block", "/banners/"),
    ("block", "/tracking/*"),
]
OTHERWISE = "allow"
_TOKEN = "[a-z0-9]+"
# stands among the tokens of every URL, for rules without a token
_ALWAYS = ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def quoted(text: Column) -> Column:
    """Literal text inside a regular expression."""
    return F.regexp_replace(text, r"([^A-Za-z0-9/])", r"\\$1")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """`(rule, action, first, regex, tokens)`; `tokens` are those a fitting URL must hold whole."""
    listed = [(action, text, True) for action, text in rules] + [(action, text, False) for action, text in patterns]
    structs = [
        F.struct(F.lit(action).alias("action"), F.lit(text).alias("rule"), F.lit(first).alias("first"))
        for action, text, first in listed
    ]
    if not structs:
        return spark.range(0).select(
            F.lit("").alias("rule"), F.lit("").alias("action"), F.lit(True).alias("first"),
            F.lit("").alias("regex"), F.array(F.lit("")).alias("tokens"))
    rows = spark.range(1).select(F.inline(F.array(*structs)))
    host = F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER)
    path = F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1)
    of_rule = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host), quoted(path))
    literal = F.array_join(F.transform(F.split("rule", r"\*", -1), quoted), ".*")
    of_pattern = F.concat(F.lit("(?is)"), literal)
    # a token is whole where its neighbours are fixed and no token characters
    bounded = F.when(F.col("first"), F.concat(F.lit("."), F.lower("rule"), F.lit("*"))).otherwise(
        F.concat(F.lit("*"), F.lower("rule"), F.lit("*")))
    tokens = F.regexp_extract_all(bounded, F.lit(f"(?<![*a-z0-9])({_TOKEN})(?![*a-z0-9])"), F.lit(1))
    return rows.select(
        "rule", "action", "first", F.when(F.col("first"), of_rule).otherwise(of_pattern).alias("regex"),
        F.when(F.size(tokens) > 0, F.array_distinct(tokens)).otherwise(F.array(F.lit(_ALWAYS))).alias("tokens"),
    )


def url_parts(pages: DataFrame) -> DataFrame:
    """`(page_id, url, host, path)`."""
    url = F.col("url").cast("string")
    return pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))


def url_tokens(parts: DataFrame) -> DataFrame:
    """One row per URL and distinct token of its host and path."""
    found = F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(_TOKEN), F.lit(0))
    return parts.withColumn("token", F.explode(F.array_append(F.array_distinct(found), F.lit(_ALWAYS))))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rules with their `token`, the rarest among the URLs, and its `uses` there."""
    keyed = rules.select("rule", "action", "first", "regex", F.explode("tokens").alias("token"))
    counted = tokens.select("token").join(F.broadcast(keyed.select("token").distinct()), "token").groupBy(
        "token").agg(F.count(F.lit(1)).alias("uses"))  # as many rows as the rules have tokens
    return (
        keyed.join(F.broadcast(counted), "token", "left")
        .groupBy("rule", "action", "first", "regex")
        .agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token")).alias("key"))
        .select("rule", "action", "first", "regex", "key.token", "key.uses")
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    patterns: list[tuple[str, str]] = PATTERNS,
) -> DataFrame:
    """`(page_id, url, host, path, rule, verdict, pattern)` of every row of `pages(page_id, url)`."""
    spark = pages.sparkSession
    parts = url_parts(pages)
    tokens = url_tokens(parts)
    index = stored(rule_index(rule_table(spark, rules, patterns), tokens), "rules")
    fetched = spread_join(tokens, index, "token", "uses", "url")
    fitting = fetched.filter(F.expr("concat(host, path) RLIKE regex")).select(
        "page_id", "url", F.lit(0).alias("copies"),
        F.struct("first", F.length("rule").alias("size"), (F.col("action") == "block").alias("block"), "rule", "action").alias("fit"),
    )
    rows = parts.select("page_id", "url", F.lit(1).alias("copies"), F.lit(None).cast(fitting.schema["fit"].dataType).alias("fit"))
    best = rows.unionByName(fitting).groupBy("page_id", "url").agg(
        F.sum("copies").alias("copies"), F.max("fit").alias("fit"))
    return best.select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("fit.first"), F.col("fit.rule")).alias("rule"),
        F.coalesce(F.col("fit.action"), F.lit(OTHERWISE)).alias("verdict"),
        F.when(~F.col("fit.first"), F.col("fit.rule")).alias("pattern"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
