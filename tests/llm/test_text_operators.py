"""Resampling, token counts, URL rules and line dedup."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import importance, line_dedup, token_counts, url_rules
from harrow.llm.queries import PIECE_BPE, tokenizer_file
from harrow.sources.tables import read_table

# --- importance resampling ---------------------------------------------------


def test_resampling_against_brute_force(spark, folder):
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    rows = {r["doc_id"]: r for r in importance.resample_by_labels(documents, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for doc_id, text in texts.items():
        for bucket in importance.features(text.encode()):
            raw[bucket] += 1
            target[bucket] += doc_id in good
    size = importance.BUCKETS
    ratio = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    keys = {}
    for doc_id, text in texts.items():
        weight = sum(ratio[bucket] for bucket in importance.features(text.encode()))
        assert rows[doc_id]["log_weight"] == pytest.approx(weight, abs=1e-6)
        keys[doc_id] = weight + importance.gumbel([doc_id])[0]
    k = round(len(texts) * len(good) / labels.count())
    assert {d for d, r in rows.items() if r["selected"]} == set(sorted(keys, key=keys.get)[-k:])


def test_good_texts_weigh_more(spark):
    documents, labels = (read_table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    seen = labels.filter("doc_id % 2 = 0")
    joined = importance.resample_by_labels(documents, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r["log_weight"] / max(1, r["n_features"]) for r in joined if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95  # labels that the models have not seen


def test_gumbel_keys_sample_by_weight():
    keys = importance.gumbel(list(range(40_000)))
    firsts = np.argmax(keys.reshape(-1, 2) + np.log([3.0, 1.0]), axis=1)
    assert abs((firsts == 0).mean() - 0.75) < 0.02


def test_nth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(-2**63, 2**63), 7, -7, 0]) for _ in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for n in (1, 2, 150, 299, 300):
        value, within = importance.nth_largest(frame, F.col("v"), n)
        assert value == ordered[n - 1] and within == n - sum(v > value for v in values)
    doubles = np.array([-np.inf, -1.5, -0.0, 0.0, 1e-300, 2.0, np.inf])
    assert list(np.argsort(importance.ordered_bits(doubles), kind="stable")) == list(range(7))


def test_resampling_of_odd_rows(odd_documents, no_documents, spark):
    ids = spark.createDataFrame([(1,), (20,), (None,)], "doc_id long")
    result = importance.resample(odd_documents, ids, 5)
    rows = result.collect()
    assert len(rows) == odd_documents.count()
    assert all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    keys = sorted((r["sample_key"] for r in rows), reverse=True)
    assert all(r["selected"] == (r["sample_key"] >= keys[4]) for r in rows)
    assert importance.resample(no_documents, ids, 3).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert not any(r["selected"] for r in importance.resample_by_labels(odd_documents, empty).collect())


# --- token counts ------------------------------------------------------------


def greedy(vocabulary, word, longest=None):
    """Pieces cut one after the other, the longest first."""
    text, at, count = token_counts.MARK + word, 0, 0
    longest = longest or max(map(len, vocabulary), default=1)
    while at < len(text):
        for size in range(min(longest, len(text) - at), 0, -1):
            if text[at:at + size] in vocabulary:
                count, at = count + 1, at + size
                break
        else:
            count, at = count + len(text[at].encode()), at + 1
    return count


def test_automaton_against_greedy_cuts():
    rng = random.Random(2)
    for _ in range(200):
        vocabulary = {"".join(rng.choices("abc▁", k=rng.randrange(1, 6))) for _ in range(rng.randrange(0, 25))}
        automaton = token_counts.LongestMatch(sorted(vocabulary))
        for _ in range(30):
            word = "".join(rng.choices("abcdé", k=rng.randrange(0, 14)))
            assert automaton.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_counts_of_a_table(spark, folder, odd_documents, odd_rows, no_documents):
    path = tokenizer_file(PIECE_BPE)
    vocabulary = set(token_counts.vocabulary(path))
    documents = read_table(spark, folder, "documents")
    for frame in (documents, odd_documents):
        rows = frame.select("doc_id", "text").collect()
        expected = []
        for row in rows:
            words = [w.decode() for w in (row["text"] or "").encode().split()]
            cut = {w: greedy(vocabulary, w, 20) for w in set(words)}
            expected.append((row["doc_id"], len(words), sum(cut[w] for w in words)))
        got = [tuple(r) for r in token_counts.token_counts(frame, path).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(no_documents, path).count() == 0


# --- URL rules ---------------------------------------------------------------


def judge(url, rules, otherwise="allow"):
    if url is None or "://" not in url:
        return "", "", None, otherwise
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host):]
    for mark in "?#":
        path = path.split(mark, 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for action, rule in rules:
        rule_host, rest = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[1]):
                best = (action, rule)
    return host, path, best and best[1], best[0] if best else otherwise


URLS = [
    None, "", "example.net/en/", "http://example.net", "http://EXAMPLE.net/en/1?x#y", "https://a.b.example.net/EN/", "x://net/",
    "http://notnet/", "http://a.net/p", "http://example.com/de", "http://example.com/de/", "http://example.com/de?q=/fr/",
    "http://x.org/fr/", "http://x.org:80/fr/", "http://u@x.org/fr/?a://b.net/", "a b://é.org/fr/ü\n\t/", "http://x.org#/fr/",
    "://net/a", "http://example.net/en", "http://a.example.net./en/", "http://" + "very-long." * 5000 + "org/fr/" + "p/" * 5000,
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_rules(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    rows = [(n, url) for n, url in enumerate(URLS)] + [(None, URLS[4]), (None, URLS[4]), (3, URLS[8])] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns(
        {name: F.lit("x") for name in ("token", "rule", "host", "uses", "fit", "copies", "html")})
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages).collect()]
    expected = [(n, *judge(url, url_rules.RULES)) for n, url in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_patterns_and_rarest_tokens(spark):
    urls = ["http://a.com/ads/1", "http://a.com/loads/1", "http://tracker.x.com/", "http://a.com/x1y", "http://q.com/AB/c", "http://q.com/zz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    patterns = [("block", "/ads/"), ("block", "tracker.*"), ("block", "x*y"), ("block", "/ab/*c"), ("allow", "/zz")]
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in url_rules.judge_urls(pages, [("block", "q.com/z")], patterns).collect()}
    assert got == {0: ("block", "/ads/"), 1: ("allow", None), 2: ("block", "tracker.*"), 3: ("block", "x*y"),
                   4: ("block", "/ab/*c"), 5: ("block", None)}
    table = url_rules.rule_table(spark, [("block", "example.net/en/")], [("block", "x*y"), ("block", "/a.b.c/*")])
    tokens = url_rules.url_tokens(url_rules.url_parts(pages))
    keys = {r["rule"]: r["token"] for r in url_rules.rule_index(table, tokens).collect()}
    assert keys["x*y"] == "" and keys["example.net/en/"] in ("example", "net", "en")
    assert url_rules.judge_urls(pages, [], []).filter("verdict = 'allow'").count() == len(urls)


def test_url_plan_is_native(spark, folder):
    plan = url_rules.judge_urls(read_table(spark, folder, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert "html" not in plan


# --- line dedup --------------------------------------------------------------


def dedup(rows, least=5, chars=40):
    """Per row: lines, dropped lines, hash of what stays."""
    def key(line):
        text = line.encode().strip(b" \t\n\v\f\r").lower()
        return text if len(text.decode()) >= chars else None

    holders = {}
    for at, (_, text) in enumerate(rows):
        for line in set(map(key, (text or "").split("\n"))) - {None}:
            holders.setdefault(line, []).append(at)
    result = []
    for at, (doc_id, text) in enumerate(rows):
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(key(line), []) if key(line) else []
            ids = [rows[i][0] for i in held if rows[i][0] is not None]
            last = max(ids) if ids else None
            if len(held) < least or doc_id == last:
                kept.append(line)
        result.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(result, key=str)


def report(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines(spark, odd_documents, odd_rows, no_documents, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    assert report(line_dedup.line_report(odd_documents)) == dedup(odd_rows)
    cleaned = line_dedup.without_common_lines(odd_documents)
    assert cleaned.columns == odd_documents.columns
    hashes = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in cleaned.collect())
    assert hashes == sorted(row[3] for row in dedup(odd_rows))
    assert line_dedup.line_report(no_documents).count() == 0


def test_additions_and_deletions_are_reversible(spark, odd_rows):
    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    rows = [row for row in odd_rows if row[0] is not None]
    first, second = rows[:-4], rows[-4:]
    index = line_dedup.line_index(frame(first))
    both = line_dedup.add_documents(index, frame(second))
    assert report(line_dedup.line_report(frame(rows), both)) == dedup(rows)
    back = line_dedup.delete_documents(both, frame(second))
    assert report(line_dedup.line_report(frame(first), back)) == dedup(first)
    for one, other in ((index, back),):
        assert one.common_keys().exceptAll(other.common_keys()).isEmpty()
        loaded = [line_dedup._load_filters(i.filters) for i in (one, other)]
        keys = line_dedup.key_words([r["key"] for r in both.common_keys().collect()])
        hits = [sum(f.contains(keys).sum() for f in filters.values()) for filters in loaded]
        assert hits[0] == hits[1]
    fewer = line_dedup.delete_documents(both, frame(rows[-1:]))
    left = rows[:-1]
    assert report(line_dedup.line_report(frame(left), fewer)) == dedup(left)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (5000, 2), dtype=np.uint64)
    keys[:, 1] *= np.uint64(3)
    made = line_dedup.filled(keys)
    assert made.contains(keys).all()
    other = rng.integers(0, 2**63, (20_000, 2), dtype=np.uint64) * np.uint64(5)
    assert made.contains(other).mean() < 0.01
    made.remove(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01
    again = line_dedup.CuckooFilter.from_bytes(made.to_bytes())
    assert again.add(keys[:2500]) and again.contains(keys).all()
    tiny = line_dedup.CuckooFilter(2)
    assert not tiny.add(keys[:50])


def test_weights_are_finite():
    assert all(math.isfinite(x) for x in importance.gumbel([None, 0, -1, 2**62]))


def test_clean_rows_with_clashing_names(spark):
    line = "this very line stands in many documents of the table"
    rows = [(n, f"own {n}\n{line}") for n in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {name: F.lit(f"x-{name}") for name in ("_id", "_keys", "_row", "_i", "_t", "keys", "key")})
    found = line_dedup.without_common_lines(frame)
    assert found.columns == frame.columns
    got = {row["doc_id"]: (row["text"], row["_id"], row["_keys"], row["_row"]) for row in found.collect()}
    assert got == {n: (text if n == 5 else f"own {n}", "x-_id", "x-_keys", "x-_row") for n, text in rows}
