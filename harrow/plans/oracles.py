"""The registered queries in DuckDB SQL over the same tables."""

from __future__ import annotations

from harrow.functions import text as tx
from harrow.functions.scoring import B, DEFAULT_AVGDL, DEFAULT_K, K1
from harrow.functions.urls import SEED_URL
from harrow.plans.catalogue import FIXED_DATE, LOOKUP_TERMS, QUERY, STOP_WORDS

SPACE = (
    r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def index_tokens(column: str) -> str:
    return (
        f"list_transform(regexp_extract_all({column}, '{tx.INDEX_TOKEN}'), lambda w: lower(w))"
    )


def query_tokens(column: str) -> str:
    return (
        "list_filter(string_split(regexp_replace(regexp_replace("
        f"lower({column}), '{SPACE}', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: length(w) >= 3)"
    )


def collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def decode(column: str) -> str:
    """The entities found in the pages, `&amp` last so that nothing is decoded twice.

    The HTML standard decodes these four without their semicolon as well.
    """
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        column = f"regexp_replace({column}, '&{name};?', '{character}', 'g')"
    return column


_BLOCKS = r"(?is)<(script|style)[^>]*>.*?</(script|style)\s*>"
PAGE_TEXT = decode(
    f"regexp_replace(regexp_replace(regexp_replace(html, '{_BLOCKS}', ' ', 'g'), "
    "'(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
)
PAGE_TITLE = decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")

DOCUMENTS = """
docs AS (
  SELECT doc_id, 'https://' || source || '.example.org/' || doc_id AS url, '' AS title, text
  FROM documents
)"""
PAGES = f"""
docs AS (
  SELECT page_id AS doc_id, url, {PAGE_TITLE} AS title, {PAGE_TEXT} AS text
  FROM pages
)"""
HALF_FETCHED = f"""
changed AS (
  SELECT page_id, url, CASE page_id % 7 WHEN 3 THEN NULL WHEN 5 THEN replace(html, '</p>', ' ') ELSE html END AS html
  FROM pages
),
docs AS (SELECT page_id AS doc_id, url, {PAGE_TITLE} AS title, {PAGE_TEXT} AS text FROM changed)"""
LATEST = f"""
downloads AS (
  SELECT page_id AS doc_id, url, html, 0 AS batch FROM pages
  UNION ALL SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '' ELSE '<p>anew thing</p>' || html END, 1
  FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, url, '<p>second of two</p>' || html, 2 FROM pages WHERE page_id % 5 = 0
),
texts AS (SELECT doc_id, url, batch, {PAGE_TITLE} AS title, {PAGE_TEXT} AS text FROM downloads),
docs AS (SELECT doc_id, url, title, text FROM texts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) = 1)"""
INDEX = f"""
toks AS (SELECT doc_id, {index_tokens('text')} AS t FROM docs),
lengths AS (SELECT doc_id, CAST(coalesce(len(t), 0) AS INTEGER) AS doc_length FROM toks),
words AS (SELECT doc_id, unnest(t) AS term FROM toks),
postings AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM words GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (
  SELECT greatest(count(*), 1) AS n_docs,
         CASE WHEN coalesce(avg(doc_length), 0) = 0 THEN {DEFAULT_AVGDL} ELSE avg(doc_length) END AS avgdl
  FROM lengths
),
metadata AS (SELECT doc_id, url, title, substring({collapse('text')}, 1, 200) AS snippet FROM docs)"""
# postings of every download; the count is that of the last one that has the term
RECRAWLED = f"{LATEST}, {INDEX}".replace(
    "words AS (SELECT doc_id, unnest(t) AS term FROM toks)",
    f"words AS (SELECT doc_id, batch, unnest({index_tokens('text')}) AS term FROM texts), "
    "counted AS (SELECT term, doc_id, batch, CAST(count(*) AS INTEGER) AS n FROM words GROUP BY ALL)",
).replace(
    "SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM words GROUP BY ALL",
    "SELECT term, doc_id, arg_max(n, batch) AS tf FROM counted GROUP BY term, doc_id",
)
BENCHMARK = "asked AS (SELECT item_id AS qid, text AS q FROM benchmark)"
CONVERSATIONS = "asked AS (SELECT conv_id * 1000 + turn AS qid, text AS q FROM conversations)"
QUERY_TERMS = f"""
q_list AS (SELECT qid, {query_tokens('q')} AS t FROM asked),
q_terms AS (
  SELECT qid, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term FROM q_list
)"""


def scoring(tf: str = "1") -> str:
    return f"""
hits AS (SELECT qid, pos, term, doc_id, tf FROM q_terms JOIN postings USING (term)),
weighed AS (
  SELECT qid, pos, h.term, h.doc_id,
    (ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * {tf} * {K1 + 1.0}) /
    ({tf} + {K1} * ({1.0 - B} + {B} * (
      CASE WHEN coalesce(doc_length, 0) = 0 THEN avgdl ELSE doc_length END / avgdl))) AS c
  FROM hits h JOIN terms USING (term) LEFT JOIN lengths USING (doc_id), totals
),
scored AS (
  SELECT qid, doc_id, list_reduce(list(c ORDER BY pos), lambda a, b: a + b) AS score,
         min(pos) AS first_pos
  FROM weighed GROUP BY qid, doc_id
),
ranked AS (
  SELECT qid, doc_id, score, CAST(row_number() OVER (
    PARTITION BY qid ORDER BY score DESC, first_pos, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= {DEFAULT_K}
)"""


RESULTS = f"""
SELECT qid, rank, doc_id AS id, url, coalesce(nullif(title, ''), url) AS title,
       coalesce(nullif(snippet, ''), '{tx.NO_PREVIEW}') AS snippet, round(score, 6) AS score
FROM ranked JOIN metadata USING (doc_id)"""


def results(docs: str, asked: str, tf: str = "1") -> str:
    return f"WITH {docs}, {INDEX}, {asked}, {QUERY_TERMS}, {scoring(tf)} {RESULTS}"


def one_result(docs: str) -> str:
    rows = results(docs, f"asked AS (SELECT 0 AS qid, '{QUERY}' AS q)")
    return f"SELECT * EXCLUDE (qid) FROM ({rows})"


DOCS_INDEX = f"WITH {DOCUMENTS}, {INDEX}"
PAGES_INDEX = f"WITH {PAGES}, {INDEX}"
BENCHMARK_HITS = f"{DOCS_INDEX}, {BENCHMARK}, {QUERY_TERMS}, {scoring()}"

FRONTIER = """
frontier AS (
  SELECT page_id AS seq, url FROM pages
  UNION ALL SELECT doc_id + 1000000000, 'https://' || source || '.example.org/' || lang FROM documents
  UNION ALL SELECT conv_id * 1000 + turn + 2000000000, nullif(role, 'system') FROM conversations
  UNION ALL SELECT page_id + 3000000000, upper(url) FROM pages
  UNION ALL SELECT page_id + 4000000000, url FROM pages
)"""
VALID = (
    "strlen(url) >= 10 AND (starts_with(url, 'http://') OR starts_with(url, 'https://'))"
)
ACCEPTED = f"""
SELECT min(seq) AS seq, url FROM frontier
WHERE {VALID} AND url NOT IN (SELECT url FROM pages WHERE contains(url, '/fr/'))
GROUP BY url"""

BODY_MD5 = "md5(html || chr(13) || chr(10) || chr(13) || chr(10))"
WITH_STATE = f"""
WITH pages_read AS (
  SELECT page_id AS doc_id, url, html, NOT contains(url, '/fr/') AS fetched, strlen(html) >= 3000 AS long,
         {PAGE_TITLE} AS title, {PAGE_TEXT} AS text FROM pages
),
metadata AS (
  SELECT doc_id, CAST(len({index_tokens('text')}) AS INTEGER) AS doc_length, title,
         substring({collapse('text')}, 1, 200) AS snippet FROM pages_read
),
state AS (
  SELECT doc_id, url,
         CASE WHEN NOT fetched THEN 'processing' WHEN long THEN 'crawled' ELSE 'crawled_not_queued' END AS status,
         m.doc_length, m.title, m.snippet, CASE WHEN fetched THEN {BODY_MD5} END AS body_md5
  FROM pages_read p LEFT JOIN (SELECT doc_id, fetched AND long AS indexed FROM pages_read) USING (doc_id)
  LEFT JOIN metadata m ON m.doc_id = p.doc_id AND indexed
)"""

HIGHLIGHT = f"""
WITH {PAGES}, {INDEX}, {BENCHMARK}, {QUERY_TERMS}, {scoring()}, found AS ({RESULTS}),
shown AS (
  SELECT f.qid, f.rank, f.id, coalesce({collapse('text')}, '') AS text, t AS words
  FROM found f JOIN docs ON doc_id = f.id JOIN q_list USING (qid)
),
pieces AS (
  SELECT qid, rank, words, unnest(parts) AS piece, generate_subscripts(parts, 1) AS n
  FROM (SELECT *, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS parts FROM shown)
),
placed AS (
  SELECT qid, rank, n, piece, length(piece) AS size, list_contains(words, lower(piece)) AS hit,
         1 + coalesce(sum(length(piece)) OVER (
           PARTITION BY qid, rank ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM pieces
),
starts AS (SELECT qid, rank, unnest(generate_series(1, greatest(length(text), 1), 75)) AS start FROM shown),
counted AS (
  SELECT s.qid, s.rank, start, count(n) AS hits FROM starts s LEFT JOIN placed p
    ON p.qid = s.qid AND p.rank = s.rank AND hit AND place >= start AND place + size <= start + 150
  GROUP BY ALL
),
best AS (
  SELECT qid, rank, start FROM counted QUALIFY row_number() OVER (PARTITION BY qid, rank ORDER BY hits DESC, start) = 1
)
SELECT qid, rank, id, coalesce(string_agg(
  CASE WHEN hit AND place >= start AND place + size <= start + 150 THEN '<b>' || piece || '</b>'
       ELSE substring(piece, CAST(greatest(1, start - place + 1) AS BIGINT),
                      CAST(least(size, start + 149 - place + 1) - greatest(1, start - place + 1) + 1 AS BIGINT)) END,
  '' ORDER BY n), '') AS preview
FROM shown JOIN best USING (qid, rank) LEFT JOIN placed USING (qid, rank)
WHERE n IS NULL OR (place < start + 150 AND place + size > start)
GROUP BY qid, rank, id"""


def folded(text: str) -> str:
    """Accents by the database's own Unicode tables; case follows with the tokens."""
    return f"replace(replace(strip_accents({text}), 'ß', 'ss'), 'ẞ', 'ss')"


_FAILS = "CASE WHEN page_id % 13 = 0 THEN 3 WHEN page_id % 11 = 0 THEN 2 WHEN page_id % 7 = 0 THEN 1 ELSE 0 END"


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


PAIRS = "count(*) AS pairs, CAST(sum(doc_id) AS BIGINT) AS id_sum"
BY_ID_TEXT = f"""{DOCS_INDEX}, listed AS (
  SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos,
         count(*) OVER (PARTITION BY term) AS df FROM postings
), parted AS (SELECT *, CAST(pos // 50 AS INTEGER) AS part FROM listed)"""

ORACLES = {
    "scan_documents": "SELECT doc_id, lang, source, n_chars, strlen(text) AS bytes FROM documents",
    "warc_point_read": f"SELECT page_id AS doc_id, url, {BODY_MD5} AS body_md5 FROM pages",
    "warc_payload": f"SELECT page_id AS doc_id, url, {BODY_MD5} AS body_md5 FROM pages",
    "warc_write_manifest": (
        "SELECT page_id AS doc_id, url, TRUE AS follows_previous, TRUE AS has_bytes FROM pages"
    ),
    "warc_scan": (
        "SELECT url, 'response' AS record_type, strlen(html) AS content_length, "
        "strlen(html) + 4 AS body_bytes FROM pages"
    ),
    "build_postings": f"{DOCS_INDEX} SELECT term, doc_id, tf FROM postings",
    "posting_lookup": f"{DOCS_INDEX} SELECT term, doc_id FROM postings WHERE term IN ({_listed(LOOKUP_TERMS)})",
    "index_metadata": (
        f"{PAGES_INDEX} SELECT doc_id, doc_length, title, snippet FROM metadata JOIN lengths USING (doc_id)"
    ),
    "seed_frontier": (
        f"WITH {FRONTIER} SELECT 'full' AS queue, seq, url FROM frontier "
        f"UNION ALL SELECT 'empty', 0, '{SEED_URL}'"
    ),
    "search_json": (
        f"WITH {PAGES}, {INDEX}, {BENCHMARK}, {QUERY_TERMS}, {scoring()}, found AS ({RESULTS}) "
        "SELECT qid, lower(q) AS query, CAST(count(id) OVER (PARTITION BY qid) AS INTEGER) AS result_count, "
        "rank, id, url, title, snippet, score FROM asked LEFT JOIN found USING (qid)"
    ),
    "valid_urls": f"WITH {FRONTIER} SELECT seq, url FROM frontier WHERE {VALID}",
    "file_basename": (
        "SELECT page_id AS doc_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS name, "
        "regexp_extract(url, '([^/]*)$', 1) AS name_backslash, replace(url, '/', '') AS name_plain FROM pages"
    ),
    "parse_doc_ids": """
WITH items AS (
  SELECT doc_id || ' ' || source AS item FROM documents
  UNION ALL SELECT source FROM documents
  UNION ALL SELECT '  -' || doc_id FROM documents
  UNION ALL SELECT '9999999999' || doc_id FROM documents
)
SELECT item, TRY_CAST(regexp_extract(item, '^\\s*([+-]?[0-9]+)', 1) AS INTEGER) AS doc_id
FROM items WHERE TRY_CAST(regexp_extract(item, '^\\s*([+-]?[0-9]+)', 1) AS INTEGER) IS NOT NULL""",
    "clean_queue": f"WITH {FRONTIER} SELECT seq, url FROM frontier WHERE url IS NOT NULL",
    "queue_replies": "SELECT conv_id * 1000 + turn AS qid, text AS item FROM conversations WHERE role = 'user'",
    "nonempty_pages": (
        "SELECT page_id AS doc_id, url FROM pages WHERE html <> '' AND NOT contains(url, '/fr/')"
    ),
    "docs_by_ids": (
        "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
    ),
    "nonblank_queries": (
        f"WITH {CONVERSATIONS}, both_kinds AS (SELECT qid, q FROM asked UNION ALL "
        "SELECT qid, regexp_replace(q, '[^ \\n]', '', 'g') FROM asked) "
        f"SELECT qid, q FROM both_kinds WHERE regexp_replace(q, '{SPACE}', '', 'g') <> ''"
    ),
    "docs_by_status": f"{WITH_STATE} SELECT doc_id, url, status FROM state WHERE status = 'crawled'",
    "first_documents": f"{WITH_STATE} SELECT doc_id, url, title, status FROM state ORDER BY doc_id LIMIT 10",
    "candidates": f"""{BENCHMARK_HITS} SELECT qid, {PAIRS}, CAST(sum((pos + 1) * doc_id) AS BIGINT) AS pos_sum,
CAST(sum(length(term)) AS BIGINT) AS letters FROM hits GROUP BY qid""",
    "candidate_lengths": f"""{BENCHMARK_HITS} SELECT qid, {PAIRS}, CAST(sum(doc_length) AS BIGINT) AS length_sum,
round(sum(CAST(CASE WHEN coalesce(doc_length, 0) = 0 THEN avgdl ELSE doc_length END AS DOUBLE)), 3) AS effective_sum
FROM (SELECT DISTINCT qid, doc_id FROM hits) LEFT JOIN lengths USING (doc_id), totals GROUP BY qid""",
    "topk_metadata": (
        f"{BENCHMARK_HITS}, page_docs AS (SELECT page_id AS doc_id, url, {PAGE_TITLE} AS title, "
        f"substring({collapse(PAGE_TEXT)}, 1, 200) AS snippet FROM pages) "
        + RESULTS.replace("JOIN metadata", "JOIN page_docs")
    ),
    "accept_urls": f"WITH {FRONTIER} {ACCEPTED}",
    "new_postings": (
        f"{DOCS_INDEX} SELECT term, doc_id FROM postings WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    ),
    "corpus_stats": f"{DOCS_INDEX} SELECT n_docs, round(avgdl, 6) AS avgdl FROM totals",
    "doc_lengths": f"{DOCS_INDEX} SELECT doc_id, doc_length FROM lengths",
    "doc_terms": f"{DOCS_INDEX} SELECT term, doc_id FROM postings",
    "posting_strings": (
        f"{DOCS_INDEX} SELECT term, 0 AS part, CAST(0 AS BIGINT) AS first_pos, "
        "string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS doc_ids FROM postings GROUP BY term"
    ),
    "posting_string_parts": f"""{BY_ID_TEXT} SELECT term, part, CAST(part AS BIGINT) * 50 AS first_pos,
string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos) AS doc_ids FROM parted GROUP BY term, part""",
    "term_df": f"{DOCS_INDEX} SELECT term, df FROM terms",
    "bm25_contrib": (
        f"{BENCHMARK_HITS} SELECT qid, {PAIRS}, round(sum(c * (pos + 1)), 5) AS contribution_sum FROM weighed GROUP BY qid"
    ),
    "bm25_scores": f"""{BENCHMARK_HITS} SELECT qid, {PAIRS}, round(sum(score), 5) AS score_sum, round(max(score), 6) AS best,
CAST(sum(first_pos * doc_id) AS BIGINT) AS first_sum FROM scored GROUP BY qid""",
    "candidate_set": f"{BENCHMARK_HITS} SELECT qid, {PAIRS} FROM (SELECT DISTINCT qid, doc_id FROM hits) GROUP BY qid",
    "result_counts": (
        f"WITH {PAGES}, {INDEX}, {BENCHMARK}, {QUERY_TERMS}, {scoring()} SELECT qid, count(doc_id) AS result_count "
        "FROM asked LEFT JOIN (SELECT qid, doc_id FROM ranked JOIN metadata USING (doc_id)) USING (qid) GROUP BY qid"
    ),
    "document_state": f"{WITH_STATE} SELECT * FROM state",
    "state_from_segments": f"{WITH_STATE} SELECT * FROM state",
    "state_of_version": (
        f"{WITH_STATE} SELECT doc_id, url, 'processing' AS status, doc_length, title, snippet, TRUE AS no_file FROM state"
    ),
    "state_of_ids": (
        f"{WITH_STATE} SELECT doc_id, url, status, doc_length, title FROM state "
        "WHERE doc_id IN (SELECT doc_id FROM documents)"
    ),
    "search_topk": one_result(PAGES),
    "search_failed_downloads": results(HALF_FETCHED, BENCHMARK),
    "search_deep": one_result(DOCUMENTS).replace(f"rank <= {DEFAULT_K}", "TRUE"),
    "search_documents": one_result(DOCUMENTS),
    "search_batch": results(DOCUMENTS, CONVERSATIONS),
    "search_batch_exhaustive": results(PAGES, BENCHMARK),
    "search_batch_bounded": results(PAGES, BENCHMARK),
    "search_topk_tf": results(PAGES, BENCHMARK, tf="tf"),
    "merge_postings": f"""WITH before AS (
  SELECT doc_id, unnest({index_tokens("lang || 'lang ' || translate(text, 'aet', 'eta')")}) AS term FROM documents
), now AS (SELECT doc_id, unnest({index_tokens('text')}) AS term FROM documents)
SELECT term, doc_id FROM before UNION SELECT term, doc_id FROM now""",
    "tokenize_documents": (
        f"{DOCS_INDEX} SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token FROM toks"
    ),
    "tokenize_queries": f"WITH {CONVERSATIONS}, {QUERY_TERMS} SELECT qid, pos, term FROM q_terms",
    "page_text": f"WITH {PAGES} SELECT doc_id, array_to_string({index_tokens('text')}, ' ') AS tokens FROM docs",
    "page_titles": f"WITH {PAGES} SELECT doc_id, title FROM docs",
    "snippets": f"SELECT doc_id, substring({collapse('text')}, 1, 200) AS snippet FROM documents",
    "term_idf": (
        f"{DOCS_INDEX} SELECT term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM terms, totals"
    ),
    "parse_postings": f"{BY_ID_TEXT} SELECT term, 0 AS part, pos, doc_id FROM parted",
    "parse_posting_parts": f"{BY_ID_TEXT} SELECT term, part, pos, doc_id FROM parted",
    "warc_dates": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS warc_date FROM events",
    "warc_headers": (
        "SELECT page_id AS doc_id, array_to_string(['WARC/1.0', 'WARC-Type: response', 'WARC-Target-URI: ' || url, "
        f"'WARC-Date: {FIXED_DATE}', 'WARC-Record-ID: <urn:uuid:' || page_id || '>', "
        "'Content-Type: application/http; msgtype=response', 'Content-Length: ' || strlen(html), '', ''], "
        "chr(13) || chr(10)) AS header FROM pages"
    ),
    "stream_accept_urls": (
        f"WITH {FRONTIER} SELECT seq AS doc_id, url, 'processing' AS status FROM ({ACCEPTED}) "
        "UNION ALL SELECT page_id, url, 'crawled' FROM pages WHERE contains(url, '/fr/')"
    ),
    "stream_index": f"{PAGES_INDEX} SELECT term, doc_id FROM postings",
    "stream_documents": (
        f"{PAGES_INDEX} SELECT doc_id, url, doc_length, title, snippet FROM metadata JOIN lengths USING (doc_id)"
    ),
    "search_streamed": results(PAGES, BENCHMARK),
    "recrawled_postings": f"WITH {RECRAWLED} SELECT term, doc_id, tf FROM postings",
    "recrawled_documents": (
        f"WITH {RECRAWLED} SELECT doc_id, url, doc_length, title, snippet FROM metadata JOIN lengths USING (doc_id)"
    ),
    "search_recrawled": f"WITH {RECRAWLED}, {BENCHMARK}, {QUERY_TERMS}, {scoring('tf')} {RESULTS}",
    "grown_postings": f"WITH {RECRAWLED} SELECT term, doc_id, tf FROM postings",
    "grown_terms": f"WITH {RECRAWLED} SELECT term, count(*) AS df FROM postings GROUP BY term",
    "grown_documents": (
        f"WITH {RECRAWLED} SELECT doc_id, url, doc_length, title, snippet FROM metadata JOIN lengths USING (doc_id)"
    ),
    "grown_stats": f"WITH {RECRAWLED} SELECT count(*) AS n_docs, round(avg(doc_length), 6) AS avgdl FROM lengths",
    "search_grown": f"WITH {RECRAWLED}, {BENCHMARK}, {QUERY_TERMS}, {scoring('tf')} {RESULTS}",
    "not_indexed": f"{WITH_STATE} SELECT doc_id, status FROM state WHERE status = 'crawled_not_queued'",
    "index_from_ids": f"""{WITH_STATE} SELECT doc_id, doc_length, title, snippet FROM metadata
WHERE doc_id IN (SELECT doc_id FROM pages_read WHERE fetched) AND doc_id IN (SELECT doc_id FROM documents)""",
    "index_rejects": """
SELECT page_id AS doc_id, unnest(['bad gzip', 'short read', 'no file']) AS reason FROM pages""",
    "exact_duplicates": """
SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS keep_id
FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1""",
    "highlight": HIGHLIGHT,
    "fold_and_stop": f"""
WITH folded AS (SELECT doc_id, {folded('text')} AS text FROM documents)
SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({index_tokens('text')}) AS term FROM folded)
WHERE term NOT IN ({_listed(STOP_WORDS)})""",
    "fold_marked": f"""
WITH marked AS (
  SELECT doc_id, replace(translate(text, 'aeioucsz', 'ảệīőűčșž'), 'n', 'n' || chr(771)) AS text FROM documents
  UNION ALL SELECT -doc_id - 1,
    replace(translate(upper(text), 'AEOC', 'ẤỀỎĆ'), 'T', 'T' || chr(803) || chr(769)) FROM documents
), folded AS (SELECT doc_id, {folded('text')} AS text FROM marked)
SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({index_tokens('text')}) AS term FROM folded)
WHERE term NOT IN ({_listed(STOP_WORDS)})""",
    "hand_over": f"""
SELECT page_id AS doc_id, least({_FAILS} + 1, 3)::INTEGER AS attempts,
  CASE WHEN {_FAILS} < 3 THEN 'queued' ELSE 'crawled_not_queued' END AS status,
  CASE WHEN {_FAILS} = 3 THEN 'bad gzip' END AS reason FROM pages""",
    "hand_over_attempts": f"""
SELECT page_id AS doc_id, attempt::INTEGER AS attempt, CASE WHEN {_FAILS} >= attempt THEN 'bad gzip' END AS reason
FROM pages, range(1, 4) r(attempt) WHERE attempt <= {_FAILS} + 1""",
    "dead_letters": f"""
SELECT page_id AS doc_id, url, CASE WHEN {_FAILS} = 3 THEN 'crawled_not_queued' ELSE 'crawled' END AS status FROM pages""",
}
