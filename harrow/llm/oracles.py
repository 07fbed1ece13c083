"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from harrow.llm.decontamination import (
    DRIFT, LEAST_PLAIN, LEAST_TOKENS, LEAST_WINDOWS, NAME, NUMBER, NUMBER_WORDS, UNIT, UNITS, WINDOW,
)
from harrow.llm.shards import SHARDS, TOLERANCE
from harrow.llm.url_rules import PATTERNS, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), single AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM single a JOIN single b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least ON a = doc_id
"""


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}'))"


def _url_rules() -> str:
    longest_first = sorted(RULES, key=lambda pair: -len(pair[1]))
    rules = " ".join(f"WHEN {_fits(rule)} THEN '{rule}'" for _, rule in longest_first)
    verdicts = " ".join(f"WHEN rule = '{rule}' THEN '{action}'" for action, rule in RULES)
    patterns = " ".join(
        f"WHEN contains(lower(concat(host, path)), '{text.rstrip('*')}') THEN '{action}'" for action, text in PATTERNS)
    return f"""
WITH parts AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages
), ruled AS (SELECT *, CASE {rules} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {verdicts} {patterns} ELSE 'allow' END AS verdict FROM ruled
"""


WARC_RECORDS = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN f ON p.d = f.d
"""

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, last_id IS NOT NULL AND doc_id <> last_id AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_PLACEHOLDERS = f"('{NUMBER}', '{NAME}', '{UNIT}')"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{word}'" for word in words)


def _template(name: str) -> str:
    """The placeholder or word of token `x`."""
    return f"""CASE WHEN {name} THEN '{NAME}' WHEN x[1] BETWEEN '0' AND '9' THEN '{NUMBER}'
      WHEN lower(x) IN ({_in(NUMBER_WORDS)}) THEN '{NUMBER}' WHEN lower(x) IN ({_in(UNITS)}) THEN '{UNIT}' ELSE lower(x) END"""


_WORD = "[\\p{L}\\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[%$€£°]"
_UNSPACED = "[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}\\p{Lao}\\p{Khmer}\\p{Myanmar}]\\p{M}*"


def _typed(table: str, key: str) -> str:
    """Names behind a word, a digit or a comma are marked in the text first."""
    names = "([\\p{Ll}0-9,;]) (\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)*)"
    return f"""
  SELECT {key}, list_transform(o, lambda x: trim(x, '\ue000\ue001')) AS raw,
    list_transform(o, lambda x: {_template("x[1] = '\ue000'")}) AS t
  FROM (SELECT {key}, regexp_extract_all(regexp_replace(text, '{names}', '\\1 \ue000\\2\ue001', 'g'),
    '\ue000[^\ue001]*\ue001|{_WORD}') AS o FROM (SELECT DISTINCT {key}, text FROM {table} WHERE text IS NOT NULL))"""


def _named(table: str, key: str) -> str:
    """Capitalised words with nothing but white space between them are put together, row by row."""
    return f"""
  SELECT {key}, list(x ORDER BY pos) AS raw, list({_template("named")} ORDER BY pos) AS t FROM (
    SELECT {key}, n, run, min(pos) AS pos, string_agg(x, ' ' ORDER BY pos) AS x, bool_or(named) AS named FROM (
      SELECT *, sum(CASE WHEN (named AND apart AND before) OR regexp_full_match(x, '\\s+') THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY pos) AS run FROM (
        SELECT *, lag(regexp_full_match(x, '\\s+')) OVER w AS apart, lag(named, 2) OVER w AS before FROM (
          SELECT *, regexp_full_match(x, '\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]+') AS named FROM (
            SELECT {key}, n, unnest(o) AS x, generate_subscripts(o, 1) AS pos FROM (
              SELECT {key}, row_number() OVER () AS n, regexp_extract_all(text, '{_WORD}|\\s+|.') AS o
              FROM (SELECT DISTINCT {key}, text FROM {table} WHERE text IS NOT NULL)))) WINDOW w AS (PARTITION BY n ORDER BY pos)))
    WHERE regexp_full_match(x, '{_WORD}') GROUP BY {key}, n, run) GROUP BY {key}, n"""


def _plain(table: str, key: str) -> str:
    spaced = f"regexp_replace(text, '({_UNSPACED})', ' \\1 ', 'g')"
    return f"""
  SELECT {key}, o AS raw, list_transform(o, lambda x: lower(x)) AS t
  FROM (SELECT {key}, regexp_extract_all({spaced},
    '{_UNSPACED}|[\\p{{L}}\\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*|\\p{{Nd}}+|[-%*/^]|\\p{{Sm}}|\\p{{Sc}}|°') AS o
    FROM (SELECT DISTINCT {key}, text FROM {table} WHERE text IS NOT NULL))"""


def _reading(name: str, tokens, least: int, slots: bool) -> str:
    provable = f"WHERE 2 * len(list_filter(w, lambda x: x NOT IN {_PLACEHOLDERS})) >= size" if slots else ""
    placeholder = f"items.t[n] IN {_PLACEHOLDERS}" if slots else "FALSE"
    return f"""
{name} AS (
  WITH docs AS ({tokens("documents", "doc_id")}),
  items AS (SELECT *, least(len(t), {WINDOW}) AS size FROM ({tokens("benchmark", "item_id")})),
  item_windows AS (
    SELECT item_id, size, place, w FROM (
      SELECT item_id, size, place, t[place:place + size - 1] AS w
      FROM (SELECT *, unnest(range(1, len(t) - size + 2)) AS place FROM items WHERE size >= {least})) {provable}
  ), sizes AS (SELECT item_id, count(*) AS n_windows FROM item_windows GROUP BY item_id),
  lengths AS (SELECT DISTINCT size FROM item_windows),
  doc_windows AS (
    SELECT doc_id, size, place, t[place:place + size - 1] AS w
    FROM (SELECT *, unnest(range(1, len(t) - size + 2)) AS place FROM docs, lengths WHERE len(t) >= size)
  ), matched AS (
    SELECT doc_id, item_id, size, i.place AS place, d.place - i.place AS line
    FROM doc_windows d JOIN item_windows i USING (size, w)
  ), placed AS (
    SELECT doc_id, item_id, size, band, place, min(line) AS line
    FROM (SELECT *, unnest([floor(line / {DRIFT}.0), floor(line / {DRIFT}.0) - 1]) AS band FROM matched) GROUP BY doc_id, item_id, size, band, place
  ), near AS (
    SELECT doc_id, item_id, size, band, list(struct_pack(place := place, line := line)) AS places FROM placed GROUP BY ALL
  ), strong AS (
    SELECT near.*, n_windows, list_filter(list_distinct(flatten(list_transform(places, lambda p: list_transform(
      range(p.place, p.place + near.size), lambda n: struct_pack(n := n, line := p.line))))),
      lambda s: {placeholder.replace("[n]", "[s.n]")}) AS slots, items.raw AS item_raw, docs.raw AS doc_raw
    FROM near JOIN sizes USING (item_id) JOIN items USING (item_id) JOIN docs USING (doc_id)
    WHERE len(places) >= least(n_windows, {LEAST_WINDOWS})
  ), paired AS (
    SELECT *, list_transform(slots, lambda s: {{'asked': lower(item_raw[s.n]), 'found': lower(doc_raw[s.n + s.line])}}) AS pairs
    FROM strong
  )
  SELECT doc_id, item_id, len(places) AS n_matched, n_windows, len(slots) AS n_slots,
    len(list_filter(pairs, lambda p: p.asked <> p.found)) AS n_changed
  FROM paired WHERE len(list_distinct(pairs)) = len(list_distinct(list_transform(pairs, lambda p: p.asked)))
  QUALIFY row_number() OVER (
    PARTITION BY doc_id, item_id ORDER BY n_matched DESC, n_changed, n_windows DESC, n_slots DESC) = 1
)"""


BENCHMARK_LEAKS = f"""
WITH {_reading("typed", _typed, LEAST_TOKENS, True)}, {_reading("named", _named, LEAST_TOKENS, True)},
{_reading("plain", _plain, LEAST_PLAIN, False)}, short AS (
  SELECT DISTINCT doc_id, item_id FROM ({_plain("benchmark", "item_id")}) i JOIN ({_plain(
    "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)", "doc_id")}) d ON d.t = i.t
  WHERE len(i.t) BETWEEN 1 AND {LEAST_PLAIN - 1}
), every AS (
  SELECT *, 0 AS way FROM typed UNION ALL SELECT *, 1 FROM named UNION ALL SELECT *, 2 FROM plain
  UNION ALL SELECT doc_id, item_id, 1, 1, 0, 0, 3 FROM short
)
SELECT doc_id, item_id, n_matched::INTEGER AS n_matched, n_windows, n_slots::INTEGER AS n_slots, n_changed::INTEGER AS n_changed
FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY way) = 1
"""

# CRC-32 by its table: needs `crc_table` in FROM
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc_t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
)"""


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of a VARCHAR expression, of its UTF-8 bytes."""
    coded = f"hex(encode({text}))"
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length({coded}) // 2),
    lambda i: ('0x' || {coded}[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, x: xor(crc_t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"""


# A run shows as a stretch of places whose five words stand there q words before, too.
PERIODIC_RUNS = f"""
WITH {CRC_TABLE}, split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, {_crc32("doc_id::VARCHAR")} AS h
  FROM documents, crc_table
), turned AS (
  SELECT doc_id, o, len(o) AS n, h, h // 10 AS g, (h // 10) % greatest(len(o), 1) AS a FROM split
), docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n),
    lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w
  FROM turned
), grams AS (
  SELECT doc_id, i, w[i + 1:i + 5] AS gram FROM (SELECT doc_id, w, unnest(range(0, n - 4)) AS i FROM docs WHERE n >= 6)
), pairs AS (
  SELECT a.doc_id, a.i, a.i - b.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i > b.i
), stretches AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + 4 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, list(struct_pack(s := start, n := length, q := period) ORDER BY start, period) AS by_start,
    first(struct_pack(s := start, n := length, q := period) ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS i
  FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(by_start), 0)::BIGINT AS n_runs, best.s AS start, best.n AS length, best.q AS period,
  1000 * best.n // best.q AS exponent_milli,
  sha256(coalesce(list_aggregate(list_transform(by_start, lambda r: r.s || ',' || r.n || ',' || r.q || chr(10)),
    'string_agg', ''), '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone.i IS NULL THEN w
    ELSE list_filter(w, lambda x, k: NOT list_contains(gone.i, k - 1)) END, ' '), '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

# Cuts by running bytes over the order (hash of the text, doc_id); see the splitter rule of the operator.
HISTOGRAM_SHARDS = f"""
WITH {CRC_TABLE}, docs AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS h FROM documents
), ordered AS (
  SELECT *, sum(size) OVER w - size AS before, row_number() OVER w AS n, sum(size) OVER () AS total
  FROM docs WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
), groups AS (SELECT h, min(before) AS b0, max(before + size) AS b1, any_value(total) AS total FROM ordered GROUP BY h),
cuts AS (
  SELECT CASE WHEN least(t - b0, b1 - t) > floor(total * {TOLERANCE} / {SHARDS}) THEN t
    WHEN t - b0 <= b1 - t THEN b0 ELSE b1 END AS cut
  FROM (SELECT *, i * total // {SHARDS} AS t FROM groups, range(1, {SHARDS}) r(i)) WHERE t >= b0 AND t < b1
), placed AS (
  SELECT *, (SELECT count(*) FROM cuts WHERE cut <= before) AS shard FROM ordered
)
SELECT doc_id, size::BIGINT AS size, {_crc32("text")} AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc_table
"""

PREFIX_TRIE = f"""
WITH {CRC_TABLE}, turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(struct_pack(r := r, t := t)
    ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || t)) AS s FROM turns GROUP BY conv_id
), led AS (SELECT *, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM own, crc_table),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM led a LEFT JOIN own b ON b.conv_id = a.base
), nodes AS (
  SELECT p, len(p) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM (SELECT conv_id, s[1:unnest(range(0, len(s) + 1))] AS p FROM rebuilt) GROUP BY p
), children AS (SELECT p[1:len(p) - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT s AS p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM rebuilt GROUP BY s),
above AS (
  SELECT p[1:unnest(range(0, depth + 1))] AS p, NOT EXISTS (FROM children c WHERE c.p = nodes.p) AS leaf,
    (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(p[depth].t)) END AS saved FROM nodes
), under AS (SELECT p, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY p)
SELECT nodes.conv_id, depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n_convs, coalesce(children.n, 0) AS n_children,
  n_leaves, saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes JOIN under USING (p) LEFT JOIN children USING (p) LEFT JOIN ends USING (p)
LEFT JOIN (SELECT p, conv_id FROM nodes) up ON depth > 0 AND up.p = nodes.p[1:depth - 1]
"""

ORACLES = {
    "op10_benchmark_leaks": BENCHMARK_LEAKS,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_histogram_shards": HISTOGRAM_SHARDS,
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_url_rules": _url_rules(),
    "op5_warc_records": WARC_RECORDS,
    "op6_line_dedup": LINE_DEDUP,
}
