"""Named queries over a folder of tables, `(spark, folder) -> DataFrame`.

Index versions and archives made from a folder are built once per session.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow import schemas
from harrow.functions import scoring
from harrow.functions import text as tx
from harrow.functions import warc_format as wf
from harrow.operators import documents as docs
from harrow.operators import extract, frontier, handoff, highlight, indexing, ranking, stats
from harrow.plans import search as plans
from harrow.session import fits_broadcast, new_path, stored, use_small_batches
from harrow.sources import grown_index, log_state, queue, warc
from harrow.sources.index_store import SearchIndex, build_index, lookup
from harrow.sources.tables import read_table
from harrow.streaming import batches, crawl
from harrow.streaming import index as stream_index

QUERY = "the and tion tion"
LOOKUP_TERMS = ["and", "the", "tion"]
STOP_WORDS = ["and", "are", "das", "der", "die", "est", "for", "les", "que", "that", "the", "und", "with"]
FIXED_DATE = "2024-01-01T00:00:00Z"

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, label: str, make):
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _made:
        _made[key] = make()
    return _made[key]


# --- inputs ------------------------------------------------------------------


def _documents(spark, folder) -> DataFrame:
    return read_table(spark, folder, "documents")


def _pages(spark, folder) -> DataFrame:
    use_small_batches(spark)
    return read_table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id")


def _benchmark(spark, folder) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def _conversations(spark, folder) -> DataFrame:
    return read_table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("q"), "role"
    )


def _extracted(spark, folder) -> DataFrame:
    return _once(spark, folder, "extracted", lambda: stored(
        extract.extract_all(_pages(spark, folder)), "extracted"
    ))


def _half_fetched(spark, folder) -> DataFrame:
    """The pages with a seventh of the downloads failed and a seventh cut by NUL characters."""
    html = (
        F.when(F.col("doc_id") % 7 == 3, "")
        .when(F.col("doc_id") % 7 == 5, F.regexp_replace("html", "</p>", "\u0000"))
        .otherwise(F.col("html"))
    )
    return _pages(spark, folder).withColumn("html", html)


def documents_index(spark, folder) -> SearchIndex:
    """Index version over the `documents` table; it has no titles."""
    return _once(spark, folder, "documents-index", lambda: build_index(
        _documents(spark, folder).select(
            "doc_id",
            F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"),
            F.lit("").alias("title"), "text",
        )
    ))


def pages_index(spark, folder) -> SearchIndex:
    """Index version over the extracted `pages` table."""
    return _once(spark, folder, "pages-index", lambda: build_index(_extracted(spark, folder)))


def half_fetched_index(spark, folder) -> SearchIndex:
    return _once(spark, folder, "half-fetched-index", lambda: build_index(
        extract.extract_all(_half_fetched(spark, folder))
    ))


def _archive(spark, folder) -> str:
    def make():
        path = new_path(spark, "warc")
        warc.write_archive(_pages(spark, folder).repartition("doc_id"), path)
        return path
    return _once(spark, folder, "archive", make)


def _manifest(spark, folder) -> DataFrame:
    return warc.read_manifest(spark, _archive(spark, folder))


def _frontier(spark, folder) -> DataFrame:
    """A queue with valid, invalid, repeated and missing URLs, all from the tables."""
    pages = _pages(spark, folder)
    base = 10 ** 9
    parts = [
        pages.select(F.col("doc_id").alias("seq"), "url"),
        _documents(spark, folder).select(
            F.col("doc_id") + base,
            F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang"),
        ),
        _conversations(spark, folder).select(
            F.col("qid") + 2 * base, F.nullif("role", F.lit("system"))
        ),
        pages.select(F.col("doc_id") + 3 * base, F.upper("url")),
        pages.select(F.col("doc_id") + 4 * base, "url"),
    ]
    queue = parts[0]
    for part in parts[1:]:
        queue = queue.union(part)
    return queue


def _known(spark, folder) -> DataFrame:
    """URLs accepted in an earlier crawl: the pages under /fr/."""
    return _pages(spark, folder).filter(F.col("url").contains("/fr/")).select(
        "doc_id", "url", F.lit("crawled").alias("status")
    )


def _fetched(spark, folder) -> DataFrame:
    """Pages whose download worked: those not under /fr/."""
    return _pages(spark, folder).filter(~F.col("url").contains("/fr/"))


def _crawl(spark, folder) -> str:
    """Archive of the fetched pages."""
    def make():
        path = new_path(spark, "warc")
        warc.write_archive(_fetched(spark, folder).repartition("doc_id"), path)
        return path
    return _once(spark, folder, "crawl", make)


def _indexed(spark, folder) -> DataFrame:
    """What an index of the longer pages holds, read by position from the archive."""
    def make():
        long = _fetched(spark, folder).filter(F.octet_length("html") >= 3000)
        wanted = docs.documents_by_ids(warc.read_manifest(spark, _crawl(spark, folder)), long)
        records = warc.read_records(wanted, _crawl(spark, folder)).filter(F.col("reason").isNull())
        return stored(extract.index_metadata(extract.extract_pages(
            records.select("doc_id", "url", F.col("body").alias("html")))), "indexed")
    return _once(spark, folder, "indexed", make)


def _doc_log(spark, folder) -> DataFrame:
    """Life of the pages: accepted; fetched unless under /fr/; indexed or not queued."""
    pages = _pages(spark, folder)
    manifest = warc.read_manifest(spark, _crawl(spark, folder))
    indexed = _indexed(spark, folder)
    rows = [
        pages.select("doc_id", F.lit(1).alias("seq"), "url", F.lit("processing").alias("status")),
        docs.crawled_rows(manifest, seq=2),
        indexed.withColumn("seq", F.lit(3)),
        docs.not_indexed(manifest.withColumn("status", F.lit("crawled")), indexed).withColumn("seq", F.lit(4)),
    ]
    log = docs.log_rows(rows[0])
    for part in rows[1:]:
        log = log.unionByName(docs.log_rows(part))
    return log


def _old_postings(spark, folder) -> DataFrame:
    """Postings of the documents an earlier batch held: the labelled ones."""
    labelled = read_table(spark, folder, "labels").select("doc_id")
    return indexing.doc_terms(docs.documents_by_ids(_documents(spark, folder), labelled))


def _hits(spark, folder) -> tuple[SearchIndex, DataFrame]:
    """Candidates of the benchmark texts, used as queries over `documents`."""
    index = documents_index(spark, folder)
    terms = ranking.query_terms(_benchmark(spark, folder))
    fits = fits_broadcast(terms)
    weighted = ranking.weighted_terms(terms, index.term_stats, index.n_docs, fits)
    if not fits:
        weighted = stored(weighted, "query-terms")
    return index, ranking.candidates(index.postings, weighted, fits)


def _page_results(spark, folder, **options) -> DataFrame:
    return plans.search_batch(pages_index(spark, folder), _benchmark(spark, folder), **options)


# --- scans, sources, sinks ---------------------------------------------------


def scan_documents(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("bytes")
    )


def warc_write_manifest(spark, folder):
    """Every page has one record, and the records of a file leave no gaps."""
    manifest = _manifest(spark, folder)
    ends = manifest.select(
        "file_path", (F.col("offset") + F.col("length")).alias("offset"), F.lit(True).alias("joins")
    )
    return manifest.join(ends, ["file_path", "offset"], "left").select(
        "doc_id", "url",
        (F.coalesce("joins", F.lit(False)) | (F.col("offset") == 0)).alias("follows_previous"),
        (F.col("length") > 0).alias("has_bytes"),
    )


def warc_point_read(spark, folder):
    """The bytes at each position, inflated here: header fields and a hash of the body."""
    read = warc.read_ranges(_manifest(spark, folder), _archive(spark, folder))
    return read.select("doc_id", _inflate(F.col("body")).alias("record")).select(
        "doc_id",
        F.regexp_extract("record", "WARC-Target-URI: ([^\r]*)", 1).alias("url"),
        F.md5(F.encode(F.regexp_extract("record", f"(?s)^.*?{wf.BLANK_LINE}(.*)$", 1), "UTF-8")).alias("body_md5"),
    )


@F.arrow_udf(T.StringType())
def _inflate(members: pa.Array) -> pa.Array:
    return pa.array([gzip.decompress(member).decode() for member in members.to_pylist()])


def warc_payload(spark, folder):
    records = warc.read_records(_manifest(spark, folder), _archive(spark, folder))
    return records.select("doc_id", "url", F.md5(F.encode("body", "UTF-8")).alias("body_md5"))


def warc_scan(spark, folder):
    records = warc.scan_archive(spark, _archive(spark, folder))
    return records.select(
        F.col("headers")["WARC-Target-URI"].alias("url"),
        F.col("headers")["WARC-Type"].alias("record_type"),
        F.col("headers")["Content-Length"].cast("long").alias("content_length"),
        F.octet_length("body").cast("long").alias("body_bytes"),
    )


def build_postings(spark, folder):
    return indexing.count_terms(_documents(spark, folder))


def posting_lookup(spark, folder):
    return lookup(documents_index(spark, folder).postings, LOOKUP_TERMS).select("term", "doc_id")


def index_metadata(spark, folder):
    return extract.index_metadata(_extracted(spark, folder))


def seed_frontier(spark, folder):
    """The full queue stays as it is; the queue of missing URLs gets the seed."""
    queue = _frontier(spark, folder)
    full = frontier.seed_frontier(queue).select(F.lit("full").alias("queue"), "seq", "url")
    none = frontier.valid_urls(queue.filter(F.col("url").isNull()))
    return full.union(frontier.seed_frontier(none).select(F.lit("empty").alias("queue"), "seq", "url"))


RESPONSE = (
    "query string, results array<struct<id:bigint,url:string,title:string,snippet:string,score:double>>, "
    "meta struct<count:int,latency_ms:double>"
)


def search_json(spark, folder):
    """The JSON responses, read back row by row."""
    made = ranking.responses(_benchmark(spark, folder), _page_results(spark, folder))
    read = made.select("qid", F.from_json("response", RESPONSE).alias("r"))
    rows = read.select(
        "qid", "r.query", F.col("r.meta.count").alias("result_count"),
        F.posexplode_outer("r.results").alias("pos", "hit"),
    )
    return rows.select(
        "qid", "query", "result_count", (F.col("pos") + 1).alias("rank"),
        "hit.id", "hit.url", "hit.title", "hit.snippet", F.round("hit.score", 6).alias("score"),
    )


# --- projections, filters ----------------------------------------------------


def valid_urls(spark, folder):
    return frontier.valid_urls(_frontier(spark, folder))


def file_basename(spark, folder):
    url = F.col("url")
    return _pages(spark, folder).select(
        "doc_id", tx.base_name(F.rtrim(url, F.lit("/"))).alias("name"),
        tx.base_name(F.translate(url, "/", "\\")).alias("name_backslash"),
        tx.base_name(F.regexp_replace(url, "/", "")).alias("name_plain"),
    )


def parse_doc_ids(spark, folder):
    d = _documents(spark, folder)
    id_text = F.col("doc_id").cast("string")
    items = (
        d.select(F.concat_ws(" ", id_text, "source").alias("item"))
        .union(d.select(F.col("source")))
        .union(d.select(F.concat(F.lit("  -"), id_text)))
        .union(d.select(F.concat(F.lit("9999999999"), id_text)))
    )
    return frontier.parse_doc_ids(items)


def clean_queue(spark, folder):
    return frontier.clean_queue(_frontier(spark, folder))


def queue_replies(spark, folder):
    """User turns as whole replies; other turns as replies of wrong form, or none."""
    asked = _conversations(spark, folder)
    reply = (
        F.when(F.col("role") == "user", F.to_json(F.array("role", "q")))
        .when(F.col("qid") % 4 == 0, F.to_json(F.array("role")))
        .when(F.col("qid") % 4 == 1, F.to_json(F.struct("role", "q")))
        .when(F.col("qid") % 4 == 2, F.col("role"))
    )
    return frontier.queue_items(asked.select("qid", reply.alias("reply"))).select("qid", "item")


def nonempty_pages(spark, folder):
    pages = _pages(spark, folder)
    fetched = F.when(F.col("url").contains("/fr/"), "").otherwise(F.col("html"))
    return extract.nonempty_pages(pages.withColumn("html", fetched)).select("doc_id", "url")


def docs_by_ids(spark, folder):
    return docs.documents_by_ids(
        _documents(spark, folder).select("doc_id", "lang", "source", "n_chars"),
        read_table(spark, folder, "labels"),
    )


def nonblank_queries(spark, folder):
    asked = _conversations(spark, folder)
    blank = asked.select("qid", F.regexp_replace("q", "[^ \\n]", "").alias("q"))
    return ranking.nonblank(asked.select("qid", "q").union(blank))


def docs_by_status(spark, folder):
    state = docs.document_state(_doc_log(spark, folder))
    return docs.documents_by_status(state, "crawled").select("doc_id", "url", "status")


def first_documents(spark, folder):
    return docs.first_documents(docs.document_state(_doc_log(spark, folder)))


# --- joins -------------------------------------------------------------------


def _digest(rows: DataFrame, *sums) -> DataFrame:
    """Per query: pairs, the sum of their ids, and sums of values; pairs stay where they are made."""
    return rows.groupBy("qid").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("doc_id").alias("id_sum"), *sums
    )


def candidates(spark, folder):
    hits = _hits(spark, folder)[1]
    weighed = (F.col("pos") + 1) * F.col("doc_id")
    return _digest(hits, F.sum(weighed).alias("pos_sum"), F.sum(F.length("term")).alias("letters"))


def candidate_lengths(spark, folder):
    index, hits = _hits(spark, folder)
    found = ranking.with_lengths(ranking.candidate_set(hits), index.documents)
    effective = scoring.length_or_average(F.col("doc_length"), F.lit(index.avgdl))
    return _digest(
        found, F.sum("doc_length").alias("length_sum"), F.round(F.sum(effective), 3).alias("effective_sum")
    )


def topk_metadata(spark, folder):
    """Top documents of each benchmark text, joined to page metadata by id."""
    index, hits = _hits(spark, folder)
    ranked = ranking.top_k(ranking.scores(ranking.with_contributions(hits, index.avgdl)))
    joined = ranking.with_metadata(ranked, pages_index(spark, folder).documents)
    return joined.withColumn("score", F.round("score", 6))


def accept_urls(spark, folder):
    return frontier.accept_urls(_frontier(spark, folder), _known(spark, folder)).select("seq", "url")


def new_postings(spark, folder):
    new = indexing.doc_terms(_documents(spark, folder))
    ids = _documents(spark, folder).select("doc_id")
    return indexing.unseen_postings(new, _old_postings(spark, folder), ids)


# --- aggregations ------------------------------------------------------------


def corpus_stats(spark, folder):
    lengths = indexing.doc_lengths(_documents(spark, folder))
    return stats.corpus_stats(lengths).withColumn("avgdl", F.round("avgdl", 6))


def doc_lengths(spark, folder):
    return indexing.doc_lengths(_documents(spark, folder))


def doc_terms(spark, folder):
    return indexing.doc_terms(_documents(spark, folder))


def posting_strings(spark, folder):
    return indexing.posting_strings(documents_index(spark, folder).postings)


def posting_string_parts(spark, folder):
    """Lists cut after 50 ids."""
    return indexing.posting_strings(documents_index(spark, folder).postings, max_ids=50)


def term_df(spark, folder):
    terms = indexing.doc_terms(_documents(spark, folder))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_contrib(spark, folder):
    index, hits = _hits(spark, folder)
    worth = ranking.with_contributions(hits, index.avgdl)
    return _digest(worth, F.round(F.sum(F.col("c") * (F.col("pos") + 1)), 5).alias("contribution_sum"))


def bm25_scores(spark, folder):
    index, hits = _hits(spark, folder)
    scored = ranking.scores(ranking.with_contributions(hits, index.avgdl))
    return _digest(
        scored, F.round(F.sum("score"), 5).alias("score_sum"), F.round(F.max("score"), 6).alias("best"),
        F.sum(F.col("first_pos") * F.col("doc_id")).alias("first_sum"),
    )


def candidate_set(spark, folder):
    return _digest(ranking.candidate_set(_hits(spark, folder)[1]))


def result_counts(spark, folder):
    return ranking.result_counts(_benchmark(spark, folder), _page_results(spark, folder))


def _with_bodies(spark, folder, state: DataFrame) -> DataFrame:
    """Positions differ from run to run; what is read at them does not."""
    state = stored(state, "state")
    records = warc.read_records(state.filter("file_path IS NOT NULL"), _crawl(spark, folder))
    bodies = records.select("doc_id", F.md5(F.encode("body", "UTF-8")).alias("body_md5"))
    return state.join(bodies, "doc_id", "left").select(
        "doc_id", "url", "status", "doc_length", "title", "snippet", "body_md5")


def document_state(spark, folder):
    return _with_bodies(spark, folder, docs.document_state(_doc_log(spark, folder)))


def _log_segments(spark, folder) -> str:
    """The log in four batches, the fetched positions after what was indexed; one batch comes twice."""
    def make():
        path = new_path(spark, "log-state")
        log = stored(_doc_log(spark, folder), "log")
        for batch, seq in enumerate((1, 3, 2, 4)):
            for _ in range(2 if seq == 3 else 1):
                log_state.append_log(log.filter(F.col("seq") == seq), path, batch, fanout=3)
        return path
    return _once(spark, folder, "log-state", make)


def state_from_segments(spark, folder):
    return _with_bodies(spark, folder, log_state.current_state(spark, _log_segments(spark, folder)))


def state_of_version(spark, folder):
    """The state when the positions had not come yet."""
    state = log_state.current_state(spark, _log_segments(spark, folder), number=2)
    return state.select("doc_id", "url", "status", "doc_length", "title", "snippet", F.col("file_path").isNull().alias("no_file"))


def state_of_ids(spark, folder):
    """Looked up by id: the pages whose id is a document's, too."""
    ids = _documents(spark, folder).select("doc_id")
    state = log_state.current_state(spark, _log_segments(spark, folder), ids=ids)
    return state.select("doc_id", "url", "status", "doc_length", "title")


# --- ranking -----------------------------------------------------------------


def _rounded(results: DataFrame) -> DataFrame:
    return results.withColumn("score", F.round("score", 6))


def search_topk(spark, folder):
    return _rounded(plans.search(pages_index(spark, folder), QUERY))


def search_failed_downloads(spark, folder):
    """Failed downloads have no text but count as documents."""
    return _rounded(plans.search_batch(half_fetched_index(spark, folder), _benchmark(spark, folder)))


def search_deep(spark, folder):
    """Many results of one query: every document that matches, ranked over ranges."""
    return _rounded(plans.search(documents_index(spark, folder), QUERY, k=None))


def search_documents(spark, folder):
    """The flagship query over the text corpus."""
    return _rounded(plans.search(documents_index(spark, folder), QUERY))


def search_batch(spark, folder):
    """Every conversation turn as a query over the text corpus."""
    asked = _conversations(spark, folder).select("qid", "q")
    return _rounded(plans.search_batch(documents_index(spark, folder), asked))


def search_batch_exhaustive(spark, folder):
    return _rounded(_page_results(spark, folder, bounded=False))


def search_batch_bounded(spark, folder):
    return _rounded(_page_results(spark, folder, bounded=True))


def search_topk_tf(spark, folder):
    """True term frequencies instead of one per posting."""
    return _rounded(_page_results(spark, folder, use_tf=True))


# --- set operations ----------------------------------------------------------


def merge_postings(spark, folder):
    """Old postings of all documents, which had other words then: these terms stay beside the new ones."""
    documents = _documents(spark, folder)
    before = documents.withColumn("text", F.concat("lang", F.lit("lang "), F.translate("text", "aet", "eta")))
    return indexing.merge_postings(indexing.doc_terms(before), indexing.doc_terms(documents))


# --- text --------------------------------------------------------------------


def tokenize_documents(spark, folder):
    return indexing.doc_tokens(_documents(spark, folder))


def tokenize_queries(spark, folder):
    return ranking.query_terms(_conversations(spark, folder))


def page_text(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id", F.concat_ws(" ", tx.index_tokens(F.col("text"))).alias("tokens")
    )


def page_titles(spark, folder):
    return _extracted(spark, folder).select("doc_id", "title")


def snippets(spark, folder):
    return _documents(spark, folder).select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


def term_idf(spark, folder):
    index = documents_index(spark, folder)
    found = stats.term_idf(index.term_stats, index.n_docs)
    return found.withColumn("idf", F.round("idf", 6))


def parse_postings(spark, folder):
    strings = indexing.posting_strings(documents_index(spark, folder).postings)
    return indexing.parse_posting_strings(strings)


def parse_posting_parts(spark, folder):
    return indexing.parse_posting_strings(posting_string_parts(spark, folder))


def warc_dates(spark, folder):
    events = read_table(spark, folder, "events")
    return events.select("event_id", wf.record_date(F.col("ts")).alias("warc_date"))


def warc_headers(spark, folder):
    return _pages(spark, folder).select("doc_id", wf.record_header(
        F.col("url"), F.octet_length("html"), F.lit(FIXED_DATE), F.col("doc_id").cast("string")
    ).alias("header"))


# --- streaming ---------------------------------------------------------------


def stream_accept_urls(spark, folder):
    """The queue published in two parts; the stream runs after each, the second time from its checkpoint."""
    path, table, checkpoint = (new_path(spark, label) for label in ("queue", "accepted", "stream"))
    rows = stored(_frontier(spark, folder), "frontier")
    size = max(1, rows.count() // 7)
    for part in (rows.filter(F.col("seq") < 10 ** 9), rows.filter(F.col("seq") >= 10 ** 9)):
        queue.publish(part, path, segment_rows=size)
        crawl.accept_queue(spark, path, table, checkpoint, _known(spark, folder), rows_per_batch=2 * size)
    return batches.read_table(spark, table, crawl.ACCEPTED).select("doc_id", "url", "status")


def _streamed(spark, folder) -> stream_index.StreamedIndex:
    def make():
        queue = new_path(spark, "queue")
        _manifest(spark, folder).repartition(4).write.parquet(queue)
        source = (
            spark.readStream.schema(schemas.MANIFEST).option("maxFilesPerTrigger", 2).parquet(queue)
        )
        index = stream_index.StreamedIndex(new_path(spark, "streamed-index"))
        stream_index.index_stream(
            source, _archive(spark, folder), index, new_path(spark, "stream")
        ).awaitTermination()
        return index
    return _once(spark, folder, "streamed", make)


def _recrawled(spark, folder) -> stream_index.StreamedIndex:
    """The pages fetched three times over: as they are, a third of them empty or with other
    text, and a fifth twice in one batch, of which the later download counts."""
    def make():
        path = new_path(spark, "warc")
        pages = _pages(spark, folder)
        id3, id5 = F.col("doc_id") % 3, F.col("doc_id") % 5
        changed = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("<p>anew thing</p>"), "html"))
        rounds = [
            [pages],
            [pages.filter(id3 == 0).withColumn("html", changed)],
            [pages.filter(id5 == 0).withColumn("html", F.lit("<p>first of two</p>")),
             pages.filter(id5 == 0).withColumn("html", F.concat(F.lit("<p>second of two</p>"), "html"))],
        ]
        index = stream_index.StreamedIndex(new_path(spark, "recrawled"))
        index.prepare(spark)
        seen = spark.createDataFrame([], "file_path string")
        for number, downloads in enumerate(rounds):
            handed = None
            for seq, download in enumerate(downloads):
                warc.write_archive(download.repartition("doc_id"), path)
                rows = stored(warc.read_manifest(spark, path).join(seen, "file_path", "left_anti"), "handed-over")
                seen = stored(seen.union(rows.select("file_path")).distinct(), "seen-files")
                rows = rows.withColumn("seq", F.lit(seq))
                handed = rows if handed is None else handed.unionByName(rows)
            stream_index.index_batch(handed, path, index, number)
        return index
    return _once(spark, folder, "recrawled", make)


def recrawled_postings(spark, folder):
    return _recrawled(spark, folder).postings(spark)


def recrawled_documents(spark, folder):
    return _recrawled(spark, folder).documents(spark).select("doc_id", "url", "doc_length", "title", "snippet")


def search_recrawled(spark, folder):
    """Bounded search where postings outlive the texts they came from."""
    index = _once(spark, folder, "recrawled-index", lambda: _recrawled(spark, folder).publish(spark))
    return _rounded(plans.search_batch(index, _benchmark(spark, folder), bounded=True, use_tf=True))


def _grown(spark, folder) -> SearchIndex:
    """The three fetches published one by one."""
    def make():
        path = new_path(spark, "grown-index")
        index = _recrawled(spark, folder)
        for number in range(3):
            index.grow(spark, number, path)
        return grown_index.open_grown(spark, path)
    return _once(spark, folder, "grown-index", make)


def grown_postings(spark, folder):
    return _grown(spark, folder).postings.select("term", "doc_id", "tf")


def grown_terms(spark, folder):
    return _grown(spark, folder).term_stats.select("term", "df")


def grown_documents(spark, folder):
    return _grown(spark, folder).documents.select("doc_id", "url", "doc_length", "title", "snippet")


def grown_stats(spark, folder):
    index = _grown(spark, folder)
    return spark.createDataFrame([(index.n_docs, round(index.avgdl, 6))], "n_docs long, avgdl double")


def search_grown(spark, folder):
    """Bounded search over segments."""
    return _rounded(plans.search_batch(_grown(spark, folder), _benchmark(spark, folder), bounded=True, use_tf=True))


def streamed_postings(spark, folder):
    return _streamed(spark, folder).postings(spark).select("term", "doc_id")


def streamed_documents(spark, folder):
    return _streamed(spark, folder).documents(spark).select("doc_id", "url", "doc_length", "title", "snippet")


def search_streamed(spark, folder):
    """Search over the version published from the streamed batches."""
    index = _once(
        spark, folder, "published", lambda: _streamed(spark, folder).publish(spark)
    )
    return _rounded(plans.search_batch(index, _benchmark(spark, folder)))


def not_indexed(spark, folder):
    """Fetched pages that the index lacks."""
    manifest = warc.read_manifest(spark, _crawl(spark, folder))
    state = docs.document_state(docs.crawled_rows(manifest, seq=2))
    return docs.not_indexed(state, _indexed(spark, folder))


def _handed_over(spark, folder) -> DataFrame:
    """Archived pages handed to the index, with hand-offs that fail: a read goes wrong at the first
    try for a seventh of the pages, at the first two for an eleventh, and always for a thirteenth."""
    def make():
        def deliver(items, attempt):
            failures = (
                F.when(F.col("doc_id") % 13 == 0, 99).when(F.col("doc_id") % 11 == 0, 2)
                .when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
            )
            spoilt = items.withColumn(
                "length", F.when(failures >= attempt, F.col("length") - 1).otherwise(F.col("length")))
            return warc.read_records(spoilt, _archive(spark, folder)).select("doc_id", "reason")
        return handoff.hand_over(_manifest(spark, folder), deliver, new_path(spark, "hand-over"))
    return _once(spark, folder, "handed-over", make)


def hand_over(spark, folder):
    return handoff.hand_over_state(_handed_over(spark, folder))


def hand_over_attempts(spark, folder):
    return _handed_over(spark, folder)


def dead_letters(spark, folder):
    """What the documents table says after hand-offs that failed for good."""
    crawled = docs.crawled_rows(_manifest(spark, folder), seq=2)
    dead = handoff.dead_letter_rows(handoff.hand_over_state(_handed_over(spark, folder)), seq=3)
    return docs.document_state(crawled.unionByName(dead)).select("doc_id", "url", "status")


def index_from_ids(spark, folder):
    """Queue items name ids; positions are looked up, records read and indexed."""
    state = docs.document_state(docs.crawled_rows(warc.read_manifest(spark, _crawl(spark, folder)), seq=2))
    items = _documents(spark, folder).select(F.concat_ws(" ", F.lit(" "), "doc_id", "source").alias("item"))
    wanted = docs.documents_by_ids(state, frontier.parse_doc_ids(items))
    records = warc.read_records(wanted, _crawl(spark, folder)).filter(F.col("reason").isNull())
    return extract.index_metadata(extract.extract_pages(records.select("doc_id", "url", F.col("body").alias("html"))))


def index_rejects(spark, folder):
    """The manifest spoiled in three ways, and as it is."""
    manifest = _manifest(spark, folder)
    items = (
        manifest
        .unionByName(manifest.withColumn("length", F.col("length") - 1))
        .unionByName(manifest.withColumn("offset", F.col("offset") + F.lit(10 ** 15)))
        .unionByName(manifest.withColumn("file_path", F.lit("absent.warc.gz")))
    )
    read = warc.read_records(items, _archive(spark, folder))
    return read.filter(F.col("reason").isNotNull()).select("doc_id", "reason")


# --- declared extensions -----------------------------------------------------


def exact_duplicates(spark, folder):
    return indexing.exact_duplicates(_documents(spark, folder))


def fold_and_stop(spark, folder):
    words = spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")
    return indexing.folded_terms(_documents(spark, folder), words)


def fold_marked(spark, folder):
    """The documents spelt with marks, composed and combining, and in capitals: the terms of the plain texts."""
    marked = F.replace(F.translate("text", "aeioucsz", "ảệīőűčșž"), F.lit("n"), F.lit("n\u0303"))
    capital = F.replace(F.translate(F.upper("text"), "AEOC", "ẤỀỎĆ"), F.lit("T"), F.lit("T\u0323\u0301"))
    documents = _documents(spark, folder)
    both = documents.withColumn("text", marked).unionByName(
        documents.withColumns({"doc_id": -F.col("doc_id") - 1, "text": capital}))
    words = spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")
    return indexing.folded_terms(both, words)


def highlighted(spark, folder):
    queries = _benchmark(spark, folder)
    results = stored(_page_results(spark, folder), "results")
    return highlight.highlighted(
        results, queries, pages_index(spark, folder).documents, fits=fits_broadcast(results)
    )


QUERIES = {
    "scan_documents": scan_documents,
    "warc_point_read": warc_point_read,
    "warc_payload": warc_payload,
    "warc_write_manifest": warc_write_manifest,
    "warc_scan": warc_scan,
    "build_postings": build_postings,
    "posting_lookup": posting_lookup,
    "index_metadata": index_metadata,
    "seed_frontier": seed_frontier,
    "search_json": search_json,
    "valid_urls": valid_urls,
    "file_basename": file_basename,
    "parse_doc_ids": parse_doc_ids,
    "clean_queue": clean_queue,
    "queue_replies": queue_replies,
    "nonempty_pages": nonempty_pages,
    "docs_by_ids": docs_by_ids,
    "nonblank_queries": nonblank_queries,
    "docs_by_status": docs_by_status,
    "first_documents": first_documents,
    "candidates": candidates,
    "candidate_lengths": candidate_lengths,
    "topk_metadata": topk_metadata,
    "accept_urls": accept_urls,
    "new_postings": new_postings,
    "corpus_stats": corpus_stats,
    "doc_lengths": doc_lengths,
    "doc_terms": doc_terms,
    "posting_strings": posting_strings,
    "posting_string_parts": posting_string_parts,
    "term_df": term_df,
    "bm25_contrib": bm25_contrib,
    "bm25_scores": bm25_scores,
    "candidate_set": candidate_set,
    "result_counts": result_counts,
    "document_state": document_state,
    "state_from_segments": state_from_segments,
    "state_of_version": state_of_version,
    "state_of_ids": state_of_ids,
    "search_topk": search_topk,
    "search_failed_downloads": search_failed_downloads,
    "search_deep": search_deep,
    "search_documents": search_documents,
    "search_batch": search_batch,
    "search_batch_exhaustive": search_batch_exhaustive,
    "search_batch_bounded": search_batch_bounded,
    "search_topk_tf": search_topk_tf,
    "merge_postings": merge_postings,
    "tokenize_documents": tokenize_documents,
    "tokenize_queries": tokenize_queries,
    "page_text": page_text,
    "page_titles": page_titles,
    "snippets": snippets,
    "term_idf": term_idf,
    "parse_postings": parse_postings,
    "parse_posting_parts": parse_posting_parts,
    "warc_dates": warc_dates,
    "warc_headers": warc_headers,
    "stream_accept_urls": stream_accept_urls,
    "stream_index": streamed_postings,
    "stream_documents": streamed_documents,
    "search_streamed": search_streamed,
    "recrawled_postings": recrawled_postings,
    "recrawled_documents": recrawled_documents,
    "search_recrawled": search_recrawled,
    "grown_postings": grown_postings,
    "grown_terms": grown_terms,
    "grown_documents": grown_documents,
    "grown_stats": grown_stats,
    "search_grown": search_grown,
    "not_indexed": not_indexed,
    "hand_over": hand_over,
    "hand_over_attempts": hand_over_attempts,
    "dead_letters": dead_letters,
    "index_from_ids": index_from_ids,
    "index_rejects": index_rejects,
    "exact_duplicates": exact_duplicates,
    "fold_and_stop": fold_and_stop,
    "fold_marked": fold_marked,
    "highlight": highlighted,
}
