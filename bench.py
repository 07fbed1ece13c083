"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from harrow import schemas  # noqa: E402
from harrow.operators import extract, indexing  # noqa: E402
from harrow.plans import search as plans  # noqa: E402
from harrow.session import build_session, new_path  # noqa: E402
from harrow.sources import warc  # noqa: E402
from harrow.sources.index_store import build_index  # noqa: E402
from harrow.sources.tables import read_table  # noqa: E402
from harrow.streaming.index import StreamedIndex, index_stream  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BATCHES = 10


def finish(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="harrow-bench-")
    spark = build_session("harrow-bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"{scratch}/shared",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    notes: dict[str, float] = {}

    def timed(name, job):
        start = time.perf_counter()
        result = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    documents = read_table(spark, FOLDER, "documents")
    pages = read_table(spark, FOLDER, "pages").withColumnRenamed("page_id", "doc_id")
    texts = documents.select(
        "doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"),
        F.lit("").alias("title"), "text",
    )
    conversations = read_table(spark, FOLDER, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("q")
    )
    sentences = conversations.select("qid", F.posexplode(F.split("q", r"[.\n]+")).alias("n", "q")).filter("q <> ''")
    sentences = sentences.select((F.col("qid") * 1000 + F.col("n")).alias("qid"), "q").orderBy("qid").limit(10_000)
    finish(indexing.doc_tokens(documents.limit(100)))  # start the engine before the first timing

    timed("tokenize_documents", lambda: finish(indexing.doc_tokens(documents)))
    timed("exact_duplicates", lambda: finish(indexing.exact_duplicates(documents)))
    timed("extract_pages", lambda: finish(extract.extract_pages(pages)))
    index = timed("index_build_documents", lambda: build_index(texts))
    timed("index_build_pages", lambda: build_index(extract.extract_pages(pages)))

    size = documents.agg(F.max("doc_id")).first()[0] + 1
    grown = new_path(spark, "grown")
    part = F.floor(F.col("doc_id") * BATCHES / size)
    timed("index_grow_10_batches", lambda: [
        grown_index.grow(texts.filter(part == number), grown, batch=number) for number in range(BATCHES)])

    archive = new_path(spark, "warc")
    timed("warc_write", lambda: warc.write_archive(pages.repartition(int(CPUS)), archive))
    manifest = warc.read_manifest(spark, archive)
    timed("warc_read", lambda: finish(warc.read_records(manifest, archive)))
    timed("warc_scan", lambda: finish(warc.scan_archive(spark, archive)))

    queue = new_path(spark, "queue")
    manifest.repartition(BATCHES).write.parquet(queue)
    stream = spark.readStream.schema(schemas.MANIFEST).option("maxFilesPerTrigger", 1).parquet(queue)
    timed("index_stream_10_batches", lambda: index_stream(
        stream, archive, StreamedIndex(new_path(spark, "streamed")), new_path(spark, "stream")
    ).awaitTermination())

    timed("search_one_cold", lambda: plans.search(index, "the and tion tion").collect())
    timed("search_one", lambda: plans.search(index, "the and tion tion").collect())
    sizes = {"search_100": sentences.limit(100), "search_10000": sentences, "search_conversations": conversations}
    for name, table in sizes.items():
        timed(name, lambda: finish(plans.search_batch(index, table)))

    n_docs, n_tokens = index.documents.agg(F.count("doc_id"), F.sum("doc_length")).first()
    build = seconds["index_build_documents"]
    notes["index_docs_per_sec"] = round(n_docs / build, 1)
    notes["index_tokens_per_sec"] = round(n_tokens / build, 1)
    for name, table in sizes.items():
        notes[f"{name}_queries_per_sec"] = round(table.count() / seconds[name], 1)
    notes["seconds_per_micro_batch"] = round(seconds["index_stream_10_batches"] / BATCHES, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "rates": notes,
    }))


if __name__ == "__main__":
    main()
