from pyspark.sql import functions as F

from harrow.operators import extract, indexing
from harrow.plans import search as plans
from harrow.session import new_path
from harrow.sources import index_store, warc
from harrow.sources.index_store import build_index
from harrow.sources.tables import read_table
from harrow.streaming import crawl
from harrow.streaming.index import StreamedIndex, index_batch, index_stream


def queue_of(spark, frame, files):
    path = new_path(spark, "queue")
    frame.repartition(files).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def frontier(spark):
    rows = [(i, f"http://host.example/{i % 7}") for i in range(30)] + [(99, "bad"), (100, None)]
    return spark.createDataFrame(rows, "seq long, url string")


def test_accepted_once_over_batches(spark):
    known = spark.createDataFrame([(500, "http://host.example/3", "crawled")], "doc_id long, url string, status string")
    table, checkpoint = new_path(spark, "accepted"), new_path(spark, "stream")
    stream = queue_of(spark, frontier(spark), 5)
    crawl.accept_stream(stream, table, checkpoint, known).awaitTermination()
    rows = spark.read.schema(crawl.ACCEPTED).parquet(table)
    assert sorted(r["url"] for r in rows.collect()) == sorted(f"http://host.example/{i}" for i in range(7))
    assert rows.filter("status = 'processing'").count() == 6
    crawl.accept_stream(stream, table, checkpoint, known).awaitTermination()  # nothing new
    assert spark.read.schema(crawl.ACCEPTED).parquet(table).count() == 7


def archived(spark, folder):
    pages = read_table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id")
    path = new_path(spark, "warc")
    warc.write_archive(pages, path)
    return pages, path, warc.read_manifest(spark, path)


def rows_of(frame):
    return sorted(map(tuple, frame.select("term", "doc_id", "tf").collect()))


def test_stream_equals_batch_and_replay_changes_nothing(spark, folder):
    pages, path, manifest = archived(spark, folder)
    index = StreamedIndex(new_path(spark, "streamed"))
    index_stream(queue_of(spark, manifest, 3), path, index, new_path(spark, "stream")).awaitTermination()
    extracted = extract.extract_pages(pages)
    assert rows_of(index.postings(spark)) == rows_of(indexing.count_terms(extracted))

    last = index.all_postings(spark).agg(F.max("batch_id")).first()[0]
    assert last >= 2
    ids = index.doc_log(spark).filter(F.col("seq") == last).select("doc_id")
    index_batch(manifest.join(ids, "doc_id"), path, index, last)
    assert rows_of(index.postings(spark)) == rows_of(indexing.count_terms(extracted))

    index_batch(manifest, path, index, last + 1)  # everything handed over again
    assert rows_of(index.postings(spark)) == rows_of(indexing.count_terms(extracted))

    asked = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    batch, streamed = (
        sorted(map(tuple, plans.search_batch(i, asked).collect()))
        for i in (build_index(extracted), index.publish(spark))
    )
    assert batch == streamed


def test_changed_content_adds_postings(spark):
    index = StreamedIndex(new_path(spark, "streamed"))
    index.prepare(spark)
    path = new_path(spark, "warc")
    for batch, html in enumerate(["<p>first words</p>", "<p>second words</p>"]):
        page = spark.createDataFrame([(1, "http://a.example", html)], "doc_id long, url string, html string")
        warc.write_archive(page, path)
        known = [r["file_path"] for r in warc.read_manifest(spark, path).collect()]
        manifest = warc.read_manifest(spark, path)
        if batch:
            manifest = manifest.filter(F.col("file_path") != first)
        else:
            first = known[0]
        index_batch(manifest, path, index, batch)
    assert {r["term"] for r in index.postings(spark).collect()} == {"first", "second", "words"}
    state = index.documents(spark).collect()
    assert len(state) == 1 and state[0]["snippet"] == "second words"


def test_rejects_do_not_stop_the_stream(spark, folder):
    _, path, manifest = archived(spark, folder)
    broken = manifest.withColumn("length", F.when(F.col("doc_id") == 3, 7).otherwise(F.col("length")))
    index = StreamedIndex(new_path(spark, "streamed"))
    index_stream(queue_of(spark, broken, 2), path, index, new_path(spark, "stream")).awaitTermination()
    assert [tuple(r) for r in index.rejects(spark).collect()] == [(3, "bad gzip")]
    assert index.documents(spark).count() == manifest.count() - 1
    assert index.postings(spark).filter("doc_id = 3").count() == 0


def handed(spark, path, htmls, seqs):
    """Archive one download per html of document 1; manifest rows with their `seq`."""
    rows = None
    for html, seq in zip(htmls, seqs):
        before = {r["file_path"] for r in warc.read_manifest(spark, path).collect()} if rows is not None else set()
        warc.write_archive(spark.createDataFrame([(1, "http://a.example", html)], "doc_id long, url string, html string"), path)
        manifest = warc.read_manifest(spark, path)
        new = [r for r in manifest.collect() if r["file_path"] not in before]
        new = spark.createDataFrame(new, manifest.schema).withColumn("seq", F.lit(seq))
        rows = new if rows is None else rows.unionByName(new)
    return rows


def test_one_download_of_a_document_counts_in_a_batch(spark):
    path = new_path(spark, "warc")
    manifest = handed(spark, path, ["<p>early words words", "<p>late words", "<p>middle words"], [1, 3, 2])
    index = StreamedIndex(new_path(spark, "streamed"))
    index.prepare(spark)
    index_batch(manifest.union(manifest), path, index, 0)
    assert rows_of(index.postings(spark)) == [("late", 1, 1), ("words", 1, 1)]
    assert index.doc_log(spark).count() == 1
    assert index.documents(spark).first()["snippet"] == "late words"


def test_latest_counts_win_and_old_terms_stay(spark):
    index = StreamedIndex(new_path(spark, "streamed"))
    index.prepare(spark)
    for batch, html in enumerate(["<p>word word gone", "<p>word other", ""]):
        path = new_path(spark, "warc")
        index_batch(handed(spark, path, [html], [0]), path, index, batch)
    assert rows_of(index.postings(spark)) == [("gone", 1, 1), ("other", 1, 1), ("word", 1, 1)]
    published = index.publish(spark)
    assert published.documents.first()["doc_length"] == 0 and published.postings.count() == 3
    assert index.publish(spark).term_stats.filter("length_unknown").count() == 3


def test_terms_of_a_batch_are_counted_by_document(spark, folder, monkeypatch):
    """A task counts the terms of some documents, so many bytes of text, and not those of a whole file."""
    monkeypatch.setattr(index_store, "BUCKET_TEXT_BYTES", 1000)
    pages, path, manifest = archived(spark, folder)
    index = StreamedIndex(new_path(spark, "streamed"))
    index.prepare(spark)
    index_batch(manifest, path, index, 0)
    placed = index.all_postings(spark).select("doc_id", F.input_file_name().alias("file")).distinct()
    assert placed.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 1
    assert placed.select("file").distinct().count() > spark.sparkContext.defaultParallelism
    assert rows_of(index.postings(spark)) == rows_of(indexing.count_terms(extract.extract_pages(pages)))
