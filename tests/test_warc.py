import gzip
import io
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harrow.functions import warc_format as wf
from harrow.session import new_path
from harrow.sources import warc
from harrow.sources.tables import read_table


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, url string, html string")


def archive(spark, pages, **options):
    path = new_path(spark, "warc")
    warc.write_archive(pages, path, **options)
    return path, warc.read_manifest(spark, path)


def test_gunzip():
    text = "mixed “bytes” \0 and\r\n lines".encode() * 7
    packed = gzip.compress(text)
    assert warc.gunzip(packed) == (text, None)
    assert warc.gunzip(packed + b"next member") == (text, None)
    assert warc.gunzip(gzip.compress(b"")) == (b"", None)
    for broken in (packed[:-3], packed[4:], packed[:20] + b"?" + packed[21:], b""):
        assert warc.gunzip(broken) == (None, "bad gzip")
    assert warc.gunzip(packed, most=len(text)) == (text, None)
    assert warc.gunzip(packed, most=len(text) - 1) == (None, "too large")


def test_payload():
    assert warc.payload(b"h: 1\r\n\r\nbody\r\n\r\n") == (b"body\r\n\r\n", None)
    assert warc.payload(b"no end") == (None, "no header end")


def test_single_record(spark):
    html = "<title>Größe</title><p>line one\r\n\r\nline two"
    path, manifest = archive(spark, pages_of(spark, [(31, "https://host.example/a?b=1", html)]).coalesce(1))
    row = manifest.first()
    assert (row["doc_id"], row["offset"]) == (31, 0)
    with open(f"{path}/{row['file_path']}", "rb") as f:
        data = f.read()
    assert len(data) == row["length"]
    head, body = gzip.decompress(data).split(b"\r\n\r\n", 1)
    assert body == html.encode() + b"\r\n\r\n"
    lines = head.decode().split("\r\n")
    assert lines[:3] == ["WARC/1.0", "WARC-Type: response", "WARC-Target-URI: https://host.example/a?b=1"]
    assert lines[-1] == f"Content-Length: {len(html.encode())}"
    assert warc.read_records(manifest, path).first()["body"] == html + "\r\n\r\n"


def test_round_trip_and_splits(spark, folder):
    pages = read_table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id")
    path, manifest = archive(spark, pages.repartition(3), roll_bytes=20_000)
    assert manifest.select("file_path").distinct().count() > 3
    same = warc.read_records(manifest, path).join(pages, "doc_id").filter(
        F.col("body") == F.concat("html", F.lit(wf.BLANK_LINE))
    )
    assert same.count() == pages.count()
    for split_bytes in (700, 5_000, warc.SPLIT_BYTES):
        scan = warc.scan_archive(spark, path, split_bytes)
        assert scan.count() == pages.count()
        assert scan.join(manifest, ["file_path", "offset", "length"]).count() == pages.count()


def test_byte_ranges_tile_files(spark, folder):
    pages = read_table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id")
    path, manifest = archive(spark, pages.repartition(2))
    spans = {}
    for r in manifest.collect():
        spans.setdefault(r["file_path"], []).append((r["offset"], r["length"]))
    for name, parts in spans.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == os.path.getsize(f"{path}/{name}")


def test_append_and_unpublished_files(spark):
    path, _ = archive(spark, pages_of(spark, [(1, "http://a.example", "one")]))
    warc.write_archive(pages_of(spark, [(2, "http://b.example", "two")]), path)
    with open(f"{path}/part-lost.warc.gz", "wb") as f:  # a lost attempt
        f.write(gzip.compress(b"WARC/1.0\r\nx: y\r\n\r\nlost"))
    assert {r["doc_id"] for r in warc.read_manifest(spark, path).collect()} == {1, 2}
    assert {r["body"].strip() for r in warc.scan_archive(spark, path).collect()} == {"one", "two"}


def test_rejects(spark):
    path, manifest = archive(spark, pages_of(spark, [(1, "http://a.example", "text")]).coalesce(1))
    row = manifest.first()
    with open(f"{path}/odd.warc.gz", "wb") as f:
        f.write(gzip.compress(b"no blank line"))
    size = os.path.getsize(f"{path}/odd.warc.gz")
    items = spark.createDataFrame([
        (1, "u", row["file_path"], 0, row["length"]),
        (2, "u", row["file_path"], 0, row["length"] - 1),
        (3, "u", row["file_path"], 5, row["length"]),
        (4, "u", "absent", 0, 5),
        (5, "u", None, None, None),
        (6, "u", "odd.warc.gz", 0, size),
        (7, "u", row["file_path"], -1, 5),
    ], manifest.schema)
    got = {r["doc_id"]: (r["body"], r["reason"]) for r in warc.read_records(items, path).collect()}
    assert got == {
        1: ("text\r\n\r\n", None), 2: (None, "bad gzip"), 3: (None, "short read"),
        4: (None, "no file"), 5: (None, "no file"), 6: (None, "no header end"), 7: (None, "no position"),
    }


def record(n, size=0):
    head = f"WARC/1.0\r\nWARC-Target-URI: u{n}\r\n\r\n".encode()
    return gzip.compress(head + f"body{n}".encode() + os.urandom(size))


def test_scan_reports_what_is_no_record(spark, tmp_path):
    parts = [record(1), b"\x1f\x8b\x08garbage", record(2), gzip.compress(b"other"), gzip.compress(b"WARC/1.0 cut"), record(3, 900), record(4)[:-5]]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    got = warc.scan_archive(spark, str(tmp_path), max_record_bytes=500).orderBy("offset").collect()
    assert [(r["headers"] and r["headers"]["WARC-Target-URI"], r["reason"]) for r in got] == [
        ("u1", None), (None, "bad gzip"), ("u2", None), (None, "no record"), (None, "no header end"), (None, "too large"), (None, "bad gzip")]
    assert [r["offset"] for r in got] == [sum(map(len, parts[:n])) for n in range(len(parts))]
    whole = warc.scan_archive(spark, str(tmp_path)).filter("reason IS NULL")
    assert whole.count() == 3


def test_splits_are_planned_in_tasks(spark, tmp_path, monkeypatch):
    sizes = {"a.warc.gz": 0, "b.warc.gz": 1, "c.warc.gz": 100, "d.warc.gz": 101, "no": 50}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(b"x" * size)
    monkeypatch.setattr(warc, "LISTED_ROWS", 2)
    got = [tuple(r) for r in warc.archive_splits(spark, str(tmp_path), 50).orderBy("file_path", "start").collect()]
    assert got == [("b.warc.gz", 0, 1), ("c.warc.gz", 0, 50), ("c.warc.gz", 50, 100), ("d.warc.gz", 0, 50),
                   ("d.warc.gz", 50, 100), ("d.warc.gz", 100, 101)]
    assert warc.scan_archive(spark, str(tmp_path / "absent")).count() == 0

    path, manifest = archive(spark, pages_of(spark, [(n, "http://a.example", "x" * n) for n in range(40)]).repartition(4))
    warc.write_archive(pages_of(spark, []), path)  # a commit without files
    monkeypatch.setattr(warc, "list_files", None)  # published files are not listed
    splits = warc.archive_splits(spark, path, 100)
    spans = {r["file_path"]: r["stop"] for r in splits.groupBy("file_path").agg(F.max("stop").alias("stop")).collect()}
    assert spans == {r["file_path"]: r["n"] for r in manifest.groupBy("file_path").agg(F.sum("length").alias("n")).collect()}
    assert warc.scan_archive(spark, path, 100).join(manifest, ["file_path", "offset", "length"]).count() == 40


def test_a_lost_file_fails_the_scan(spark):
    path, manifest = archive(spark, pages_of(spark, [(1, "http://a.example", "x")]).coalesce(1))
    os.rename(f"{path}/{manifest.first()['file_path']}", f"{path}/elsewhere")
    with pytest.raises(PySparkException):
        warc.scan_archive(spark, path).count()


class Counted:
    def __init__(self, data):
        self.file, self.read_bytes = io.BytesIO(data), 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, size):
        data = self.file.read(size)
        self.read_bytes += len(data)
        return data


def test_a_scan_reads_the_file_once(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 4096)
    data = b"".join(record(n, 200 * (n % 9)) for n in range(600))
    source = Counted(data)
    found = list(warc._records(source, warc.FileSplit("x", 0, len(data)), None))
    assert len(found) == 600 and source.read_bytes == len(data)
    total = records = 0
    for start in range(0, len(data), 60_000):
        source = Counted(data)
        records += len(list(warc._records(source, warc.FileSplit("x", start, start + 60_000), None)))
        total += source.read_bytes
    assert records == 600 and total <= 1.1 * len(data)


def test_record_date(spark):
    when = spark.sql("SELECT timestamp'2024-02-03 04:05:06' AS t")
    assert when.select(wf.record_date(F.col("t")).alias("d")).first()["d"] == "2024-02-03T04:05:06Z"
