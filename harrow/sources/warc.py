"""WARC archives: a folder of files made of independently gzipped records.

* `write_archive`  pages -> archive plus manifest `(doc_id, url, file_path, offset, length)`
* `read_manifest`  manifest rows of every finished write
* `read_records`   positioned reads for a manifest, whole bodies or a reject reason
* `scan_archive`   full scan without a manifest, large files split between tasks; a
  member that gives no record comes back as a row with the reason

A task writes files of its own and reports them when done; the driver publishes
reported files only, so a lost or repeated attempt leaves unlisted files behind
and never a row.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from harrow import schemas
from harrow.functions import warc_format as wf
from harrow.session import hinted, stored
from harrow.sources.storage import list_files, located

# Fixed values.
ROLL_BYTES = 1024 * 1024 * 1024
GZIP = 31  # zlib window setting for the gzip container
MAGIC = b"\x1f\x8b\x08"
HEADER_END = b"\r\n\r\n"

SPLIT_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
SLICE_ROWS = 100  # pages of a batch that are Python objects at once
READ_BYTES = 1024 * 1024
FEED_BYTES = 64 * 1024
LISTED_ROWS = 10_000
MOST_TASKS = 100_000

SCAN_SCHEMA = (
    "file_path string, offset long, length long, headers map<string,string>, body string, reason string"
)
_SCAN_ARROW = pa.schema([
    ("file_path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("reason", pa.string()),
])
_MANIFEST_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("url", pa.string()), ("file_path", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()),
])
_RECORD_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("url", pa.string()), ("body", pa.string()), ("reason", pa.string()),
])


def gunzip(data: bytes, most: int | None = None) -> tuple[bytes | None, str | None]:
    """One member's content, or the reason it is refused; `most`: bytes of the largest one taken."""
    member = zlib.decompressobj(GZIP)
    try:
        content = member.decompress(data, most + 1 if most else 0)
    except zlib.error:
        return None, "bad gzip"
    if most and len(content) > most:
        return None, "too large"
    return (content, None) if member.eof else (None, "bad gzip")


def payload(content: bytes) -> tuple[bytes | None, str | None]:
    """Everything after the first blank line."""
    cut = content.find(HEADER_END)
    return (None, "no header end") if cut < 0 else (content[cut + len(HEADER_END):], None)


# --- writing -----------------------------------------------------------------


@dataclass
class WrittenFiles(WriterCommitMessage):
    manifest: str | None
    files: list[str]


class _ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll_bytes: int):
        self.path = path
        self.roll_bytes = roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        fs, root = located(self.path)
        fs.create_dir(f"{root}/manifest", recursive=True)
        attempt = uuid.uuid4().hex
        files: list[str] = []
        out = manifest = None
        for batch in iterator:
            rows = []
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(start, SLICE_ROWS).to_pylist():
                    if out is None or out.tell() >= self.roll_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{attempt}-{len(files):05d}.warc.gz")
                        out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
                    packer = zlib.compressobj(wbits=GZIP)
                    member = packer.compress(row["record"]) + packer.flush()
                    rows.append({
                        "doc_id": row["doc_id"], "url": row["url"], "file_path": files[-1],
                        "offset": out.tell(), "length": len(member),
                    })
                    out.write(member)
            if rows:
                if manifest is None:
                    manifest = pq.ParquetWriter(
                        f"{root}/manifest/part-{attempt}.parquet", _MANIFEST_ARROW, filesystem=fs
                    )
                manifest.write_table(pa.Table.from_pylist(rows, _MANIFEST_ARROW))
        if out is None:
            return WrittenFiles(None, [])
        out.close()
        manifest.close()
        return WrittenFiles(f"part-{attempt}.parquet", files)

    def commit(self, messages) -> None:
        fs, root = located(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        lines = "".join(
            json.dumps({"manifest": m.manifest, "files": m.files}) + "\n"
            for m in messages if m is not None and m.manifest
        )
        with fs.open_output_stream(f"{root}/commits/{uuid.uuid4().hex}.json") as out:
            out.write(lines.encode())

    def abort(self, messages) -> None:
        """Unpublished files are never read; nothing to undo."""


# --- scanning ----------------------------------------------------------------


@dataclass
class FileSplit(InputPartition):
    name: str
    start: int
    stop: int


class _Forward:
    """A file read once from a place on, with the bytes that are still needed."""

    def __init__(self, source, at: int):
        source.seek(at)
        self.source = source
        self.held = b""
        self.base = at  # file offset of the first byte held
        self.pos = 0

    @property
    def at(self) -> int:
        return self.base + self.pos

    def more(self) -> bool:
        data = self.source.read(READ_BYTES)
        self.held = self.held[self.pos:] + data
        self.base += self.pos
        self.pos = 0
        return bool(data)

    def to_magic(self, stop: int) -> bool:
        """Move to the next possible member that starts before `stop`."""
        while self.at < stop:
            found = self.held.find(MAGIC, self.pos)
            if found >= 0:
                self.pos = found
                return self.at < stop
            self.pos = max(self.pos, len(self.held) - len(MAGIC) + 1)
            if not self.more():
                return False
        return False

    def member(self, most: int | None) -> tuple[int | None, bytes | None]:
        """`(length, content)` of the member at the place; content None if over the limit."""
        inflater = zlib.decompressobj(GZIP)
        kept: list[bytes] = []
        fed = inflated = 0
        try:
            while not inflater.eof:
                pending = inflater.unconsumed_tail
                if not pending:
                    if self.pos + fed == len(self.held) and not self.more():
                        return None, None
                    pending = self.held[self.pos + fed:self.pos + fed + FEED_BYTES]
                    fed += len(pending)
                piece = inflater.decompress(pending, READ_BYTES)
                inflated += len(piece)
                if most is None or inflated <= most:
                    kept.append(piece)
                else:
                    kept.clear()
        except zlib.error:
            return None, None
        length = fed - len(inflater.unused_data)
        return length, b"".join(kept) if most is None or inflated <= most else None


def _records(source, split: FileSplit, most: int | None):
    """`(offset, length, head, body, reason)` of the members starting inside a split.

    The file is read forward once. A split may open in the middle of a member: until
    the first record, positions that do not inflate to one are stepped over, and so
    are those inside damage, which is reported where it starts.
    """
    forward = _Forward(source, split.start)
    at_start = split.start == 0  # known to be where a member begins
    while forward.to_magic(split.stop):
        found = forward.at
        length, content = forward.member(most)
        known, at_start = at_start, length is not None
        if length is None or (content is not None and not content.startswith(b"WARC/")):
            if known:
                yield found, length, None, None, "bad gzip" if length is None else "no record"
            at_start = known and length is not None
            forward.pos += length if at_start else 1
            continue
        forward.pos += length
        if content is None:
            yield found, length, None, None, "too large"
            continue
        cut = content.find(HEADER_END)
        if cut < 0:
            yield found, length, None, None, "no header end"
        else:
            yield found, length, content[:cut], content[cut + len(HEADER_END):], None


def _headers(raw: bytes) -> list[tuple[str, str]]:
    fields = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip()] = value.strip()
    return list(fields.items())


def _split_batches(fs, root: str, split: FileSplit, most: int | None) -> Iterator[pa.RecordBatch]:
    with fs.open_input_file(f"{root}/{split.name}") as source:
        rows, held = [], 0
        for offset, length, head, body, reason in _records(source, split, most):
            rows.append({
                "file_path": split.name, "offset": offset, "length": length,
                "headers": None if head is None else _headers(head),
                "body": None if body is None else body.decode("utf-8", "replace"), "reason": reason,
            })
            held += len(body or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _SCAN_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCAN_ARROW)


class _ArchiveReader(DataSourceReader):
    """Plans its splits on the driver; `scan_archive` does so in tasks, for archives of very many files."""

    def __init__(self, path: str, split_bytes: int, most: int | None):
        self.path = path
        self.split_bytes = split_bytes
        self.most = most

    def partitions(self):
        files = list_files(self.path, ".warc.gz")
        fs, root = located(self.path)
        commits = list_files(f"{self.path}/commits", ".json")
        if commits:  # an archive written here: published files only
            published: set[str] = set()
            for name, _ in commits:
                with fs.open_input_stream(f"{root}/commits/{name}") as source:
                    for line in source.read().decode().splitlines():
                        published.update(json.loads(line)["files"])
            files = [f for f in files if f[0] in published]
        splits = [
            FileSplit(name, start, min(start + self.split_bytes, size))
            for name, size in files
            for start in range(0, size, self.split_bytes)
        ]
        return splits or [FileSplit("", 0, 0)]

    def read(self, split: FileSplit):
        if split.name:
            yield from _split_batches(*located(self.path), split, self.most)


class WarcDataSource(DataSource):
    """`spark.read.format("warc").load(folder)` and the matching append writer."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCAN_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("maxrecordbytes")
        return _ArchiveReader(
            self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)), int(most) if most else None
        )

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are append-only")
        return _ArchiveWriter(
            self.options["path"], int(self.options.get("rollbytes", ROLL_BYTES))
        )


# --- jobs --------------------------------------------------------------------


def record_frame(pages: DataFrame) -> DataFrame:
    """`(doc_id, url, html)` -> `(doc_id, url, record)`, built on the JVM side."""
    return pages.select(
        "doc_id", "url",
        wf.record(
            F.col("url"), F.col("html"), wf.record_date(F.current_timestamp()), F.uuid()
        ).alias("record"),
    )


def write_archive(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES) -> None:
    """Append pages to an archive; every input partition writes its own files."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    (
        record_frame(pages).write.format("warc").mode("append")
        .option("rollBytes", roll_bytes).save(path)
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of finished writes; those of unfinished ones are left out by file name."""
    finished = spark.read.schema("manifest string").json(f"{path}/commits")
    if finished.isEmpty():
        return spark.createDataFrame([], schemas.MANIFEST)
    rows = spark.read.schema(schemas.MANIFEST).parquet(f"{path}/manifest")
    named = rows.withColumn("manifest", F.col("_metadata.file_name"))
    names = hinted(finished.filter("manifest IS NOT NULL"))
    return named.join(names, "manifest", "left_semi").drop("manifest")


def _listing(base: str):
    """Files right under a folder, listed by the one task that gets the row."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list_files(base, ".warc.gz")
                for start in range(0, len(found), LISTED_ROWS):
                    yield _sized(found[start:start + LISTED_ROWS])
    return listed


def _sizes(base: str):
    """The sizes of files known by name; one that is gone has none."""
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(base)
        for batch in batches:
            names = batch.column(0).to_pylist()
            infos = fs.get_file_info([f"{root}/{name}" for name in names])
            yield _sized([(name, info.size) for name, info in zip(names, infos)])
    return sized


def _sized(files: list[tuple[str, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name for name, _ in files], pa.string()), pa.array([size for _, size in files], pa.int64())],
        names=["file_path", "bytes"])


def archive_splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`(file_path, start, stop)`: what is to be scanned, as rows that no driver holds.

    Of an archive written here only published files count: their names come from the commits and their
    sizes are asked for in tasks. Any other folder is listed by one task. A published file that
    is gone makes a scan fail when it is read.
    """
    fs, root = located(f"{path}/commits")
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        names = spark.read.schema("files array<string>").json(f"{path}/commits").select(
            F.explode("files").alias("file_path")).distinct()
        files = names.mapInArrow(_sizes(path), "file_path string, bytes long")
    else:
        files = spark.range(0, 1, 1, 1).mapInArrow(_listing(path), "file_path string, bytes long")
    last = F.greatest(F.coalesce("bytes", F.lit(1)) - 1, F.lit(0))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long")))
    return files.filter("bytes IS NULL OR bytes > 0").withColumn("start", starts).select(
        "file_path", "start",
        F.least(F.col("start") + split_bytes, F.coalesce("bytes", F.lit(split_bytes))).alias("stop"))


def _split_reader(base: str, most: int | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(base)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _split_batches(fs, root, FileSplit(row["file_path"], row["start"], row["stop"]), most)
    return read


def scan_archive(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, max_record_bytes: int | None = None
) -> DataFrame:
    """Every record of the archive; `max_record_bytes` refuses larger ones with a reason.

    The splits are fixed when this is called: a table of them is written, counted (one number
    comes to the driver) and dealt evenly, one split to a task up to `MOST_TASKS`.
    """
    splits = stored(archive_splits(spark, path, split_bytes), "splits")
    tasks = min(MOST_TASKS, max(1, splits.count()))
    return splits.repartition(tasks).mapInArrow(_split_reader(path, max_record_bytes), SCAN_SCHEMA)


def _range_reader(base: str, inflate: bool, most: int | None = None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(base)
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                if row["file_path"] != name:
                    name = row["file_path"]
                    if source is not None:
                        source.close()
                    try:
                        source = fs.open_input_file(f"{root}/{name}") if name else None
                    except OSError:
                        source = None
                body, reason = _read_range(source, row["offset"], row["length"])
                if reason is None and inflate:
                    body, reason = gunzip(body, most)
                    if reason is None:
                        body, reason = payload(body)
                    if reason is None:
                        body = body.decode("utf-8", "replace")
                rows.append({
                    "doc_id": row["doc_id"], "url": row["url"], "body": body, "reason": reason,
                })
                held += len(body or "")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = _RECORD_ARROW if inflate else _RECORD_ARROW.set(2, pa.field("body", pa.binary()))
    return read


def _read_range(source, offset, length) -> tuple[bytes | None, str | None]:
    if source is None:
        return None, "no file"
    if offset is None or length is None or offset < 0 or length < 0:
        return None, "no position"
    size = source.size()
    if offset + length > size:
        return None, "short read"
    source.seek(offset)
    data = source.read(length)
    return (data, None) if len(data) == length else (None, "short read")


def _placed(manifest: DataFrame) -> DataFrame:
    """Rows grouped by stretches of a file and sorted, so that reads run forward.

    The stretch keeps one huge file from becoming one task.
    """
    stretch = F.floor(F.col("offset") / F.lit(SPLIT_BYTES))
    return (
        manifest.select("doc_id", "url", "file_path", "offset", "length")
        .repartition("file_path", stretch).sortWithinPartitions("file_path", "offset")
    )


def read_ranges(manifest: DataFrame, base: str) -> DataFrame:
    """`(doc_id, url, body, reason)`: raw bytes at each position, or why there are none."""
    return _placed(manifest).mapInArrow(
        _range_reader(base, False), "doc_id long, url string, body binary, reason string"
    )


def read_records(manifest: DataFrame, base: str, max_record_bytes: int | None = None) -> DataFrame:
    """`(doc_id, url, body, reason)`: record bodies; bad items get a reason and no body."""
    return _placed(manifest).mapInArrow(
        _range_reader(base, True, max_record_bytes), "doc_id long, url string, body string, reason string"
    )
