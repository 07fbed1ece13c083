"""WARC archives of pages, one gzip member per record, and their sequential reader.

Pages with equal payloads of 100 bytes or more are stored once, as the response of
the smallest page_id; the others are revisit records that refer to it. Tasks write
files of bounded size and report them; only reported files are read, so a repeated
or lost task attempt leaves no rows behind.

The reader goes through a file once: bytes are fed to one decompressor per member,
the header ends at the first blank line, the block is as long as its Content-Length
says, and both digests are recomputed. A record that breaks a rule is returned with
its `problem` and nothing else that was not read; after a broken member, reading goes
on at the next member that starts a record. A header of more than `HEAD_BYTES` without
a blank line is none. What a revisit says of its payload is held against what was read of
the response it names (`verified`); if no response has that id, digest and size, the
revisit keeps what it states and its `problem` says so.

NULL html is an empty payload. NULL page_ids sort last, are written without an id
and read back as NULL; if only NULL ids share a payload they are all responses. Rows
that repeat the smallest page_id of a payload are responses, too.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import without
from harrow.operators.joins import spread_join
from harrow.session import fits_broadcast, new_path, stored
from harrow.sources.storage import located

MIN_SHARED_BYTES = 100
ROLL_BYTES = 64 * 1024 * 1024
CHUNK = 256 * 1024
BATCH_BYTES = 16 * 1024 * 1024
HEAD_BYTES = 1024 * 1024
UNPROVED = "no such response"
# The record format.
GZIP = 31
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n"
BLANK = b"\r\n\r\n"
ID_PREFIX = "<urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary, file string, offset long, problem string"
)
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()),
    ("offset", pa.int64()), ("problem", pa.string()),
])
_FILES = "file string, records long, bytes long"


# --- planning: which page carries a payload ----------------------------------


def record_plan(pages: DataFrame) -> DataFrame:
    """`(page_id, url, payload, digest, refers_to)`; `refers_to` NULL for responses.

    Only digests are grouped. The few that occur more than once are joined back to the
    pages; a payload that a large share of the pages has is spread over many tasks.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = stored(
        rows.filter(F.octet_length("payload") >= MIN_SHARED_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("uses"))
        .filter("uses > 1 AND first_id IS NOT NULL"),
        "shared-payloads",
    )
    if fits_broadcast(shared):
        joined = rows.join(F.broadcast(shared), "digest", "left")
    else:
        others = without(rows, shared, "digest").withColumns({
            "first_id": F.lit(None).cast("long"), "uses": F.lit(1).cast("long")})
        joined = spread_join(rows, shared, "digest", "uses", "page_id", fits=False).unionByName(others)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to")
    )


# --- writing -----------------------------------------------------------------


def _field(name: str, value) -> bytes:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}".encode("utf-8", "surrogatepass") + END


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not yet compressed."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [b"WARC/1.1" + END, _field("WARC-Type", "revisit" if revisit else "response")]
    if page_id is not None:
        head.append(_field("WARC-Record-ID", f"{ID_PREFIX}{page_id}>"))
    if url is not None:
        head.append(_field("WARC-Target-URI", url))
    if revisit:
        head.append(_field("WARC-Refers-To", f"{ID_PREFIX}{refers_to}>"))
        head.append(_field("WARC-Profile", PROFILE))
    head.append(_field("WARC-Payload-Digest", f"sha256:{digest}"))
    head.append(_field("WARC-Payload-Length", len(payload)))
    head.append(_field("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    head.append(_field("Content-Type", "text/html"))
    head.append(_field("Content-Length", len(block)))
    return b"".join(head) + END + block + BLANK


def _writer(path: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(path)
        fs.create_dir(root, recursive=True)
        attempt, done, out, name, records = uuid.uuid4().hex, [], None, "", 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None:
                    name, records = f"part-{attempt}-{len(done):05d}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(wbits=GZIP)
                out.write(packer.compress(record_bytes(*row)) + packer.flush())
                records += 1
                if out.tell() >= roll_bytes:
                    done.append((name, records, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, records, out.tell()))
            out.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "records", "bytes"), one)) for one in done],
            pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )
    return write


def write_archive(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write `pages(page_id, url, html)` under a folder; `(file, records, bytes)` of what was written."""
    plan = record_plan(pages)
    return stored(plan.mapInArrow(_writer(path, roll_bytes), _FILES), "warc-files")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """`(file, records, bytes)` of a folder of archives that something else wrote."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(None).cast("long").alias("records"),
        F.col("length").alias("bytes"),
    )


# --- reading -----------------------------------------------------------------


class _Source:
    """A file read forward once."""

    def __init__(self, stream):
        self.stream = stream
        self.held = b""
        self.at = 0  # file offset of held[0]

    def more(self) -> bool:
        data = self.stream.read(CHUNK)
        self.held += data
        return bool(data)

    def drop(self, count: int) -> None:
        self.held = self.held[count:]
        self.at += count

    def to_magic(self) -> bool:
        """Move to the next bytes that may start a member."""
        while True:
            found = self.held.find(MAGIC)
            if found >= 0:
                self.drop(found)
                return True
            self.drop(max(0, len(self.held) - len(MAGIC) + 1))
            if not self.more():
                return False


class _Member:
    """The content of one gzip member, inflated as far as it is asked for."""

    def __init__(self, source: _Source):
        self.source = source
        self.inflater = zlib.decompressobj(GZIP)
        self.ready = b""
        self.fed = (source.at, b"")

    def pull(self) -> bool:
        """Inflate some more; False at the end of the member."""
        if self.inflater.eof:
            return False
        data = self.inflater.unconsumed_tail
        if not data:
            if not self.source.held and not self.source.more():
                raise EOFError
            data = self.source.held
            self.fed = (self.source.at, data)
            self.source.drop(len(data))
        self.ready += self.inflater.decompress(data, CHUNK)
        if self.inflater.eof:  # what follows belongs to the next member
            rest = self.inflater.unused_data
            self.source.held = rest + self.source.held
            self.source.at -= len(rest)
        return True

    def head(self) -> bytes | None:
        while True:
            end = self.ready.find(BLANK)
            if end >= 0:
                head, self.ready = self.ready[:end], self.ready[end + len(BLANK):]
                return head
            if len(self.ready) > HEAD_BYTES or not self.pull():
                return None

    def take(self, count: int) -> Iterator[bytes]:
        """The next `count` bytes in pieces, fewer if the member ends before."""
        while count:
            if not self.ready and not self.pull():
                return
            piece, self.ready = self.ready[:count], self.ready[count:]
            count -= len(piece)
            yield piece

    def rest(self) -> bytes:
        """Go to the end of the member; the first bytes passed, enough to tell them from a blank line."""
        self.ready = self.ready[:len(BLANK) + 1]
        while self.pull():
            self.ready = self.ready[:len(BLANK) + 1]
        return self.ready


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _page(value: str | None) -> int | None:
    if not value or not value.startswith(ID_PREFIX):
        return None
    try:
        return int(value[len(ID_PREFIX):-1])
    except ValueError:
        return None


def _record(member: _Member) -> dict:
    head = member.head()
    if head is None or not head.startswith(b"WARC/"):
        return {"problem": "no record header"}
    fields = _fields(head)
    row = {
        "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"), "refers_to": _page(fields.get("warc-refers-to")),
    }
    length = fields.get("content-length", "")
    if not length.isdigit():
        return row | {"problem": "no content length"}
    pieces, digest, size = [], hashlib.sha256(), 0
    for piece in member.take(int(length)):
        pieces.append(piece)
        digest.update(piece)
        size += len(piece)
    if size < int(length):
        return row | {"problem": "block too short"}
    if member.rest() != BLANK:
        return row | {"problem": "block too long"}
    found, stated = digest.hexdigest(), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields.get("warc-block-digest", f"sha256:{found}") != f"sha256:{found}":
        return row | {"problem": "block digest differs"}
    if row["record_type"] == "revisit":
        whole = fields.get("warc-payload-length", "")
        return row | {"payload_digest": stated or None, "payload_bytes": int(whole) if whole.isdigit() else None}
    if stated and stated != found:
        return row | {"problem": "payload digest differs"}
    return row | {"payload_digest": found, "payload_bytes": size, "payload": b"".join(pieces)}


def records_of(stream) -> Iterator[dict]:
    """Every record of an open archive, in order."""
    source = _Source(stream)
    in_damage = False
    while source.to_magic():
        start, member = source.at, _Member(source)
        try:
            row = _record(member)
            member.rest()
        except (zlib.error, EOFError) as error:
            row = {"problem": "cut short" if isinstance(error, EOFError) else "bad gzip member"}
            # look for the next member in what was read last
            at, data = member.fed
            skip = 1 if at == start else 0
            source.held = data[skip:] + source.held
            source.at = at + skip
        damaged = row.get("problem") in ("bad gzip member", "cut short", "no record header")
        if not (damaged and in_damage):  # one row for each stretch of damage
            yield row | {"offset": start}
        in_damage = damaged


def _reader(path: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(path)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in records_of(stream):
                        row["file"] = name
                        held += len(row.get("payload") or b"") + 200
                        if not payloads:
                            row.pop("payload", None)
                        rows.append(row)
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
    return read


def read_archive(files: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Records of the files in `files(file, bytes)`, each file read by one task from start to end."""
    tasks = max(1, files.count())
    dealt = files.select("file").repartition(min(tasks, 100_000), "file")
    return dealt.mapInArrow(_reader(path, payloads), RECORD_SCHEMA)


def _unproved(records: DataFrame) -> DataFrame:
    """`(claim, uses)`: id, digest and size that revisits name and no response has."""
    claims = records.filter("record_type = 'revisit' AND problem IS NULL").groupBy(
        "refers_to", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("uses"))
    responses = records.filter("record_type = 'response' AND problem IS NULL").select(
        F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return claims.join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").select(
        _claim().alias("claim"), "uses")


def _claim():
    return F.to_json(F.struct("refers_to", "payload_digest", "payload_bytes"))


def verified(records: DataFrame) -> DataFrame:
    """The records, with a `problem` where a revisit names a response that is not there as it says.

    Revisits are counted by what they claim before they meet the responses, so one response may
    have any number of them. `records` is read more than once: give a stored table.
    """
    unproved = stored(_unproved(records), "unproved-revisits")
    if unproved.isEmpty():
        return records
    revisits = records.filter("record_type = 'revisit' AND problem IS NULL").withColumn("claim", _claim())
    others = records.filter("NOT (record_type <=> 'revisit' AND problem IS NULL)")
    bad = spread_join(revisits, unproved, "claim", "uses", "offset", fits=fits_broadcast(unproved))
    bad = bad.withColumn("problem", F.lit(UNPROVED))
    good = without(revisits, unproved, "claim")
    return others.unionByName(good.select(*records.columns)).unionByName(bad.select(*records.columns))


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to an archive in the shared folder, read it back and verify the revisits."""
    path = new_path(pages.sparkSession, "pages-warc")
    files = write_archive(pages, path)
    return verified(stored(read_archive(files, path, payloads=False).drop("payload"), "warc-records"))
