"""A first-in-first-out queue as a table, and as a stream that keeps its order.

A queue is a folder of published segments. Each segment is one Parquet file that holds
the rows from one `seq` to another, sorted; the segments of a publication do not overlap and
those of a later one lie behind all earlier ones. A table of segments (file, rows, first and
last `seq`) is written last and makes the files part of the queue.

The stream's offsets are `seq` numbers. A micro-batch takes whole segments from where the
one before ended until it has `rowsPerBatch` rows, so batches follow the order by
construction, whatever the file names or times. Only segments that are not yet taken are listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from harrow.session import stored
from harrow.sources.storage import located

SEGMENT_ROWS = 100_000
BATCH_ROWS = 1_000_000
SEGMENTS = "file string, rows long, first long, last long"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The published segments of a queue that has any."""
    return spark.read.schema(SEGMENTS).option("recursiveFileLookup", "true").parquet(f"{path}/segments")


def _last_published(spark: SparkSession, path: str) -> int | None:
    fs, root = located(f"{path}/segments")
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return None
    return segments(spark, path).agg(F.max("last").alias("last")).first()["last"]


def publish(rows: DataFrame, path: str, segment_rows: int = SEGMENT_ROWS) -> None:
    """Append `rows(seq, ...)` to the queue; `seq` must be given and lie behind all that is published.

    Rows are evaluated once, and written by one job: a row lost or taken twice between the
    ranges of several jobs cannot happen. Rows of one `seq` stay in one segment.
    """
    spark = rows.sparkSession
    rows = stored(rows, "published")
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.count("seq").alias("given"), F.min("seq").alias("first")).first()
    if not span["n"]:
        return
    if span["given"] < span["n"]:
        raise ValueError("every row of a queue needs a seq")
    last = _last_published(spark, path)
    if last is not None and span["first"] <= last:
        raise ValueError(f"seq {span['first']} is not behind {last}, the last of the queue")
    name = uuid.uuid4().hex[:12]
    folder = f"{path}/rows/{name}"
    placed = rows.repartitionByRange(-(-span["n"] // segment_rows), "seq").sortWithinPartitions("seq")
    placed.write.parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    listed = written.groupBy(F.concat(F.lit(f"{name}/"), F.col("_metadata.file_name")).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    listed.write.parquet(f"{path}/segments/{name}")


@dataclass
class _Segment(InputPartition):
    file: str


class _QueueReader(DataSourceStreamReader):
    """Driver side: which segments a batch takes; task side: reads one segment."""

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.rows_per_batch = int(options.get("rowsPerBatch") or options.get("rowsperbatch") or BATCH_ROWS)
        self.progress = options.get("progress")
        self.schema = to_arrow_schema(schema)
        self.offered: int | None = None  # the end of the batch last offered
        self.planned = True  # whether that batch was taken
        self.started = False

    def _pending(self, after: int | None, upto: int | None = None) -> list[tuple[int, int, str]]:
        """`(last, rows, file)` of segments behind `after`, in order."""
        fs, root = located(f"{self.path}/segments")
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        pending = []
        for info in found:
            if info.type == pafs.FileType.File and info.base_name.endswith(".parquet") and "/_temporary/" not in info.path:
                table = pq.read_table(info.path, filesystem=fs)
                if after is not None:
                    table = table.filter(pc.greater(table["last"], after))
                if upto is not None:
                    table = table.filter(pc.less_equal(table["last"], upto))
                pending += zip(table["last"].to_pylist(), table["rows"].to_pylist(), table["file"].to_pylist())
        return sorted(pending)

    def initialOffset(self) -> dict:
        return {"seq": None}

    def _resumed(self) -> int | None:
        """Where an earlier run of the same checkpoint had planned to."""
        if self.progress:
            fs, place = located(self.progress)
            if fs.get_file_info(place).type == pafs.FileType.File:
                with fs.open_input_stream(place) as source:
                    return json.loads(source.read())["seq"]
        return None

    def latestOffset(self) -> dict:
        if not self.started:
            self.offered, self.started = self._resumed(), True
        if self.planned:
            rows, end = 0, self.offered
            for last, n, _ in self._pending(self.offered):
                rows, end = rows + n, last
                if rows >= self.rows_per_batch:
                    break
            self.planned = end == self.offered
            self.offered = end
        return {"seq": self.offered}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not self.started or self.offered is None or end["seq"] is None or end["seq"] >= self.offered:
            self.offered, self.planned, self.started = end["seq"], True, True
            if self.progress and end["seq"] is not None:
                fs, place = located(self.progress)
                with fs.open_output_stream(place, compression=None) as out:
                    out.write(json.dumps(end).encode())
        if end["seq"] is None:
            return []
        return [_Segment(file) for _, _, file in self._pending(start["seq"], end["seq"])]

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        fs, place = located(f"{self.path}/rows/{partition.file}")
        with fs.open_input_file(place) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=self.schema.names):
                columns = [batch.column(field.name).cast(field.type) for field in self.schema]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def commit(self, end: dict) -> None:
        """Nothing is kept for batches that are done."""


class QueueSource(DataSource):
    """`spark.readStream.format("queue").schema(...).load(path)`; options `rowsPerBatch` and
    `progress`, a file beside the checkpoint that a restarted stream goes on from."""

    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return "seq long, url string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _QueueReader(dict(self.options), schema)


def read_queue(
    spark: SparkSession, path: str, checkpoint: str, schema: str = "seq long, url string", rows_per_batch: int = BATCH_ROWS
) -> DataFrame:
    """The queue as a stream of ordered micro-batches; `checkpoint` is that of the query it feeds."""
    spark.dataSource.register(QueueSource)
    return (
        spark.readStream.format("queue").schema(schema).option("rowsPerBatch", rows_per_batch)
        .option("progress", f"{checkpoint}-progress.json").load(path)
    )
