"""The folded state of the document log, kept so that the log itself is not read again.

Every batch of log rows becomes a segment: one row per document, each column with the `seq` of the
row that set it. Folding takes the greatest `seq` per column, so it does not matter in which order
or grouping rows are folded, and rows that come late fall into place. When `FANOUT` segments of one
level have come together they are folded into one of the next, so a batch costs its own rows and
a row is rewritten once per level; the state is a fold of the few segments there are.

A version is a small file that names its segments, written last; earlier versions stay readable. A
batch is published once: doing it again, or an earlier one, changes nothing. One writer at a time.

Rows without `seq` set nothing. If a document has two values of one column at the same `seq`,
the greater one counts. Rows without `doc_id` are one document.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow import schemas
from harrow.operators.documents import log_rows
from harrow.session import hinted
from harrow.sources.storage import list_files, located, publish

FANOUT = 4
COLUMNS = [field for field in schemas.DOC_LOG.fields if field.name not in ("doc_id", "seq")]
FOLDED = T.StructType([T.StructField("doc_id", T.LongType())] + [
    T.StructField(field.name, T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", field.dataType)]))
    for field in COLUMNS
])


@dataclass(frozen=True)
class Segment:
    number: int  # unique in the folder, also of replaced segments
    level: int


@dataclass(frozen=True)
class Version:
    number: int = 0
    through: int | None = None
    segments: tuple[Segment, ...] = ()
    written: int = 0  # segments ever written


def read_version(path: str, number: int | None = None) -> Version:
    """A version by number, by default the last; an empty one if nothing is published."""
    if number is None:
        names = [name for name, _ in list_files(f"{path}/versions", ".json")]
        if not names:
            return Version()
        number = int(max(names).removesuffix(".json"))
    fs, place = located(f"{path}/versions/{number:08d}.json")
    with fs.open_input_stream(place) as source:
        found = json.loads(source.read())
    return Version(**{**found, "segments": tuple(Segment(**segment) for segment in found["segments"])})


def _with_seq(rows: DataFrame) -> DataFrame:
    return log_rows(rows).select("doc_id", *[
        F.when(
            F.col(field.name).isNotNull() & F.col("seq").isNotNull(),
            F.struct(F.col("seq"), F.col(field.name).alias("value")),
        ).alias(field.name)
        for field in COLUMNS
    ])


def _folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(*[F.max(field.name).alias(field.name) for field in COLUMNS])


def _segments(spark: SparkSession, path: str, segments: tuple[Segment, ...]) -> DataFrame:
    found = [spark.read.schema(FOLDED).parquet(f"{path}/segments/{segment.number:08d}") for segment in segments]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOLDED)


def _write(rows: DataFrame, path: str, version: Version, level: int) -> Version:
    """Folded rows as the next segment; what an unfinished attempt left there is overwritten."""
    segment = Segment(version.written + 1, level)
    _folded(rows).sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/segments/{segment.number:08d}")
    return replace(version, segments=(*version.segments, segment), written=segment.number)


def append_log(rows: DataFrame, path: str, batch: int, fanout: int = FANOUT) -> Version:
    """Publish a batch of log rows (any of the log's columns) and return the version it is in."""
    version = read_version(path)
    if version.through is not None and batch <= version.through:
        return version
    spark = rows.sparkSession
    version = _write(_with_seq(rows), path, version, 0)
    while True:
        last = version.segments[-fanout:]
        if len(last) < fanout or len({segment.level for segment in last}) > 1:
            break
        kept = replace(version, segments=version.segments[:-fanout])
        version = _write(_segments(spark, path, last), path, kept, last[0].level + 1)
    version = replace(version, number=version.number + 1, through=batch)
    publish(f"{path}/versions/{version.number:08d}.json", json.dumps(asdict(version)).encode())
    return version


def current_state(spark: SparkSession, path: str, number: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The documents table of the last version, or of an earlier one.

    With `ids(doc_id)` only those documents are looked up, before anything is folded.
    """
    rows = _segments(spark, path, read_version(path, number).segments)
    if ids is not None:
        rows = rows.join(hinted(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    return _folded(rows).select("doc_id", *[F.col(f"{field.name}.value").alias(field.name) for field in COLUMNS])
