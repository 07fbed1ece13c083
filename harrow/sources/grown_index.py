"""An index that grows by batches, each published at its own cost.

A grown index is a list of segments, oldest first, and running statistics. A batch becomes one
segment: its documents and postings (bucketed by `doc_id`, as in `index_store`), what it changes in
the document frequency of each term, and the ids of documents that older segments hold, too. The
newest segment that has a document owns it; older rows of the document do not count any more.
As re-indexing never removes a posting, the batch takes the old postings of such documents over.
Only ids up to the greatest published one can be old, and only their rows are looked up: a batch
of new documents reads nothing but itself.

When `FANOUT` segments of one level have come together they are merged into one of the next level, so
a row is rewritten once per level and a search meets some `FANOUT` segments a level.

A version is a small file that names its segments, written last. Readers of a version see
it unchanged whatever is published later. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow import schemas
from harrow.functions import scoring
from harrow.functions import text as tx
from harrow.operators import indexing
from harrow.session import hinted, stored
from harrow.sources.index_store import TERM_BUCKETS, SearchIndex, attach, default_buckets, save
from harrow.sources.storage import list_files, located, publish

FANOUT = 4
IDS = T.StructType([T.StructField("doc_id", T.LongType())])


@dataclass(frozen=True)
class Segment:
    path: str
    level: int
    buckets: int
    replaces: bool  # whether older segments hold some of its documents


@dataclass(frozen=True)
class Version:
    number: int = 0
    through: int | None = None  # the last batch that is in
    segments: tuple[Segment, ...] = ()
    n_docs: int = 0
    length_sum: int = 0
    greatest_id: int | None = None

    @property
    def avgdl(self) -> float:
        return self.length_sum / self.n_docs if self.length_sum else scoring.DEFAULT_AVGDL


def _version_file(path: str, number: int) -> str:
    return f"{path}/versions/{number:08d}.json"


def read_version(path: str, number: int | None = None) -> Version:
    """A version by number, by default the last; an empty one if nothing is published."""
    if number is None:
        names = [name for name, _ in list_files(f"{path}/versions", ".json")]
        if not names:
            return Version()
        number = int(max(names).removesuffix(".json"))
    fs, place = located(_version_file(path, number))
    with fs.open_input_stream(place) as source:
        found = json.loads(source.read())
    return Version(**{**found, "segments": tuple(Segment(**segment) for segment in found["segments"])})


def _write_version(path: str, version: Version) -> None:
    publish(_version_file(path, version.number), json.dumps(asdict(version)).encode())


class _Tables:
    """The tables of the segments of a version, without rows that newer segments own."""

    def __init__(self, spark: SparkSession, version: Version):
        self.spark, self.version = spark, version
        self.tag = "harrow_" + uuid.uuid4().hex[:12]

    def _table(self, at: int, name: str, schema: T.StructType, sort: str) -> DataFrame:
        segment = self.version.segments[at]
        return attach(self.spark, f"{self.tag}_{at}_{name}", schema, f"{segment.path}/{name}", "doc_id", sort, segment.buckets)

    def replaced(self, first: int) -> DataFrame | None:
        """Ids that segments from `first` on have taken from older ones."""
        found = [
            self.spark.read.schema(IDS).parquet(f"{segment.path}/replaced")
            for segment in self.version.segments[first:] if segment.replaces
        ]
        return reduce(DataFrame.unionByName, found).distinct() if found else None

    def _live(self, name: str, schema: T.StructType, sort: str, chosen: range | None = None) -> DataFrame:
        parts = []
        for at in chosen or range(len(self.version.segments)):
            rows = self._table(at, name, schema, sort)
            gone = self.replaced(at + 1)
            parts.append(rows if gone is None else rows.join(hinted(gone), "doc_id", "left_anti").select(*rows.columns))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def documents(self, chosen: range | None = None) -> DataFrame:
        return self._live("documents", schemas.INDEXED_DOCUMENTS, "doc_id", chosen)

    def postings(self, chosen: range | None = None) -> DataFrame:
        return self._live("postings", schemas.POSTINGS, "term, doc_id", chosen)

    def term_stats(self, chosen: range | None = None) -> DataFrame:
        """Sums of what the segments say; a shortest document may be one that was replaced since."""
        found = [
            self.spark.read.schema(schemas.TERM_STATS).parquet(f"{self.version.segments[at].path}/term_stats")
            for at in chosen or range(len(self.version.segments))
        ]
        if not found:
            return self.spark.createDataFrame([], schemas.TERM_STATS)
        if len(found) == 1:
            return found[0]
        return _summed(reduce(DataFrame.unionByName, found))


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(
        F.sum("df").alias("df"), F.min("min_length").alias("min_length"),
        F.bool_or("length_unknown").alias("length_unknown"))


def _write_terms(terms: DataFrame, path: str, buckets: int) -> None:
    terms.repartitionByRange(min(buckets, TERM_BUCKETS), "term").sortWithinPartitions("term").write.parquet(
        f"{path}/term_stats")


def grow(
    documents: DataFrame, path: str, batch: int | None = None, text_bytes: int = 0, fanout: int = FANOUT
) -> SearchIndex:
    """Publish a batch `(doc_id, url, title, text)` of documents, each once, as the next version.

    NULL text is a document never fetched. A batch that is numbered is published once: doing it
    again, or an earlier one, changes nothing. An empty batch is a version without a segment of its own.
    """
    spark = documents.sparkSession
    version = read_version(path)
    if batch is not None and version.through is not None and batch <= version.through:
        return opened(spark, path, version)
    folder = f"{path}/segments/{uuid.uuid4().hex[:12]}"
    tag = "harrow_" + uuid.uuid4().hex[:12]
    rows = documents.select("doc_id", "url", "title", "text")
    if not text_bytes:
        rows = stored(rows, "batch")
        text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = default_buckets(spark, text_bytes)
    text = F.col("text")
    save(
        rows.repartition(buckets, "doc_id").select(
            "doc_id", "url", "title", tx.snippet(text).alias("snippet"), tx.token_count(text).alias("doc_length"), "text"),
        f"{tag}_documents", f"{folder}/documents", "doc_id", ["doc_id"], buckets)
    kept = spark.table(f"{tag}_documents")
    size = kept.agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_length").alias("length"), F.min("doc_id").alias("least"),
        F.max("doc_id").alias("greatest")).first()
    if not size["n"]:
        version = replace(version, number=version.number + 1, through=batch)
        _write_version(path, version)
        return opened(spark, path, version)

    tables = _Tables(spark, version)
    postings = indexing.count_terms(kept, "doc_length")
    gone = {"n": 0, "length": 0}
    if version.segments and size["least"] <= version.greatest_id:
        ids = kept.filter(F.col("doc_id") <= version.greatest_id).select("doc_id", "doc_length")
        ids = stored(ids, "known-ids")
        span = F.col("doc_id").between(size["least"], version.greatest_id)
        old = stored(tables.documents().filter(span).join(hinted(ids.select("doc_id")), "doc_id", "left_semi")
                     .select("doc_id", "doc_length"), "replaced")
        gone = old.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_length").alias("length")).first()
    if gone["n"]:
        taken = ids.join(hinted(old.select("doc_id")), "doc_id", "left_semi")
        before = stored(tables.postings().filter(span).drop("doc_length").join(hinted(taken), "doc_id"), "old-postings")
        both = postings.withColumn("newer", F.lit(1)).unionByName(
            before.select("term", "doc_id", "tf", "doc_length").withColumn("newer", F.lit(0)))
        postings = both.repartition(buckets, "doc_id").groupBy("term", "doc_id", "doc_length").agg(
            F.max_by("tf", "newer").alias("tf")).select("term", "doc_id", "tf", "doc_length")
        old.select("doc_id").write.parquet(f"{folder}/replaced")
    save(postings, f"{tag}_postings", f"{folder}/postings", "doc_id", ["term", "doc_id"], buckets)
    counted = spark.table(f"{tag}_postings").select(
        "term", F.lit(1).cast("long").alias("df"),
        F.when(F.col("doc_length") > 0, F.col("doc_length")).alias("min_length"),
        (F.coalesce("doc_length", F.lit(0)) == 0).alias("length_unknown"))
    if gone["n"]:  # the postings that no longer count where they were
        counted = counted.unionByName(before.select(
            "term", F.lit(-1).cast("long").alias("df"), F.lit(None).cast("int").alias("min_length"),
            F.lit(False).alias("length_unknown")))
    _write_terms(_summed(counted), folder, buckets)
    segment = Segment(folder, 0, buckets, bool(gone["n"]))
    version = Version(
        version.number + 1, batch, (*version.segments, segment), version.n_docs + size["n"] - gone["n"],
        version.length_sum + (size["length"] or 0) - (gone["length"] or 0),
        max(size["greatest"], size["greatest"] if version.greatest_id is None else version.greatest_id))
    version = _merged(spark, path, version, fanout)
    _write_version(path, version)
    return opened(spark, path, version)


def _merged(spark: SparkSession, path: str, version: Version, fanout: int) -> Version:
    """While the last `fanout` segments are of one level, put them together."""
    while True:
        last = version.segments[-fanout:]
        if len(last) < fanout or len({segment.level for segment in last}) > 1:
            return version
        chosen = range(len(version.segments) - fanout, len(version.segments))
        tables = _Tables(spark, version)
        folder = f"{path}/segments/{uuid.uuid4().hex[:12]}"
        tag = "harrow_" + uuid.uuid4().hex[:12]
        buckets = sum(segment.buckets for segment in last)
        if all(segment.buckets == default_buckets(spark) for segment in last):
            buckets = default_buckets(spark)  # small ones
        save(tables.documents(chosen).repartition(buckets, "doc_id"), f"{tag}_documents", f"{folder}/documents", "doc_id",
             ["doc_id"], buckets)
        save(tables.postings(chosen).repartition(buckets, "doc_id"), f"{tag}_postings", f"{folder}/postings", "doc_id",
             ["term", "doc_id"], buckets)
        _write_terms(tables.term_stats(chosen), folder, buckets)
        older = chosen.start > 0 and any(segment.replaces for segment in last)
        if older:
            tables.replaced(chosen.start).write.parquet(f"{folder}/replaced")
        segment = Segment(folder, last[0].level + 1, buckets, older)
        version = replace(version, segments=(*version.segments[:chosen.start], segment))


def opened(spark: SparkSession, path: str, version: Version) -> SearchIndex:
    tables = _Tables(spark, version)
    return SearchIndex(
        path=_version_file(path, version.number), documents=tables.documents(), postings=tables.postings(),
        term_stats=tables.term_stats(), n_docs=max(1, version.n_docs), avgdl=version.avgdl,
        buckets=max((segment.buckets for segment in version.segments), default=1))


def open_grown(spark: SparkSession, path: str, number: int | None = None) -> SearchIndex:
    """The last version of a grown index, or an earlier one."""
    return opened(spark, path, read_version(path, number))

