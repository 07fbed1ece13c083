"""Session helpers: the shared work folder and the size check before a broadcast."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
BROADCAST_LIMIT = "harrow.broadcast.maxBytes"
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Settings the jobs are written for; `build_session` applies them, a cluster
# operator may put them into spark-defaults instead.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # html pages are wide rows: keep one Arrow batch to some tens of MB
    ARROW_ROWS: "500",
    # (query, document) groups are many and tiny: hash them instead of sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "200000",
}


def build_session(app: str = "harrow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_small_batches(spark: SparkSession) -> None:
    """Pages and texts are wide rows: some hundred to an Arrow batch, unless the session asks for another number than Spark does."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, RECOMMENDED[ARROW_ROWS])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by the cluster.

    Only a local master may fall back to a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="harrow-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/harrow/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back (cuts lineage)."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once per application.

    A zip of the sources goes to the shared folder, from which Spark hands it out.
    """
    from harrow.sources.storage import located

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"{root.name}/{source.relative_to(root)}")
    folder = new_path(spark, "package")
    fs, place = located(folder)
    fs.create_dir(place, recursive=True)
    with fs.open_output_stream(f"{place}/{root.name}.zip", compression=None) as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{folder}/{root.name}.zip")
    _shipped.add(context.applicationId)


def _row_bytes(df: DataFrame):
    """Approximate bytes one row takes in a broadcast relation."""
    parts = [F.lit(16)]
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.lit(8) + F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(field.dataType, T.ArrayType):
            parts.append(F.lit(16) + 16 * F.coalesce(F.size(column), F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total.cast("long")


def measured_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(_row_bytes(df)).alias("b")).first()["b"] or 0


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_LIMIT, str(DEFAULT_BROADCAST_LIMIT)))


def fits_broadcast(df: DataFrame) -> bool:
    """Measure a frame (one pass, one number back) against the broadcast limit."""
    return measured_bytes(df) <= broadcast_limit(df.sparkSession)


def hinted(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a measured size; beyond it the plan stays a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df) else df
