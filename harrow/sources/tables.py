"""Table scans with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow import schemas


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, without schema inference where it is known."""
    reader = spark.read
    if name in schemas.TEST_TABLES:
        reader = reader.schema(schemas.TEST_TABLES[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents metadata table kept as Parquet."""
    return spark.read.schema(schemas.DOCUMENT_STATE).parquet(path)


def read_documents_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same table in a live database; pass `partitionColumn`, `lowerBound`,
    `upperBound` and `numPartitions` to read it with more than one task."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    rows = reader.options(**options).load()
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.DOCUMENT_STATE.fields])
