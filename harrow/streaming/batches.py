"""Tables that a stream grows by one folder per micro-batch.

A batch overwrites its own folder, so replaying it changes nothing, and it reads
folders of earlier batches only, so it never meets its own first attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_BATCH = -1


def start_table(spark: SparkSession, path: str, schema: T.StructType, rows: DataFrame | None = None) -> None:
    """Lay down the rows known before the stream starts (none by default), once."""
    first = f"{path}/batch_id={BASE_BATCH}"
    try:
        spark.read.schema(schema).parquet(first)
    except Exception as error:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema) if rows is None else rows
        rows.write.mode("overwrite").parquet(first)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """All batches, or those before one; the batch number is a pruned partition."""
    numbered = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(numbered).parquet(path)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def read_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")
