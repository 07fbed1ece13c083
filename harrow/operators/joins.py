"""Inner join for keys that may hold a large share of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.session import fits_broadcast, hinted, stored

ROWS_PER_TASK = 1_000_000


def spread_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    weight: str,
    spread_by: str,
    fits: bool | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join `big` to `small` on `key`, whatever the key distribution of `big`.

    `small` carries in `weight` how many rows of `big` share its key. If `small`
    fits a broadcast (measured here unless the caller knows), nothing is shuffled. Otherwise rows of a heavy key are cut
    into `weight / rows_per_task` parts by a hash of `spread_by`, and the matching
    rows of `small` are repeated once per part. There are at most
    `count(big) / rows_per_task` heavy keys.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), key)
    parts = F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int")
    heavy = (
        small.filter(F.col(weight) > rows_per_task)
        .groupBy(key).agg(F.max(parts).alias("_parts"))
    )
    cut = big.join(hinted(heavy), key, "left").withColumn(
        "_part",
        F.when(F.col("_parts").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(spread_by), F.col("_parts")).cast("int")),
    ).drop("_parts")
    last = F.when(F.col(weight) > rows_per_task, parts - 1).otherwise(F.lit(0))
    repeated = small.withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
    return cut.join(repeated, [key, "_part"]).drop("_part")


def attach(rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, fits: bool) -> DataFrame:
    """Join result rows to a lookup table that has one row per `key`.

    `fits`: the rows are known to fit a broadcast, so the lookup is only scanned.
    Otherwise the rows are written once (they end a long plan and are read twice)
    and a key that many of them share is spread.
    """
    if fits:
        return lookup.join(F.broadcast(rows), key)
    rows = stored(rows, "rows")
    uses = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"))
    return spread_join(rows, lookup.join(uses, key), key, "_uses", spread_by, fits=False).drop("_uses")
