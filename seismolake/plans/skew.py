"""Equi-joins whose keys may hold very many rows of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which they are split over tasks, and the part of all rows that always is: at most so many keys are split.
HOT_ROWS, HOT_PART = 20_000, 10_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """left joined with right on keys. Keys that very many rows of left have are split by a hash of the column `by`, and right's rows of these keys meet each part; right should have few rows a key."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("rows"))
    most = max(HOT_ROWS, (counts.agg(F.sum("rows")).first()[0] or 0) // HOT_PART)
    hot = F.broadcast(counts.filter(F.col("rows") > most).select(*keys, F.ceil(F.col("rows") / most).cast("int").alias("parts_")))
    parts = F.coalesce("parts_", F.lit(1))
    left = left.join(hot, keys, "left").withColumn("part_", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts_")
    right = right.join(hot, keys, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts_")
    return left.join(right, [*keys, "part_"]).drop("part_")
