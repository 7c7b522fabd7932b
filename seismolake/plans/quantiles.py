"""Exact order statistics by group, without sorting a group or holding it in one buffer.

A group's range is cut into BINS bins whose counts are summed first; only the bins that hold a wanted position are looked at again, and there equal values are counted before they are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 65_536


def values_at(rows: DataFrame, key: list[str], value: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """key and, for each name, the value at a position (from 0, as a function of the group's count) of its values in rising order; nulls are left out."""
    rows = rows.filter(F.col(value).isNotNull()).select(*key, F.col(value).alias("v_"))
    span = rows.groupBy(*key).agg(F.min("v_").alias("low_"), F.max("v_").alias("high_"), F.count("*").alias("n_"))
    keys = {k: f"of_{i}_" for i, k in enumerate(key)}

    def same(names: dict[str, str]) -> Column:
        out = F.lit(True)
        for a, b in names.items():
            out = out & F.col(a).eqNullSafe(F.col(b))
        return out

    wide = F.col("high_") - F.col("low_")
    bin_of = F.when(wide > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v_") - F.col("low_")) / wide * BINS))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(span.withColumnsRenamed(keys), same(keys)).select(*key, "v_", "n_", bin_of.alias("bin_"))
    counts = binned.groupBy(*key, "n_", "bin_").agg(F.count("*").alias("c_"))
    before = F.coalesce(F.sum("c_").over(Window.partitionBy(*key).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), at(F.col("n_")).cast("long").alias("at")) for name, at in positions.items()))
    hit = counts.withColumn("before_", before).withColumn("w_", F.explode(wanted)).filter("w_.at >= before_ AND w_.at < before_ + c_")
    deciding = hit.select(*(F.col(k).alias(f"d_{i}_") for i, k in enumerate(key)), F.col("bin_").alias("d_bin_"), "before_", F.col("w_.name").alias("name_"), F.col("w_.at").alias("at_"))
    few = deciding.select(*(f"d_{i}_" for i in range(len(key))), "d_bin_", "before_").distinct()
    to_d = {k: f"d_{i}_" for i, k in enumerate(key)}
    inside = binned.join(few, same(to_d) & (F.col("bin_") == F.col("d_bin_"))).groupBy(*key, "bin_", "before_", "v_").agg(F.count("*").alias("c_"))
    upto = F.col("before_") + F.sum("c_").over(Window.partitionBy(*key, "bin_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upto_", upto).drop("before_")
    found = ranked.join(deciding, same(to_d) & (F.col("bin_") == F.col("d_bin_")) & (F.col("at_") < F.col("upto_")) & (F.col("at_") >= F.col("upto_") - F.col("c_")))
    return found.groupBy(*key).agg(*(F.max(F.when(F.col("name_") == n, F.col("v_"))).alias(n) for n in positions))


def linear_quantiles(rows: DataFrame, key: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """key and, for each name, the quantile with linear interpolation between neighbours."""
    positions = {}
    for name, q in quantiles.items():
        positions[f"{name}_a"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1))
        positions[f"{name}_b"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1))
    got = values_at(rows, key, value, positions)
    n = rows.filter(F.col(value).isNotNull()).groupBy(*(F.col(k).alias(f"k_{i}_") for i, k in enumerate(key))).agg(F.count("*").alias("n_"))
    match = F.lit(True)
    for i, k in enumerate(key):
        match = match & F.col(k).eqNullSafe(F.col(f"k_{i}_"))
    part = lambda q: F.lit(q) * (F.col("n_") - 1) - F.floor(F.lit(q) * (F.col("n_") - 1))
    return got.join(n, match).select(*key, *((F.col(f"{m}_a") + part(q) * (F.col(f"{m}_b") - F.col(f"{m}_a"))).alias(m) for m, q in quantiles.items()))
