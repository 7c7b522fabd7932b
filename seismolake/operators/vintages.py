"""When observations became known: stamps by product, what was readable at an instant, how late it came."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import values_at

DAY_US = 86_400_000_000
#: Lags of products, days.
LAGS = {"final": 14, "rapid": 1}


def stamped(rows: DataFrame, lags: dict[str, int] = LAGS) -> DataFrame:
    """rows (valid_us, product, published_us) with available_us: the stamp of the payload, else the valid time and the product's lag; null for a product nobody knows."""
    days = F.create_map(*(x for k, v in lags.items() for x in (F.lit(k), F.lit(v))))
    return rows.withColumn("available_us", F.coalesce("published_us", F.col("valid_us") + F.element_at(days, F.col("product")) * F.lit(DAY_US)))


def readable_as_of(rows: DataFrame, instant: int) -> DataFrame:
    """What was held strictly before the instant."""
    return rows.filter(F.col("available_us") < instant)


def latest_as_of(rows: DataFrame, key: list[str], instant: int) -> DataFrame:
    """Of each key the version that became available last before the instant."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("available_us"), F.desc("product")))
    return readable_as_of(rows, instant).withColumn("_rank", last).filter("_rank = 1").drop("_rank")


def summary(rows: DataFrame, reference: int) -> DataFrame:
    """Positions, how many were available by the reference and how many came after, and nearest-rank quantiles of the lag in days."""
    lag = rows.filter("available_us IS NOT NULL").select((F.col("available_us") - F.col("valid_us")).alias("lag"))
    at = lambda q: lambda n: F.bround(F.lit(q) * (n - 1), 0)
    got = values_at(lag, [], "lag", {"median_days": at(0.5), "p90_days": at(0.9), "max_days": at(1.0)})
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("available_us") < reference).alias("n_available"), F.count_if(F.col("available_us") >= reference).alias("n_later"))
    return counts.join(F.broadcast(got.select(*((F.col(c) / F.lit(float(DAY_US))).alias(c) for c in ("median_days", "p90_days", "max_days")))), F.lit(True), "left")


def refit_plan(cutoffs: DataFrame, have: DataFrame, now: int, coverage_end: int) -> DataFrame:
    """cutoffs (cutoff_us) with what becomes of each: already fitted, not yet due, beyond coverage, or planned."""
    rows = cutoffs.join(have.select(F.col("cutoff_us").alias("fitted")), F.col("cutoff_us") == F.col("fitted"), "left")
    what = F.when(F.col("fitted").isNotNull(), "already-fitted").when(F.col("cutoff_us") > now, "not-yet-due").when(F.col("cutoff_us") > coverage_end, "beyond-coverage").otherwise("planned")
    return rows.select("cutoff_us", what.alias("outcome"))


def last_cutoff(issues: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """issues (issue_us) with the latest cut-off that isn't after them; a schedule is small."""
    held = F.broadcast(cutoffs.select(F.col("cutoff_us").alias("c")))
    return issues.join(held, F.col("c") <= F.col("issue_us"), "left").groupBy("issue_us").agg(F.max("c").alias("cutoff_us"))
