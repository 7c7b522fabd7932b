"""Alarm scoring beside the trajectory: the declared operating point, controls that relocate the footprint, alarms from forecasts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.shared_draws import uniform
from . import scoring


def declared_point(cells: DataFrame, threshold: float, alpha: float = 0.05) -> DataFrame:
    """cells (cell_ix, alarm, mass, n): the footprint's mass tau, hits, gain over the reference, p value. Without targets or without mass there is no gain."""
    on = F.col("alarm") >= threshold
    s = cells.agg(F.sum(F.when(on, F.col("mass")).otherwise(0.0)).alias("tau"), F.sum(F.when(on, F.col("n")).otherwise(0)).cast("long").alias("hits"), F.sum("n").cast("long").alias("n_targets"), F.count_if(on).alias("n_alarm_cells"))
    sound = (F.col("n_targets") > 0) & (F.col("tau") > 0)
    gain = F.when(sound, F.col("hits") / F.col("n_targets") / F.col("tau"))
    p = F.when(sound, tails.binomial_sf(F.col("hits"), F.col("n_targets"), F.least(F.lit(1.0), F.col("tau"))))
    return s.withColumn("gain", gain).withColumn("p_value", p).withColumn("significant", F.col("p_value") <= alpha)


def matched_random_hits(cells: DataFrame, n_alarm_cells: int, simulations: int, seed: int) -> DataFrame:
    """simulation and hits of footprints of the same number of cells, drawn without replacement: the cells of least draws in each simulation."""
    draws = cells.select("cell_ix", "n").join(F.broadcast(cells.sparkSession.range(simulations).withColumnRenamed("id", "simulation")))
    rank = F.row_number().over(Window.partitionBy("simulation").orderBy(uniform(seed, "simulation", "cell_ix"), "cell_ix"))
    return draws.withColumn("rank", rank).filter(F.col("rank") <= n_alarm_cells).groupBy("simulation").agg(F.sum("n").cast("long").alias("hits"))


def exceedance_p(null: DataFrame, column: str, observed: float) -> DataFrame:
    """(draws at least as large + 1) / (draws + 1)."""
    return null.agg(((F.count_if(F.col(column) >= observed) + 1) / (F.count("*") + 1)).alias("p_value"))


def score_alarm(cells: DataFrame, threshold: float | None, simulations: int, seed: int, uniform_reference: bool = False, as_contrast: bool = False) -> DataFrame:
    """One row: area skill and, where a threshold was declared, the point, its p value and the relocated control's. A uniform reference is refused unless it is asked for as a contrast."""
    if uniform_reference and not as_contrast:
        raise ValueError("a spatially uniform reference credits an alarm for knowing where faults are; ask for it as a contrast")
    skill = scoring.area_skill(scoring.molchan_trajectory(scoring.molchan_groups(cells)))
    if threshold is None:
        return skill
    point = declared_point(cells, threshold)
    held = point.first()
    null = matched_random_hits(cells, held.n_alarm_cells, min(simulations, 2000), seed)
    return skill.crossJoin(point).crossJoin(exceedance_p(null, "hits", held.hits).withColumnRenamed("p_value", "matched_p"))


def pooled_schedule(cells: DataFrame) -> DataFrame:
    """cells (window, cell_ix, alarm, mass, expected, n) as one set of bins: masses are weighted by the windows' expected events. A window that expects none is refused."""
    bad = cells.groupBy("window").agg(F.max("expected").alias("e")).filter("NOT (e > 0)").limit(1).collect()
    if bad:
        raise ValueError(f"window {bad[0][0]} expects no events")
    weight = F.col("mass") * F.col("expected")
    return cells.select("window", "cell_ix", "alarm", (weight / F.sum(weight).over(Window.partitionBy())).alias("mass"), "n")


def threshold_for_tau(cells: DataFrame, tau: float) -> DataFrame:
    """The largest footprint by falling alarm value whose reference mass stays at most tau: its threshold; no row if even the first value exceeds it."""
    t = scoring.molchan_groups(cells.withColumn("n", F.coalesce(F.col("n"), F.lit(0)))) if "n" in cells.columns else scoring.molchan_groups(cells.withColumn("n", F.lit(0)))
    run = Window.orderBy(F.desc("alarm")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("tau", F.sum("mass").over(run)).filter(F.col("tau") <= tau + 1e-12).agg(F.min("alarm").alias("threshold"), F.max("tau").alias("tau")).filter("threshold IS NOT NULL")


def alarm_from_forecast(bins: DataFrame, least_bin: int) -> DataFrame:
    """Alarm values by cell: the probability of at least one event at or above a magnitude bin."""
    return bins.filter(F.col("m_bin") >= least_bin).groupBy("cell_ix").agg((F.lit(1.0) - F.exp(-F.sum("rate"))).alias("alarm"))


def alarm_from_occupancy(cells: DataFrame, probability: str = "p") -> DataFrame:
    return cells.select("cell_ix", F.col(probability).alias("alarm"))


def minimum_detectable_gain(n: int, tau: float, alpha: float, power: float) -> float | None:
    """The smallest gain whose power is reached, by bisection up to 1 / tau; none if even the whole mass isn't enough."""
    from ..functions.tails import power_at_gain

    low, high = 1.0, 1.0 / tau
    if power_at_gain(n, tau, high, alpha) < power:
        return None
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if power_at_gain(n, tau, mid, alpha) >= power else (mid, high)
    return high


def minimum_detectable_information_gain(n: int, sd: float, z_alpha: float = 1.6448536269514722, z_power: float = 0.8416212335729143) -> float:
    """Per event: (z_alpha + z_power) sd / sqrt(n)."""
    return (z_alpha + z_power) * sd / math.sqrt(n)
