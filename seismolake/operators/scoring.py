"""Scores of forecasts and alarms. Tables of cells, bins and windows are small next to catalogues; their running sums are over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seismology as S
from ..functions.shared_draws import uniform


def molchan_groups(cells: DataFrame) -> DataFrame:
    """cells (alarm, mass, n): one row per alarm value, so ties stay together."""
    return cells.groupBy("alarm").agg(F.sum("mass").alias("mass"), F.count("*").alias("cells"), F.sum("n").alias("hits"))


def molchan_trajectory(groups: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("alarm")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("hits").over(Window.partitionBy())
    return groups.select("alarm", F.least(F.lit(1.0), F.sum("mass").over(w)).alias("tau"), (F.lit(1.0) - F.sum("hits").over(w) / total).alias("miss"), F.sum("cells").over(w).alias("cells"))


def area_skill(trajectory: DataFrame) -> DataFrame:
    """Area under the hit rate over tau, by trapezoids from (0, 0), carried on to tau = 1."""
    w = Window.orderBy("tau", F.desc("miss"))
    hit = F.lit(1.0) - F.col("miss")
    steps = trajectory.select("tau", hit.alias("hit"), F.coalesce(F.lag("tau").over(w), F.lit(0.0)).alias("tau0"), F.coalesce(F.lag(hit).over(w), F.lit(0.0)).alias("hit0"))
    area = F.sum((F.col("tau") - F.col("tau0")) * (F.col("hit") + F.col("hit0")) / 2) + (F.lit(1.0) - F.max("tau")) * F.max("hit")
    return steps.agg(area.alias("area_skill"))


def information_gain(terms: DataFrame) -> DataFrame:
    """terms (window, n, rate_diff, expected_diff): pooled gain per event, null without events, and Kish's effective number of windows."""
    n = F.sum("n")
    return terms.agg(
        F.when(n > 0, (F.sum("rate_diff") - F.sum("expected_diff")) / n).alias("gain"), (n * n / F.sum(F.col("n") * F.col("n"))).alias("effective_blocks"), n.alias("n_events")
    )


def paired_test(diffs: DataFrame) -> DataFrame:
    """diffs (d): mean, variance and t of log-rate differences; undecided (null t) below two events or without variance."""
    s = diffs.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_samp("d").alias("variance"))
    return s.withColumn("t", F.when((F.col("n") > 1) & (F.col("variance") > 0), F.col("mean") / F.sqrt(F.col("variance") / F.col("n"))))


def pass_rates(verdicts: DataFrame) -> DataFrame:
    """verdicts (test, passed): passed and scored by test; a null verdict is neither."""
    return verdicts.groupBy("test").agg(F.count_if("passed").alias("n_passed"), F.count("passed").alias("n_scored"))


def leave_one_out(terms: DataFrame) -> DataFrame:
    """Pooled gain without each window in turn, from the totals rather than by rescoring."""
    whole = Window.partitionBy()
    n = F.sum("n").over(whole) - F.col("n")
    gain = F.sum("rate_diff").over(whole) - F.col("rate_diff") - F.sum("expected_diff").over(whole) + F.col("expected_diff")
    return terms.select("window", F.when(n > 0, gain / n).alias("gain"))


def poisson_log_likelihood(cells: DataFrame) -> DataFrame:
    """cells (rate, n): sum of n ln rate - rate - ln n!."""
    return cells.agg(F.sum(F.col("n") * F.log("rate") - F.col("rate") - S.log_factorial(F.col("n"))).alias("ll"), F.sum("n").alias("n"), F.sum("rate").alias("expected"))


def conditional_statistics(cells: DataFrame) -> DataFrame:
    """The same with the rates scaled to the observed count (conditional and spatial tests)."""
    whole = Window.partitionBy()
    scaled = cells.withColumn("rate", F.col("rate") * F.sum("n").over(whole) / F.sum("rate").over(whole))
    return poisson_log_likelihood(scaled).select(F.col("ll").alias("statistic"), "n")


def geometric_pool(models: DataFrame, floor: float) -> DataFrame:
    """models (model, weight, cell_ix, rate): weighted geometric mean by cell with rates floored by a part of the model's mean rate, rescaled to the geometric mean of the totals."""
    own = Window.partitionBy("model")
    logs = models.withColumn("total", F.sum("rate").over(own)).withColumn("log_rate", F.log(F.greatest("rate", F.lit(floor) * F.avg("rate").over(own))))
    cells = logs.groupBy("cell_ix").agg(F.exp(F.sum(F.col("weight") * F.col("log_rate"))).alias("rate"), F.exp(F.sum(F.col("weight") * F.log("total"))).alias("target"))
    return cells.select("cell_ix", (F.col("rate") * F.col("target") / F.sum("rate").over(Window.partitionBy())).alias("rate"))


def filled(terms: DataFrame) -> DataFrame:
    """Windows from the first to the last, numbered from 0, those without events with zeros."""
    low, high = terms.agg(F.min("window"), F.max("window")).first()
    if low is None:
        return terms
    every = terms.sparkSession.range(high - low + 1).withColumnRenamed("id", "number")
    rows = every.join(terms, F.col("window") == F.col("number") + F.lit(low), "left")
    return rows.select(F.col("number").alias("window"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "rate_diff", "expected_diff")))


def bootstrap_gains(terms: DataFrame, length: int, resamples: int, seed: int) -> DataFrame:
    """resample, n and gain over circular moving blocks of the windows; starts are draws for (resample, block)."""
    terms = filled(terms)
    n = terms.count()
    blocks = -(-n // length)
    draws = terms.sparkSession.range(resamples).withColumnRenamed("id", "resample").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    start = F.least(F.lit(n - 1), F.floor(uniform(seed, "resample", "b") * n))
    draws = draws.withColumn("start", start).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).filter(F.col("b") * length + F.col("o") < n)
    draws = draws.select("resample", ((F.col("start") + F.col("o")) % n).alias("window"))
    return draws.join(F.broadcast(terms) if n <= 100_000 else terms, "window").groupBy("resample").agg(F.sum("n").alias("n"), (F.sum("rate_diff") - F.sum("expected_diff")).alias("gain"))


def block_bootstrap(terms: DataFrame, length: int, resamples: int, seed: int, level: float = 0.9) -> DataFrame:
    """Percentile interval of the pooled gain; resamples without events count for nothing."""
    sums = bootstrap_gains(terms, length, resamples, seed)
    tail = (1 - level) / 2
    return sums.filter("n > 0").agg(*(F.percentile(F.col("gain") / F.col("n"), F.lit(q)).alias(c) for q, c in ((tail, "low"), (0.5, "median"), (1 - tail, "high"))))


def block_length_sensitivity(terms: DataFrame, lengths: list[int], resamples: int, seed: int) -> DataFrame:
    """The interval for several block lengths."""
    out = None
    for length in lengths:
        one = block_bootstrap(terms, length, resamples, seed).select(F.lit(length).alias("length"), "*")
        out = one if out is None else out.unionByName(one)
    return out
