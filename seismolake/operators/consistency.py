"""Consistency tests of gridded forecasts: number, likelihood, conditional likelihood, space and magnitude.

A forecast is a table of bins (cell_ix, m_bin, rate, n), n being the observed events. Bins are few next to catalogues, so their running sums are one window.
Simulated catalogues are rows (simulation, event); an event finds its bin by an equi-join on a slice of the cumulative rates, so work grows with the events drawn and not with events times bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seismology as S
from ..functions import tails
from ..functions.shared_draws import uniform
from ..plans.shared import written

#: Slices of (0, 1) by which draws find their bins.
SLICES = 1024
#: Draws of a simulation that are made in one go.
PIECE = 10_000


def marginal(bins: DataFrame, by: str) -> DataFrame:
    """Rates and counts summed over all but one of the axes: space (cell_ix) or magnitude (m_bin)."""
    return bins.groupBy(by).agg(F.sum("rate").alias("rate"), F.sum("n").alias("n")).withColumn("bin", F.col(by)).select("bin", "rate", "n")


def scaled_to_count(bins: DataFrame) -> DataFrame:
    whole = Window.partitionBy()
    return bins.withColumn("rate", F.col("rate") * F.sum("n").over(whole) / F.sum("rate").over(whole))


def _term(n: Column, rate: Column) -> Column:
    return n * F.log(rate) - S.log_factorial(n)


def observed_statistic(bins: DataFrame) -> DataFrame:
    """bins (bin, rate, n): the joint Poisson log likelihood; minus infinity where an event fell into a bin of rate 0."""
    hit = F.when(F.col("n") > 0, F.when(F.col("rate") > 0, _term(F.col("n"), F.col("rate"))).otherwise(F.lit(float("-inf")))).otherwise(F.lit(0.0))
    return bins.agg((F.sum(hit) - F.sum("rate")).alias("observed"), F.sum("n").alias("n_obs"))


def poisson_counts(bins: DataFrame, simulations: int, seed: int) -> DataFrame:
    """simulation and its number of events: a Poisson draw of the forecast's total, by inversion of a table of its distribution."""
    total = bins.agg(F.sum("rate").alias("total"))
    most = F.ceil(F.col("total") + 12 * F.sqrt("total") + 30).cast("long")
    # what lies below has a chance of less than 1e-30
    least = F.greatest(F.lit(0), F.floor(F.col("total") - 12 * F.sqrt("total") - 30)).cast("long")
    table = total.withColumn("k", F.explode(F.sequence(least, most)))
    mass = F.exp(F.col("k") * F.log("total") - F.col("total") - S.log_factorial(F.col("k")))
    table = table.select("k", F.sum(mass).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    table = table.select("k", F.coalesce(F.lag("upto").over(Window.orderBy("k")), F.lit(0.0)).alias("low"), F.col("upto").alias("high"))
    slice_of = lambda c: F.least(F.lit(SLICES - 1), F.floor(c * SLICES)).cast("int")
    table = table.filter("high > low").withColumn("slice", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high")))))
    draws = bins.sparkSession.range(simulations).select(F.col("id").alias("simulation"), uniform(seed, "id").alias("u")).withColumn("slice_of", slice_of(F.col("u")))
    met = draws.join(table, (F.col("slice_of") == F.col("slice")) & (F.col("u") > F.col("low")) & (F.col("u") <= F.col("high")), "left")
    # a draw beyond the table's end, which rounding may leave below 1, is the count after it
    return met.crossJoin(F.broadcast(total.select(F.when(F.col("total") > 0, most + 1).otherwise(0).alias("beyond")))).select("simulation", F.coalesce("k", "beyond").alias("n_events"))


def numbered(counts: DataFrame) -> DataFrame:
    """simulation and k = 1 .. n_events. Simulations are cut into pieces of PIECE numbers, which are dealt out before their rows are made, so no task makes more than its share."""
    spark = counts.sparkSession
    cut = counts.filter("n_events > 0").select("simulation", "n_events", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_events") - 1) / PIECE).cast("long"))).alias("piece"))
    cut = cut.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "simulation", "piece")
    first, last = F.col("piece") * PIECE + 1, F.least(F.col("n_events"), (F.col("piece") + 1) * PIECE)
    return cut.select("simulation", F.explode(F.sequence(first, last)).alias("k"))


def simulated_statistics(bins: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """simulation and statistic of catalogues with counts (simulation, n_events) drawn from the bins' rates (bin, rate)."""
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("rate").over(Window.partitionBy())
    edges = bins.filter("rate > 0").select("bin", "rate", (F.sum("rate").over(upto) / total).alias("high"), (F.col("rate") / total).alias("share"))
    edges = edges.withColumn("low", F.col("high") - F.col("share"))
    slice_of = lambda c: F.least(F.lit(SLICES - 1), F.floor(c * SLICES)).cast("int")
    edges = edges.withColumn("slice", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high"))))).drop("share")
    events = numbered(counts).withColumn("u", uniform(seed + 1, "simulation", "k")).withColumn("slice_of", slice_of(F.col("u")))
    hit = events.join(F.broadcast(edges), (F.col("slice_of") == F.col("slice")) & (F.col("u") > F.col("low")) & (F.col("u") <= F.col("high")))
    cells = hit.groupBy("simulation", "bin", "rate").agg(F.count("*").alias("c"))
    sums = cells.groupBy("simulation").agg(F.sum(_term(F.col("c"), F.col("rate"))).alias("hits"))
    whole = F.broadcast(bins.agg(F.sum("rate").alias("total")))
    return counts.join(sums, "simulation", "left").crossJoin(whole).select("simulation", (F.coalesce("hits", F.lit(0.0)) - F.col("total")).alias("statistic"))


def quantile_verdict(bins: DataFrame, conditional: bool, simulations: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """observed, n_obs, quantile (the share of simulated statistics at most the observed one) and passed. Without events there is no verdict."""
    if conditional:
        bins = scaled_to_count(bins)
    observed = observed_statistic(bins)
    if conditional:
        n = bins.agg(F.sum("n").alias("n_events"))
        counts = bins.sparkSession.range(simulations).withColumnRenamed("id", "simulation").crossJoin(F.broadcast(n))
    else:
        counts = poisson_counts(bins, simulations, seed)
    drawn = simulated_statistics(bins, counts, seed).crossJoin(F.broadcast(observed))
    out = drawn.agg(F.first("observed").alias("observed"), F.first("n_obs").alias("n_obs"), F.avg((F.round("statistic", 9) <= F.round("observed", 9)).cast("double")).alias("quantile"))
    quantile = F.when(F.col("n_obs") > 0, F.col("quantile"))
    return out.select("observed", "n_obs", quantile.alias("quantile"), (quantile >= alpha).alias("passed"))


def consistency_tests(bins: DataFrame, simulations: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """One row each for L, CL, S and M. bins: cell_ix, m_bin, rate, n."""
    bins = written(bins, "bins")
    wide = bins.withColumn("bin", F.col("cell_ix") * F.lit(1000) + F.col("m_bin")).select("bin", "rate", "n")
    sides = (("L", wide, False), ("CL", wide, True), ("S", marginal(bins, "cell_ix"), True), ("M", marginal(bins, "m_bin"), True))
    out = [quantile_verdict(b, conditional, simulations, seed, alpha).select(F.lit(name).alias("test"), "*") for name, b, conditional in sides]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def number_test(bins: DataFrame, alpha: float = 0.05) -> DataFrame:
    """delta1 = P(X >= n), delta2 = P(X <= n) of the forecast's total; passed if both reach alpha / 2."""
    total = bins.agg(F.sum("n").alias("n_obs"), F.sum("rate").alias("expected"))
    n = F.col("n_obs").cast("long")
    sums = total.select("n_obs", "expected", (F.lit(1.0) - tails.poisson_cdf(n - 1, F.col("expected"))).alias("delta1"), tails.poisson_cdf(n, F.col("expected")).alias("delta2"))
    return sums.withColumn("passed", F.least("delta1", "delta2") >= alpha / 2)


def rate_multiplier(bins: DataFrame, factor: float) -> DataFrame:
    """The alternative whose rates are all multiplied."""
    return bins.withColumn("rate", F.col("rate") * F.lit(factor))


def spatial_concentration(bins: DataFrame, power: float) -> DataFrame:
    """The alternative whose cells' shares are raised to a power and normalised, each magnitude bin keeping its own share."""
    cell, whole = Window.partitionBy("cell_ix"), Window.partitionBy()
    rows = bins.withColumn("in_cell", F.sum("rate").over(cell)).withColumn("total", F.sum("rate").over(whole)).withColumn("bins", F.count("*").over(cell))
    rows = rows.withColumn("raised", F.when(F.col("in_cell") > 0, F.pow(F.col("in_cell") / F.col("total"), F.lit(power))).otherwise(F.lit(0.0)))
    norm = F.sum(F.col("raised") / F.col("bins")).over(whole)
    return rows.withColumn("rate", F.when(F.col("in_cell") > 0, F.col("rate") / F.col("in_cell") * F.col("raised") / norm * F.col("total")).otherwise(F.lit(0.0))).select(*bins.columns)


def spatial_hotspot(bins: DataFrame, cells: list[int], share: float) -> DataFrame:
    """The alternative that puts a share of the total into some cells, evenly over them, and the rest where it was."""
    whole = Window.partitionBy()
    hot = F.col("cell_ix").isin(cells)
    rows = bins.withColumn("total", F.sum("rate").over(whole)).withColumn("m_share", F.sum("rate").over(Window.partitionBy("m_bin")) / F.sum("rate").over(whole))
    moved = F.when(hot, F.lit(share) * F.col("total") * F.col("m_share") / F.lit(float(len(cells)))).otherwise(F.lit(0.0))
    return rows.withColumn("rate", F.col("rate") * F.lit(1 - share) + moved).select(*bins.columns)


def magnitude_tilt(bins: DataFrame, delta_b: float, width: float) -> DataFrame:
    """The alternative with another b value at the same total: rates times 10 ** (-delta_b m), renormalised."""
    tilted = F.col("rate") * F.pow(F.lit(10.0), F.lit(-delta_b * width) * F.col("m_bin"))
    rows = bins.withColumn("tilted", tilted)
    whole = Window.partitionBy()
    return rows.withColumn("rate", F.col("tilted") * F.sum("rate").over(whole) / F.sum("tilted").over(whole)).select(*bins.columns)


def simulated_power(forecast: DataFrame, alternative: DataFrame, simulations: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Share of catalogues drawn from the alternative whose likelihood under the forecast is below the forecast's own alpha quantile, and the same for catalogues of the forecast itself.

    forecast and alternative: bin, rate. The threshold is the largest simulated statistic below which at most alpha of the forecast's statistics lie; nothing is interpolated.
    """
    forecast, alternative = written(forecast, "bins"), written(alternative, "bins")
    own = written(simulated_statistics(forecast, poisson_counts(forecast, simulations, seed), seed), "statistics").withColumn("rank", F.row_number().over(Window.orderBy("statistic")))
    bound = own.filter(F.col("rank") == max(1, int(alpha * simulations))).agg(F.max("statistic").alias("bound"))
    held = forecast.select(F.col("bin").alias("of"), F.col("rate").alias("own_rate"))
    rates = alternative.join(held, F.col("bin") == F.col("of")).select("bin", "rate", "own_rate")
    drawn = _cross_statistics(rates, poisson_counts(alternative, simulations, seed + 10), seed + 10)
    power = drawn.crossJoin(F.broadcast(bound)).agg(F.avg((F.col("statistic") < F.col("bound")).cast("double")).alias("power"))
    level = own.crossJoin(F.broadcast(bound)).agg(F.avg((F.col("statistic") < F.col("bound")).cast("double")).alias("level"))
    return power.crossJoin(level)


def _cross_statistics(rates: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """Statistics under own_rate of catalogues drawn from rate."""
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("rate").over(Window.partitionBy())
    edges = rates.select("bin", "own_rate", (F.sum("rate").over(upto) / total).alias("high"), (F.col("rate") / total).alias("share")).withColumn("low", F.col("high") - F.col("share"))
    slice_of = lambda c: F.least(F.lit(SLICES - 1), F.floor(c * SLICES)).cast("int")
    edges = edges.withColumn("slice", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high")))))
    events = numbered(counts).withColumn("u", uniform(seed + 1, "simulation", "k")).withColumn("slice_of", slice_of(F.col("u")))
    hit = events.join(F.broadcast(edges), (F.col("slice_of") == F.col("slice")) & (F.col("u") > F.col("low")) & (F.col("u") <= F.col("high")))
    cells = hit.groupBy("simulation", "bin", "own_rate").agg(F.count("*").alias("c"))
    sums = cells.groupBy("simulation").agg(F.sum(_term(F.col("c"), F.col("own_rate"))).alias("hits"))
    whole = F.broadcast(rates.agg(F.sum("own_rate").alias("total")))
    return counts.join(sums, "simulation", "left").crossJoin(whole).select("simulation", (F.coalesce("hits", F.lit(0.0)) - F.col("total")).alias("statistic"))
