"""Losses: damage states, annual losses, exceedance, layers, apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seismology as S
from ..functions.shared_draws import uniform
from ..plans.quantiles import linear_quantiles


def expected_ratio(im: Column, states: list[tuple[float, float, float]]) -> Column:
    """Mean damage ratio at an intensity for lognormal states (median, beta, ratio) in rising order; state probabilities are successive differences, clamped at 0."""
    above = [S.normal_cdf(F.log(im / F.lit(median)) / F.lit(beta)) for median, beta, _ in states]
    after = [*above[1:], F.lit(0.0)]
    return sum((F.greatest(F.lit(0.0), p - q) * F.lit(ratio) for p, q, (_, _, ratio) in zip(above, after, states, strict=True)), F.lit(0.0))


def portfolio_losses(assets: DataFrame, fields: DataFrame, states: list[tuple[float, float, float]]) -> DataFrame:
    """assets (asset_id, site_id, value), fields (realisation, site_id, im): loss by realisation."""
    loss = F.col("value") * expected_ratio(F.col("im"), states)
    return assets.join(fields, "site_id").groupBy("realisation").agg(F.sum(loss).alias("loss"))


def money_range(losses: DataFrame, key: list[str], loss: str, level: float = 0.9) -> DataFrame:
    """Mean and linear quantiles by group, widened to hold the mean and not below 0."""
    tail = (1 - level) / 2
    mean = losses.groupBy(*(F.col(k).alias(f"of_{k}") for k in key)).agg(F.avg(loss).alias("mean"))
    ends = linear_quantiles(losses, key, loss, {"q_low": tail, "q_high": 1 - tail})
    match = F.lit(True)
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    rows = ends.join(mean, match)
    return rows.select(*key, "mean", F.greatest(F.lit(0.0), F.least("q_low", "mean")).alias("low"), F.greatest("q_high", "mean").alias("high"))


def annual_losses(events: DataFrame, catalogues: DataFrame, duration: float) -> DataFrame:
    """events (catalogue, loss): annual loss of every catalogue, those without events included."""
    sums = events.groupBy("catalogue").agg(F.sum("loss").alias("loss"))
    return catalogues.join(sums, "catalogue", "left").select("catalogue", (F.coalesce("loss", F.lit(0.0)) / F.lit(duration)).alias("loss"))


def aggregate_exceedance(losses: DataFrame, duration: float, n: int, periods: list[float]) -> DataFrame:
    """Linear quantiles of annual totals at 1 - duration / T, for return periods the catalogues resolve."""
    kept = [t for t in periods if duration <= t <= n * duration]
    names = {f"p{k}": 1 - duration / t for k, t in enumerate(kept)}
    points = linear_quantiles(losses, [], "loss", names)
    pairs = F.array(*(F.struct(F.lit(t).alias("period"), F.col(f"p{k}").alias("loss")) for k, t in enumerate(kept)))
    return points.select(F.explode(pairs).alias("p")).select("p.*")


def average_annual_loss(losses: DataFrame) -> DataFrame:
    """Mean over catalogues of annual losses (catalogue, loss)."""
    return losses.agg(F.avg("loss").alias("aal"))


def bootstrap_money(losses: DataFrame, replicates: int, seed: int, level: float = 0.9) -> DataFrame:
    """losses (catalogue numbered from 0, loss): mean, and the percentile interval of the means of resampled catalogues. Replicates are few; each draws as many catalogues as there are."""
    n = losses.count()
    draws = losses.sparkSession.range(replicates).withColumnRenamed("id", "replicate").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = F.least(F.lit(n - 1), F.floor(uniform(seed, "replicate", "k") * n)).cast("long")
    means = draws.select("replicate", pick.alias("picked")).join(losses, F.col("picked") == F.col("catalogue")).groupBy("replicate").agg(F.avg("loss").alias("mean_loss"))
    tail = (1 - level) / 2
    ends = linear_quantiles(means, [], "mean_loss", {"low": tail, "high": 1 - tail})
    return losses.agg(F.avg("loss").alias("mean")).crossJoin(ends)


def scaled_by_layer(losses: DataFrame, attachment: float, limit: float) -> DataFrame:
    """losses (event_id, asset_id, loss): losses net of the layer, each asset's share of an event's total kept; 1 where the total is 0."""
    total = losses.groupBy(F.col("event_id").alias("of")).agg(F.sum("loss").alias("total"))
    net = F.when(F.col("total") > 0, (F.col("total") - insurance_layer(F.col("total"), attachment, limit)) / F.col("total")).otherwise(F.lit(1.0))
    return losses.join(total, F.col("event_id") == F.col("of")).select("event_id", "asset_id", (F.col("loss") * net).alias("loss"))


def bad_shares(components: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Taxonomies of components (taxonomy, component, share) whose shares don't sum to 1: a sound table has none."""
    return components.groupBy("taxonomy").agg(F.sum("share").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def component_losses(assets: DataFrame, components: DataFrame, fields: DataFrame) -> DataFrame:
    """assets (asset_id, site_id, taxonomy, value), components (taxonomy, component, share, and states, an array of (median, beta, ratio) in rising order), fields (realisation, site_id, im):
    realisation, component and loss."""
    rows = assets.join(fields, "site_id").join(components, "taxonomy")
    above = F.transform("states", lambda s: F.when(F.col("im") > 0, S.normal_cdf(F.log(F.col("im") / s["median"]) / s["beta"])).otherwise(F.lit(0.0)))
    rows = rows.withColumn("above", F.concat(above, F.array(F.lit(0.0))))
    steps = F.transform(F.sequence(F.lit(0), F.size("states") - 1), lambda k: F.greatest(F.lit(0.0), F.get("above", k) - F.get("above", k + 1)) * F.get("states", k)["ratio"])
    ratio = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("realisation", "component").agg(F.sum(F.col("value") * F.col("share") * ratio).alias("loss"))


def capacity_value(assets: DataFrame, usd_per_kw: float, low: float, high: float) -> DataFrame:
    """assets (asset_id, capacity_mw): replacement value as an assumed interval."""
    best = F.col("capacity_mw") * F.lit(1000.0 * usd_per_kw)
    return assets.select("asset_id", (best * F.lit(low)).alias("low"), best.alias("best"), (best * F.lit(high)).alias("high"))


def import_problems(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows of an exposure table with what is wrong with them, all of it: missing values of required columns, places off the globe, values below 0, ids that come twice."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    twice = rows.groupBy(F.col("asset_id").alias("of")).agg(F.count("*").alias("copies")).filter("copies > 1").select("of", F.lit(True).alias("repeated"))
    checks = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in required]
    checks += [F.when(~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90), F.lit("off the globe")), F.when(F.col("value") < 0, F.lit("value below 0")), F.when(F.col("repeated"), F.lit("id comes twice"))]
    rows = rows.join(twice, F.col("asset_id") == F.col("of"), "left").withColumn("problems", F.array_compact(F.array(*checks)))
    return rows.filter(F.size("problems") > 0).select("asset_id", F.array_join("problems", "; ").alias("problems"))


def occurrence_exceedance(events: DataFrame, periods: list[float]) -> DataFrame:
    """events (loss, rate): the largest loss whose cumulative rate, from the largest on, reaches 1 / T. Rates are summed per loss bin first and within the deciding bins
    only after, so no task sorts all events."""
    binned = events.withColumn("bin", F.floor(F.log2(F.greatest("loss", F.lit(1e-12))) * 64).cast("long"))
    tops = binned.groupBy("bin").agg(F.sum("rate").alias("in_bin"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("above", F.coalesce(F.sum("in_bin").over(down), F.lit(0.0)))
    wanted = F.broadcast(events.sparkSession.createDataFrame([(float(t),) for t in periods], "period double"))
    deciding = tops.join(wanted, (F.col("above") < 1 / F.col("period")) & (F.col("above") + F.col("in_bin") >= 1 / F.col("period")))
    rows = binned.join(deciding, "bin")
    w = Window.partitionBy("period").orderBy(F.desc("loss"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.col("above") + F.sum("rate").over(w)).filter(F.col("upto") >= 1 / F.col("period")).groupBy("period").agg(F.max("loss").alias("loss"))


def insurance_layer(total: Column, attachment: float, limit: float) -> Column:
    return F.least(F.greatest(total - F.lit(attachment), F.lit(0.0)), F.lit(limit))


def branch_difference(base: DataFrame, branch: DataFrame) -> DataFrame:
    """Catalogue by catalogue avoided loss: mean, and the share of catalogues where it is negative."""
    return differences(base.join(branch.withColumnRenamed("loss", "other"), "catalogue"))


def differences(both: DataFrame) -> DataFrame:
    """both (catalogue, loss, other): mean of loss - other, and the share of catalogues where it is negative."""
    d = both.withColumn("d", F.col("loss") - F.col("other"))
    return d.agg(F.avg("d").alias("mean"), F.avg((F.col("d") < 0).cast("double")).alias("negative_share"))


def largest_remainder(weights: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """n shared out by weight: whole parts, and the rest to the largest remainders (first key of equal ones)."""
    share = F.lit(float(n)) * F.col(weight) / F.sum(weight).over(Window.partitionBy())
    rows = weights.select(key, F.floor(share).cast("long").alias("whole"), F.round(share - F.floor(share), 9).alias("rest"))
    left = F.lit(n) - F.sum("whole").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), key))
    return rows.withColumn("extra", (rank <= left).cast("long")).select(key, (F.col("whole") + F.col("extra")).alias("n"))


def unpivot_curves(wide: DataFrame, key: list[str], prefix: str = "poe-") -> DataFrame:
    """Hazard curves from columns poe-<level> to rows (key, level, poe)."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot(key, [f"`{c}`" for c in names], "name", "poe").select(*key, F.expr(f"CAST(substring(name, {len(prefix) + 1}) AS double)").alias("level"), "poe")


def rising_curves(curves: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose probability exceeds that of the level before: a sound curve has none."""
    before = F.lag("poe").over(Window.partitionBy(*key).orderBy("level"))
    return curves.withColumn("before", before).filter(F.col("poe") > F.col("before") + F.lit(1e-12))


def log_interpolated(wanted: DataFrame, table: DataFrame, at: str = "period", value: str = "coefficient") -> DataFrame:
    """Coefficients at wanted periods, linear in the logarithm of the period between the rows around; outside the table there are none."""
    w = Window.orderBy(at)
    spans = table.select(F.col(at).alias("p0"), F.col(value).alias("c0"), F.lead(at).over(w).alias("p1"), F.lead(value).over(w).alias("c1")).filter("p1 IS NOT NULL")
    part = F.log(F.col(at) / F.col("p0")) / F.log(F.col("p1") / F.col("p0"))
    inside = (F.col(at) >= F.col("p0")) & (F.col(at) <= F.col("p1"))
    return wanted.join(F.broadcast(spans), inside).groupBy(at).agg(F.max(F.col("c0") + part * (F.col("c1") - F.col("c0"))).alias(value))
