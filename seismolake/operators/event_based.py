"""Event-based losses: ground motion of every event at every site, losses of assets, annual figures, warnings and layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, motion
from ..functions.shared_draws import uniform
from ..plans import nearby
from . import risk


def truncated_normal(u: Column, v: Column, level: float) -> Column:
    """Standard normal from two draws (Box and Muller), clipped to the level."""
    z = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
    return F.greatest(F.lit(-level), F.least(F.lit(level), z))


def fields(events: DataFrame, sites: DataFrame, mean_ln: Callable[[Column, Column], Column], tau: float, phi: float, level: float, seed: int, reach_km: float) -> DataFrame:
    """events (event_id, lon, lat, depth_km, mag) and sites (site_id, s_lon, s_lat): im, hypocentral_km of the pairs within reach, anywhere on the sphere.

    Sites meet events by cells as large as the reach. One draw for an event, one for an event and site; level 0 is the median.
    """
    places = sites.select("site_id", F.col("s_lon").alias("lon"), F.col("s_lat").alias("lat"))
    met = nearby.pairs_within(places, events.select("event_id", "lon", "lat", "depth_km", "mag"), F.lit(float(reach_km)), reach_km, least_km=reach_km)
    rows = met.select(F.col("event_id_r").alias("event_id"), F.col("site_id_l").alias("site_id"), F.col("mag_r").alias("mag"), kernels.hypocentral_km(F.col("km"), F.col("depth_km_r")).alias("hypocentral_km"))
    rows = rows.filter(F.col("hypocentral_km") <= reach_km)
    between = truncated_normal(uniform(seed, "event_id"), uniform(seed + 1, "event_id"), level)
    within = truncated_normal(uniform(seed + 2, "event_id", "site_id"), uniform(seed + 3, "event_id", "site_id"), level)
    spread = F.lit(0.0) if level == 0 else F.lit(tau) * between + F.lit(phi) * within
    return rows.select("event_id", "site_id", "hypocentral_km", F.exp(mean_ln(F.col("mag"), F.col("hypocentral_km")) + spread).alias("im"))


def logic_tree_fields(
    events: DataFrame, sites: DataFrame, branches: list[tuple[str, float, float]], realisations: int, level: float, seed: int, reach_km: float, coefficients: dict[str, float] = motion.PGA_2014
) -> DataFrame:
    """event_id, site_id, realisation, branch, mean_ln and im of events (event_id, lon, lat, mag, rake) at sites (site_id, s_lon, s_lat, vs30) within reach of their epicentres.

    branches: name, weight and regional loss with distance. Realisations are apportioned by weight, so weights are met exactly and not in the mean; an event has one draw a realisation for all sites, and each site one of its own.
    """
    places = sites.select("site_id", F.col("s_lon").alias("lon"), F.col("s_lat").alias("lat"), "vs30")
    met = nearby.pairs_within(places, events.select("event_id", "lon", "lat", "mag", "rake"), F.lit(float(reach_km)), reach_km, least_km=reach_km)
    shares = motion.allocation([w for _, w, _ in branches], realisations)
    plan = [(name, loss) for (name, _, loss), n in zip(branches, shares, strict=True) for _ in range(n)]
    each = F.posexplode(F.array(*(F.struct(F.lit(name).alias("branch"), F.lit(float(loss)).alias("loss")) for name, loss in plan))).alias("realisation", "b")
    rows = met.select(F.col("event_id_r").alias("event_id"), F.col("site_id_l").alias("site_id"), F.col("mag_r").alias("mag"), F.col("rake_r").alias("rake"), F.col("vs30_l").alias("vs30"), "km", each)
    own = lambda name: F.col("b.loss") if name == "Dc3" else F.lit(float(coefficients[name]))
    mean, tau, phi = motion.boore_2014(own, own, F.col("mag"), F.col("rake"), F.col("km"), F.col("vs30"))
    between = truncated_normal(uniform(seed, "event_id", "realisation"), uniform(seed + 1, "event_id", "realisation"), level)
    within = truncated_normal(uniform(seed + 2, "event_id", "realisation", "site_id"), uniform(seed + 3, "event_id", "realisation", "site_id"), level)
    noise = F.lit(0.0) if level == 0 else tau * between + phi * within
    return rows.select("event_id", "site_id", "realisation", F.col("b.branch").alias("branch"), mean.alias("mean_ln"), F.exp(mean + noise).alias("im"))


def asset_losses(shaken: DataFrame, assets: DataFrame, states: list[tuple[float, float, float]]) -> DataFrame:
    """assets (asset_id, site_id, value): event_id, asset_id, loss."""
    joined = shaken.join(assets, "site_id")
    return joined.select("event_id", "asset_id", "hypocentral_km", "im", (F.col("value") * risk.expected_ratio(F.col("im"), states)).alias("loss"))


def with_shutdown(losses: DataFrame, threshold: float, s_wave_km_s: float, latency_s: float, kept: float) -> DataFrame:
    """losses with a warning in time reduced to the part `kept`."""
    fires = kernels.shutdown_fires(F.col("im"), F.col("hypocentral_km"), threshold, s_wave_km_s, latency_s)
    return losses.withColumn("loss", F.when(fires, F.col("loss") * F.lit(kept)).otherwise(F.col("loss")))


def annual(losses: DataFrame, catalogue_of: DataFrame, catalogues: DataFrame, duration: float) -> DataFrame:
    """Annual loss by catalogue; catalogue_of (event_id, catalogue)."""
    by_event = losses.groupBy("event_id").agg(F.sum("loss").alias("loss")).join(catalogue_of, "event_id")
    return risk.annual_losses(by_event.select("catalogue", "loss"), catalogues, duration)


def annual_branches(losses: DataFrame, catalogue_of: DataFrame, catalogues: DataFrame, duration: float) -> DataFrame:
    """losses (event_id, loss, other): annual loss and other by catalogue. Both are summed over the same rows in the same order, whatever the order is, so the other isn't larger by rounding where no event's is."""
    by_event = losses.groupBy("event_id").agg(F.sum("loss").alias("loss"), F.sum("other").alias("other")).join(catalogue_of, "event_id")
    sums = by_event.groupBy("catalogue").agg(F.sum("loss").alias("loss"), F.sum("other").alias("other"))
    return catalogues.join(sums, "catalogue", "left").select("catalogue", *((F.coalesce(c, F.lit(0.0)) / F.lit(duration)).alias(c) for c in ("loss", "other")))
