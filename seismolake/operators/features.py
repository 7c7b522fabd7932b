"""Features of gridded models: raster frames of the past, static covariates, occupancy labels, samples. Rasters are tables (frame, cell_ix); only what isn't zero is held."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seismology as S


def dynamic_frames(events: DataFrame, issue: int, n_frames: int, frame_us: int, mc: float) -> DataFrame:
    """events (t_us, cell_ix, mag): frame and cell_ix with log1p of the number of events from mc on, from mc - 1 on, and of the summed 10 ** (mag - mc), in the frames before the issue."""
    start = issue - n_frames * frame_us
    rows = events.filter((F.col("t_us") >= start) & (F.col("t_us") < issue) & (F.col("cell_ix") >= 0) & (F.col("mag") >= mc - 1))
    frame = F.least(F.lit(n_frames - 1), F.floor((F.col("t_us") - F.lit(start)) / F.lit(frame_us))).cast("long")
    full = F.col("mag") >= mc
    moment = F.when(full, F.pow(F.lit(10.0), F.col("mag") - F.lit(mc))).otherwise(F.lit(0.0))
    sums = rows.groupBy(frame.alias("frame"), "cell_ix").agg(F.count_if(full).alias("n"), F.count("*").alias("n_dense"), F.sum(moment).alias("moment"))
    return sums.select("frame", "cell_ix", *(F.log1p(F.col(c).cast("double")).alias(c) for c in ("n", "n_dense", "moment")))


def gaussian_blur(raster: DataFrame, nx: int, ny: int, sigma: float, value: str = "value") -> DataFrame:
    """raster (ix, iy, value), complete: separable Gaussian blur with edges reflected about the outer cells' centres."""
    radius = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.broadcast(raster.sparkSession.createDataFrame([(k - radius, w / sum(weights)) for k, w in enumerate(weights)], "o int, w double"))
    out = raster.select("ix", "iy", F.col(value).cast("double").alias("v"))
    for axis, size in (("ix", nx), ("iy", ny)):
        other = "iy" if axis == "ix" else "ix"
        period = max(1, 2 * (size - 1))
        at = F.pmod(F.col("to") + F.col("o"), F.lit(period))
        taps = raster.sparkSession.range(size).select(F.col("id").alias("to")).join(kernel).select("to", F.when(at < size, at).otherwise(F.lit(period) - at).alias("source"), "w")
        taps = F.broadcast(taps.groupBy("to", "source").agg(F.sum("w").alias("w")))
        out = out.join(taps, F.col(axis) == F.col("source")).groupBy(F.col("to").alias(axis), other).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("ix", "iy", F.col("v").alias(value))


def static_covariates(events: DataFrame, lattice: DataFrame, cutoff: int, mc: float, depth_max: float, shallow_km: float = 15.0) -> DataFrame:
    """cell_ix with log1p counts from mc on, mean depth as a part of depth_max, and the share of shallow events, strictly before the cut-off. Cells without events take the region's means."""
    rows = events.filter((F.col("t_us") < cutoff) & (F.col("cell_ix") >= 0) & F.col("depth_km").isNotNull())
    shallow = (F.col("depth_km") <= shallow_km).cast("double")
    own = rows.groupBy("cell_ix").agg(F.count_if(F.col("mag") >= mc).alias("n"), F.avg("depth_km").alias("depth"), F.avg(shallow).alias("shallow"))
    every = F.broadcast(rows.agg(F.avg("depth_km").alias("all_depth"), F.avg(shallow).alias("all_shallow")))
    cells = lattice.select("cell_ix").join(own, "cell_ix", "left").crossJoin(every)
    depth = F.coalesce("depth", "all_depth", F.lit(0.0)) / F.lit(max(depth_max, 1.0))
    return cells.select("cell_ix", F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("log_n"), depth.alias("depth"), F.coalesce("shallow", "all_shallow", F.lit(0.0)).alias("shallow"))


def climatology(counts: DataFrame, nx: int, ny: int, sigma: float, frames_seen: float) -> DataFrame:
    """counts (cell_ix, ix, iy, n): log of the expected events of a cell and frame: 99 % by the blurred counts, 1 % evenly."""
    blurred = gaussian_blur(counts.select("ix", "iy", F.col("n").cast("double").alias("value")), nx, ny, sigma)
    whole = Window.partitionBy()
    rows = counts.join(blurred, ["ix", "iy"])
    total, cells = F.sum("value").over(whole), F.count("*").over(whole)
    share = F.when(total > 0, F.lit(0.99) * F.col("value") / total + F.lit(0.01) / cells).otherwise(F.lit(1.0) / cells)
    expected = F.greatest(F.sum("n").over(whole) / F.lit(max(1.0, frames_seen)), F.lit(1e-6))
    return rows.select("cell_ix", F.log(F.greatest(share * expected, F.lit(1e-12))).alias("log_prior"))


def occupancy_labels(counts: DataFrame) -> DataFrame:
    """counts (cell_ix, n): 1 where anything happened."""
    return counts.select("cell_ix", (F.col("n") > 0).cast("int").alias("y"), "n")


def expected_from_occupancy(cells: DataFrame, mean_events: float, training_days: float, horizon_days: float, rate_scale: float | None = None) -> DataFrame:
    """cells (cell_ix, p): expected counts of a horizon from occupancy probabilities; what isn't a positive number is 0."""
    if rate_scale is not None and not (math.isfinite(rate_scale) and rate_scale >= 0):
        raise ValueError("a rate scale must be finite and not negative")
    scale = mean_events * horizon_days / training_days if rate_scale is None else rate_scale
    value = F.col("p") * F.lit(scale)
    return cells.select("cell_ix", F.when(value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf")), value).otherwise(F.lit(0.0)).alias("expected"))


def over_magnitude_bins(cells: DataFrame, pmf: DataFrame) -> DataFrame:
    """cells (cell_ix, expected) times pmf (m_bin, mass): rates of all bins."""
    return cells.join(F.broadcast(pmf)).select("cell_ix", "m_bin", F.greatest(F.col("expected") * F.col("mass"), F.lit(0.0)).alias("rate"))


def log10_distance(lattice: DataFrame, anchors: DataFrame, size: float, floor_km: float) -> DataFrame:
    """cell_ix and log10 of the distance from its centre to the nearest anchor (lon, lat), at least floor_km. Anchors are large events, few enough to be broadcast."""
    lon, lat = F.col("lon0") + F.lit(size / 2), F.col("lat0") + F.lit(size / 2)
    km = S.haversine_km(lat, lon, F.col("a_lat"), F.col("a_lon"))
    near = lattice.join(F.broadcast(anchors.select(F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))))
    return near.groupBy("cell_ix").agg(F.log10(F.greatest(F.min(km), F.lit(floor_km))).alias("log_km"))


def training_span_days(events: DataFrame, cutoff: int) -> DataFrame:
    """Days from the first event used to the cut-off."""
    return events.filter(F.col("t_us") < cutoff).agg(((F.lit(cutoff) - F.min("t_us")) / F.lit(8.64e10)).alias("days"))


def sample_set(frames: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """frames (issue, frame, cell_ix, ...) and targets (issue, cell_ix, n) as one row a cell and issue: what was known, by frame, and what came."""
    held = frames.groupBy("issue", "cell_ix").agg(F.sort_array(F.collect_list(F.struct("frame", *keys))).alias("past"))
    return targets.join(held, ["issue", "cell_ix"], "left").select("issue", "cell_ix", "n", "past")
