"""Catalogue algebra: filters, vintages, completeness, magnitudes, guards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seismology as S
from ..plans import skew
from ..plans.quantiles import values_at

EVENT_TYPES = ("earthquake", "landslide", "explosion", "other")


def before(events: DataFrame, cutoff: int) -> DataFrame:
    return events.filter(F.col("t_us") < cutoff)


def between(events: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open [start, end)."""
    if end <= start:
        raise ValueError("a window must end after it starts")
    return events.filter((F.col("t_us") >= start) & (F.col("t_us") < end))


def as_of(events: DataFrame, instant: int, keep_unknown: bool) -> DataFrame:
    """Records available before the instant; those of unknown vintage by the policy that the caller must name."""
    return events.filter(F.coalesce(F.col("avail_us") < instant, F.lit(keep_unknown)))


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("etype").isin(*types))


def at_least(events: DataFrame, mag: float) -> DataFrame:
    return events.filter(F.col("mag") >= mag)


def revised_after(events: DataFrame, instant: int) -> DataFrame:
    return events.filter(F.col("avail_us") >= instant)


def history(events: DataFrame, issue: int, mc: float) -> DataFrame:
    return before(at_least(of_type(events, "earthquake"), mc), issue)


def event_hash(events: DataFrame) -> DataFrame:
    """SHA-256 over the sorted `id|time` lines, by a tree: lines are digested per thousand ids, digests per thousand of these, and so on for four levels, so no row holds more than about a thousand."""
    chunk = F.floor(F.col("event_id") / 1000).cast("long")
    level = events.select(chunk.alias("chunk"), F.concat_ws("|", "event_id", "t_us").alias("line")).groupBy("chunk").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))
    for last in (False, False, True):
        up = F.lit(0).cast("long") if last else F.floor(F.col("chunk") / 1000).cast("long")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"])
        level = level.groupBy(up.alias("up")).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest")).withColumnRenamed("up", "chunk")
    return level.select(F.col("digest").alias("event_hash"))


def count_by_type(events: DataFrame) -> DataFrame:
    """Counts with the types that don't occur."""
    kinds = events.sparkSession.createDataFrame([(t,) for t in EVENT_TYPES], "etype string")
    counts = events.groupBy("etype").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(counts, "etype", "left").select("etype", F.coalesce("n", F.lit(0)).alias("n"))


def vintage_summary(events: DataFrame, reference: int) -> DataFrame:
    """Counts, and nearest-rank quantiles of the lags in days, by counts of bins of lags rather than a sorted list."""
    lags = events.filter("avail_us IS NOT NULL").select((F.col("avail_us") - F.col("t_us")).alias("lag"))
    at = lambda q: lambda n: F.bround(F.lit(q) * (n - 1), 0)
    got = values_at(lags, [], "lag", {"median_days": at(0.5), "p90_days": at(0.9), "max_days": at(1.0)})
    counts = events.agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("avail_us").isNull()).alias("n_unknown"),
        F.count_if(F.col("avail_us") >= reference).alias("n_revised"),
    )
    days = [(F.col(c) / F.lit(8.64e10)).alias(c) for c in ("median_days", "p90_days", "max_days")]
    return counts.join(F.broadcast(got.select(*days)), F.lit(True), "left")


def exclusion_funnel(events: DataFrame, least: float, start: int, end: int) -> DataFrame:
    reason = (
        F.when(F.col("etype") != "earthquake", "not_earthquake")
        .when(F.col("mag").isNull(), "no_magnitude")
        .when(F.col("mag") < least, "below_threshold")
        .when(~((F.col("t_us") >= start) & (F.col("t_us") < end)), "outside_window")
        .otherwise("used")
    )
    return events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def magnitude_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("mbin").agg(F.count("*").alias("n"))


def maximum_curvature(events: DataFrame, correction: float = 0.2) -> DataFrame:
    """The lowest of the fullest magnitude bins, and the completeness it stands for."""
    top = magnitude_counts(events).agg(F.max(F.struct("n", (-F.col("mbin")).alias("low"))).alias("top"))
    mode = -F.col("top.low")
    return top.select(mode.alias("mode_bin"), F.col("top.n").alias("mode_n"), F.round(mode * F.lit(0.1) + F.lit(correction), 2).alias("mc"))


def b_value(events: DataFrame, mc_bin: int) -> DataFrame:
    """Aki's b of magnitudes from mc_bin tenths on, and Shi and Bolt's sigma; null below two events."""
    m = F.col("mbin") * F.lit(0.1)
    stats = events.filter(F.col("mbin") >= mc_bin).agg(F.count("*").alias("n"), F.avg(m).alias("mean"), F.var_samp(m).alias("var"))
    b = F.lit(math.log10(math.e)) / (F.col("mean") - F.lit(mc_bin * 0.1 - 0.05))
    return stats.select("n", F.when(F.col("n") > 1, b).alias("b"), F.when(F.col("n") > 1, F.lit(2.3) * b * b * F.sqrt(F.col("var") / F.col("n"))).alias("sigma"))


def mc_and_b(events: DataFrame) -> DataFrame:
    """Maximum curvature and Aki's b above it, in one plan over the magnitude counts."""
    counts = magnitude_counts(events)
    mc = maximum_curvature(events).withColumn("mc_bin", F.col("mode_bin") + 2)
    m = F.col("mbin") * F.lit(0.1)
    s = counts.join(F.broadcast(mc), F.col("mbin") >= F.col("mc_bin")).groupBy("mode_bin", "mode_n", "mc", "mc_bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * m).alias("total"))
    b = F.lit(math.log10(math.e)) / (F.col("total") / F.col("n") - (F.col("mc_bin") * F.lit(0.1) - F.lit(0.05)))
    return s.select("mode_bin", "mode_n", "mc", "n", F.round(b, 6).alias("b"))


def b_value_stability(events: DataFrame, least: int = 30, ahead: int = 5) -> DataFrame:
    """b and sigma at every cut-off bin, with the mean of b over it and the next cut-offs; stable where all have enough events and they agree within sigma."""
    counts = magnitude_counts(events)
    up = Window.orderBy(F.desc("mbin")).rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("mbin") * F.lit(0.1)
    s = counts.select("mbin", F.sum("n").over(up).alias("n"), F.sum(F.col("n") * m).over(up).alias("s1"), F.sum(F.col("n") * m * m).over(up).alias("s2"))
    b = F.lit(math.log10(math.e)) / (F.col("s1") / F.col("n") - (m - F.lit(0.05)))
    sigma = F.lit(2.3) * b * b * F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") * (F.col("n") - 1)))
    s = s.filter(F.col("n") >= least).select("mbin", "n", b.alias("b"), sigma.alias("sigma"))
    on = Window.orderBy("mbin").rowsBetween(0, ahead)
    whole = (F.count("*").over(on) == ahead + 1) & (F.max("mbin").over(on) == F.col("mbin") + ahead)
    s = s.withColumn("mean_b", F.when(whole, F.avg("b").over(on)))
    return s.withColumn("stable", F.coalesce(F.abs(F.col("mean_b") - F.col("b")) <= F.col("sigma"), F.lit(False)))


def stai_current(events: DataFrame, background: float) -> DataFrame:
    """Completeness at each event: the largest over strictly earlier triggers, floored by the background. A trigger's curve is above the background for its own time only;
    triggers meet events in time cells at least as long as that, by classes of cell sizes that are powers of eight, and those not above the background stay out. The largest classes have few triggers and long cells, whose
    events are split over tasks."""
    reach = F.ceil(F.pow(F.lit(10.0), (F.col("mag") - F.lit(4.5 + background)) / F.lit(0.75)) * F.lit(8.64e10)) + F.lit(1)
    triggers = events.filter(F.col("mag") > background).select(F.col("t_us").alias("began"), "mag", reach.alias("reach"))
    triggers = triggers.withColumn("size", F.pow(F.lit(8.0), F.ceil(F.log(F.col("reach").cast("double")) / F.lit(math.log(8)) + F.lit(1e-9))).cast("long"))
    cell = lambda t: F.floor(F.col(t) / F.col("size")).cast("long")
    placed = triggers.withColumn("cell", F.explode(F.array(cell("began"), cell("began") + 1)))
    looked = events.select("event_id", "t_us").crossJoin(F.broadcast(triggers.select("size").distinct())).withColumn("cell", cell("t_us"))
    pairs = skew.split_join(looked, placed, ["size", "cell"], "event_id").filter("began < t_us AND t_us - began <= reach")
    mc = S.stai_completeness(F.col("mag"), (F.col("t_us") - F.col("began")) / F.lit(8.64e10))
    best = pairs.groupBy("event_id").agg(F.max(mc).alias("raised"))
    return events.select("event_id").join(best, "event_id", "left").select("event_id", F.greatest(F.lit(background), F.col("raised")).alias("mc"))


def refuse_after(events: DataFrame, cutoff: int, what: str) -> DataFrame:
    """The events, with a check inside the plan that raises if any is not before the cutoff: leaks are refused, not filtered."""
    late = F.col("t_us") >= cutoff
    return events.filter(F.when(late, F.raise_error(F.lit(f"{what}: an event is not before the cutoff")).cast("boolean")).otherwise(True))


def parse_rejects(events: DataFrame) -> DataFrame:
    """Counts of rows by what their JSON properties lack."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    reason = F.when(F.col("props").isNull(), "no_props").when(k.isNull(), "no_key").when(k > 50, "out_of_range").otherwise("ok")
    return events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def preferred(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least by order, with the sorted set of contributing ids; for keys of few records, such as merged events, as these are one row."""
    first = F.min(F.struct(*order)).alias("first")
    return events.groupBy(*key).agg(first, F.sort_array(F.collect_set("event_id")).alias("ids")).select(*key, "first.*", "ids")


def bounds(events: DataFrame) -> DataFrame:
    """West, east, south, north and depths of a catalogue: one row, nulls if it is empty."""
    ends = [f(c).alias(n) for c, low, high in (("lon", "west", "east"), ("lat", "south", "north"), ("depth_km", "shallowest", "deepest")) for f, n in ((F.min, low), (F.max, high))]
    return events.agg(*ends)


def depth_in_range(events: DataFrame, least: float, most: float) -> DataFrame:
    """The lower bound counts only above 0, as networks report small negative depths; unknown depths stay."""
    depth = F.col("depth_km")
    return events.filter(depth.isNull() | ((depth <= most) & (F.lit(least <= 0) | (depth >= least))))


def mw_coverage(events: DataFrame, threshold: float, mw: str = "mw") -> DataFrame:
    """Of the earthquakes reported at or above a threshold, in any scale, how many have a moment magnitude."""
    rows = events.filter((F.col("etype") == "earthquake") & (F.col("mag") >= threshold))
    return rows.agg(F.count(mw).alias("with_mw"), F.count("*").alias("total"))


def completeness_decision(events: DataFrame, threshold: float, least_b: float = 0.7, least_coverage: float = 0.8, force: bool = False) -> DataFrame:
    """Is the maximum-curvature completeness published? It needs a b value and a coverage, unless it is forced. events has mw."""
    rows = mc_and_b(events).crossJoin(F.broadcast(mw_coverage(events, threshold))).withColumn("coverage", F.when(F.col("total") > 0, F.col("with_mw") / F.col("total")).otherwise(F.lit(0.0)))
    sound = F.coalesce((F.col("b") >= least_b) & (F.col("coverage") >= least_coverage), F.lit(False))
    return rows.select("mc", "b", "coverage", sound.alias("sound"), F.when(sound | F.lit(force), F.col("mc")).alias("published"))


def left_apart(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs (a, b) that could be one event but stand in different clusters: what a merged catalogue must have few of."""
    held = lambda c: clusters.select(F.col("event_id").alias(f"of_{c}"), F.col("cluster").alias(f"cluster_{c}"))
    rows = pairs.join(held("a"), F.col("a") == F.col("of_a")).join(held("b"), F.col("b") == F.col("of_b"))
    return rows.filter("cluster_a <> cluster_b").select("a", "b")


def in_zone(events: DataFrame, lon: float, lat: float, radius_km: float) -> DataFrame:
    """Events within a radius of a place, first by a box around it so that files and cells can be pruned."""
    box = radius_km / 111.0
    near = events.filter(F.col("lat").between(lat - box, lat + box))
    return near.filter(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon), S.ZONE_EARTH_KM) <= radius_km)
