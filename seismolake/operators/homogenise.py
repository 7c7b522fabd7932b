"""Homogenised moment magnitudes and merged events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seismology as S

#: Precedence of sources and of moment magnitude types.
SOURCES = ("gcmt", "isc-gem", "isc", "usgs-comcat")
MOMENT_TYPES = ("mww", "mwc", "mwb", "mwr", "mw")
#: Sources that carry the records of several networks.
CARRIERS = ("usgs-comcat",)


def preferred_mw(magnitudes: DataFrame, assume_local: bool) -> DataFrame:
    """magnitudes (event_id, source, kind, mag, preferred): event_id, mw, how it came about and from which kind.

    Moment magnitudes come first, by source and then type; then Scordilis' conversions, by source and then Ms before mb; then, where the policy
    says so, the preferred solution's own magnitude as it is, if it is a local one; else none.
    """
    place = lambda values, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)), F.lit(99))
    source, kind = place(SOURCES, "source"), place(MOMENT_TYPES, "kind")
    converted = S.scordilis_mw(F.col("kind"), F.col("mag"))
    local = F.col("kind").isin("ml", "md", "mlv") & F.col("preferred") & F.lit(assume_local)
    ranked = magnitudes.select(
        "event_id",
        F.when(kind < 99, F.struct(F.lit(1).alias("step"), source.alias("a"), kind.alias("b"), F.col("mag").alias("mw"), F.col("kind").alias("from")))
        .when(converted.isNotNull(), F.struct(F.lit(2).alias("step"), source.alias("a"), F.when(F.col("kind") == "ms", 1).otherwise(2).cast("long").alias("b"), converted.alias("mw"), F.col("kind").alias("from")))
        .when(local, F.struct(F.lit(3).alias("step"), source.alias("a"), F.lit(1).cast("long").alias("b"), F.col("mag").alias("mw"), F.col("kind").alias("from")))
        .alias("r"),
    )
    best = ranked.groupBy("event_id").agg(F.min("r").alias("r"))
    how = F.when(F.col("r.step") == 1, "moment").when(F.col("r.step") == 2, "converted").when(F.col("r.step") == 3, "assumed").otherwise("none")
    return best.select("event_id", F.col("r.mw").alias("mw"), how.alias("how"), F.col("r.from").alias("kind"))


def merge_clusters(members: DataFrame, order: list[str], prefix: str = "merged-") -> DataFrame:
    """members (cluster, event_id, lane, t_us, avail_us, lat, lon, depth_km, mag, etype): one event per cluster, which holds a few records.

    Members stand in the given order, then by lane and id. Place, time, depth and magnitude are the first one's, whose lane and id name the event (after a prefix); the first type but earthquake wins; other magnitudes are
    those that differ from the first one's, each once; contributing ids and lanes stand in members' order; the vintage is the latest, unknown if any is unknown.
    """
    fields = ("lane", "event_id", "t_us", "lat", "lon", "depth_km", "mag", "etype", "avail_us")
    merged = members.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), *fields))).alias("m"))
    first, all_of = F.get("m", 0), lambda c: F.transform("m", lambda x: x[c])
    odd = F.filter(all_of("etype"), lambda x: x != "earthquake")
    others = F.array_distinct(F.filter(all_of("mag"), lambda x: x.isNotNull() & ~x.eqNullSafe(first["mag"])))
    name = F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(":", first["lane"], first["event_id"]).cast("binary")), 1, 12))
    vintage = F.when(~F.exists(all_of("avail_us"), lambda x: x.isNull()), F.array_max(all_of("avail_us")))
    return merged.select(
        name.alias("id"), *(first[c].alias(c) for c in ("t_us", "lat", "lon", "depth_km", "mag")), F.coalesce(F.get(odd, 0), F.lit("earthquake")).alias("etype"), vintage.alias("avail_us"),
        all_of("event_id").alias("ids"), F.array_distinct(all_of("lane")).alias("lanes"), others.alias("other_mags"),
    )


def source_lane(source: Column, event_id: Column) -> Column:
    """The lane that a record stands in for association: its source, but for a source that carries networks' own records, the network that begins the record's id, too."""
    network = F.regexp_extract(event_id, "^[a-z]+", 0)
    return F.when(source.isin(*CARRIERS), F.concat(source, F.lit("/"), F.when(network == "", F.lit("unknown")).otherwise(network))).otherwise(source)


def contributing_lanes(ids: Column) -> Column:
    """Lanes of the records source:id that are merged into an event, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(ids, lambda x: source_lane(F.substring_index(x, ":", 1), F.regexp_replace(x, "^[^:]*:?", "")))))
