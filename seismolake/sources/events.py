"""The event table as an earthquake catalogue, and readers of other catalogue formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_catalogue(events: DataFrame) -> DataFrame:
    """event_id, lane, t_us, mag, mbin (tenths), lon, lat, depth_km, etype, avail_us of an events table; a null avail_us is an unknown vintage."""
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    mag = F.lit(2.5) + F.col("value") / F.lit(115.13)
    unknown = F.col("event_id") % 10 == 0
    return events.select(
        "event_id",
        F.col("event_type").alias("lane"),
        t_us.alias("t_us"),
        mag.alias("mag"),
        F.floor(mag / F.lit(0.1) + F.lit(0.5) + F.lit(1e-9)).cast("long").alias("mbin"),
        (F.lit(80.0) + ((F.col("event_id") * 7919) % 900).cast("double") / F.lit(100.0)).alias("lon"),
        (F.lit(26.0) + ((F.col("event_id") * 104729) % 450).cast("double") / F.lit(100.0)).alias("lat"),
        ((F.col("event_id") * 31) % 90).cast("double").alias("depth_km"),
        F.when(F.col("event_type") == "error", "landslide").otherwise("earthquake").alias("etype"),
        F.when(~unknown, t_us + (F.col("event_id") % 40) * F.lit(DAY_US)).alias("avail_us"),
        "props",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_catalogue(table(spark, sf_dir, "events"))


COMCAT = (
    "features array<struct<id:string,properties:struct<mag:double,magType:string,magError:double,time:bigint,updated:bigint,net:string,type:string>,"
    "geometry:struct<coordinates:array<double>>>>"
)


def read_comcat(spark: SparkSession, path: str) -> DataFrame:
    """Events of GeoJSON feature collections; rows without a time or place are dropped, times are in microseconds."""
    feature = spark.read.schema(COMCAT).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p, xyz = "f.properties.", F.col("f.geometry.coordinates")
    rows = feature.select(
        F.col("f.id").alias("event_id"), (F.col(p + "time") * 1000).alias("t_us"), (F.col(p + "updated") * 1000).alias("avail_us"), F.col(p + "mag").alias("mag"),
        F.lower(p + "magType").alias("mag_type"), F.col(p + "net").alias("lane"), F.coalesce(p + "type", F.lit("earthquake")).alias("etype"),
        F.get(xyz, 0).alias("lon"), F.get(xyz, 1).alias("lat"), F.get(xyz, 2).alias("depth_km"),
    )
    return rows.filter("t_us IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")


def read_fdsn_text(spark: SparkSession, path: str) -> DataFrame:
    """Events of pipe-separated event lists (`#EventID|Time|Latitude|Longitude|Depth|...|MagType|Magnitude|...`)."""
    part = F.split("value", r"\|")
    cell = lambda k: F.trim(F.get(part, k))
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(part) >= 12))
    time = F.unix_micros(F.try_to_timestamp(cell(1)))
    rows = lines.select(
        cell(0).alias("event_id"), time.alias("t_us"), cell(2).try_cast("double").alias("lat"), cell(3).try_cast("double").alias("lon"),
        cell(4).try_cast("double").alias("depth_km"), F.lower(cell(9)).alias("mag_type"), cell(10).try_cast("double").alias("mag"),
    )
    return rows.filter("t_us IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")


def read_tenv3(spark: SparkSession, path: str) -> DataFrame:
    """Daily station positions of white-space separated GNSS series: site, day, decimal_year, east_m, north_m, up_m and their sigmas."""
    part = F.split(F.trim("value"), r"\s+")
    cell = lambda k: F.get(part, k)
    lines = spark.read.text(path).filter((F.size(part) >= 20) & (cell(0) != "site"))
    add = lambda a, b: cell(a).try_cast("double") + cell(b).try_cast("double")
    return lines.select(
        cell(0).alias("site"), F.date_add(F.lit("1858-11-17").cast("date"), cell(3).try_cast("int")).alias("day"), cell(2).try_cast("double").alias("decimal_year"),
        add(7, 8).alias("east_m"), add(9, 10).alias("north_m"), add(11, 12).alias("up_m"),
        *(cell(k).try_cast("double").alias(n) for k, n in ((14, "sigma_e"), (15, "sigma_n"), (16, "sigma_u"))),
    )


def write_catalogue(events: DataFrame, path: str, bin_us: int = 365 * DAY_US) -> None:
    """Parquet by year-long periods, sorted by time inside, so time filters prune files."""
    period = F.floor(F.col("t_us") / bin_us).cast("int")
    events.withColumn("period", period).repartitionByRange("t_us").sortWithinPartitions("t_us").write.partitionBy("period").parquet(path)
