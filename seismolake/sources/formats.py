"""Readers of catalogue, hazard and finite-source files, and the stores of forecasts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of magnitude types and of event kinds; what isn't named is "other".
MAGNITUDE_TYPES = ("mw", "mww", "mwc", "mwb", "mwr", "mb", "ms", "ml", "md", "mlv")
EVENT_KINDS = {"earthquake": "earthquake", "landslide": "landslide", "rockslide": "landslide", "explosion": "explosion", "quarry blast": "explosion", "mining explosion": "explosion"}


def magnitude_type(raw: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z]", "")
    return F.when(name.isin(*MAGNITUDE_TYPES), name).when(name.isin("mbvmo", "mblg"), "mb").when(name.startswith("msz"), "ms").otherwise("other")


def event_kind(raw: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in EVENT_KINDS.items() for x in kv))
    return F.coalesce(F.element_at(pairs, F.lower(F.trim(raw))), F.lit("other"))


def mw_from_moment(dyne_cm: Column) -> Column:
    return F.round((F.log10(dyne_cm) - F.lit(16.1)) * F.lit(2 / 3), 2)


def read_ndk(spark: SparkSession, path: str) -> DataFrame:
    """Moment tensor records of five lines with fixed columns: event_id, t_us (centroid), lat, lon, depth_km, moment (dyne cm), mw, and the reference origin."""
    files = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"), F.input_file_name().alias("file"))
    records = files.filter(F.length(F.trim("line")) > 0).groupBy("file", F.floor(F.col("n") / 5).alias("record")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l")).filter(F.size("l") == 5)
    cut = lambda k, a, n: F.trim(F.substring(F.get("l", k - 1)["line"], a, n))
    number = lambda k, a, n: cut(k, a, n).try_cast("double")
    words = F.split(cut(3, 10, 60), r"\s+")
    reference = F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", cut(1, 6, 10), cut(1, 17, 8)), F.lit("yyyy/MM/dd HH:mm:ss")))
    reference = reference + F.round(F.concat(F.lit("0."), F.regexp_extract(cut(1, 17, 10), r"\.(\d+)$", 1)).try_cast("double") * 1e6).cast("long")
    moment = number(5, 50, 7) * F.pow(F.lit(10.0), cut(4, 1, 2).try_cast("int"))
    return records.select(
        cut(2, 1, 16).alias("event_id"),
        (reference + F.round(F.get(words, 0).try_cast("double") * 1e6).cast("long")).alias("t_us"),
        F.get(words, 2).try_cast("double").alias("lat"),
        F.get(words, 4).try_cast("double").alias("lon"),
        F.get(words, 6).try_cast("double").alias("depth_km"),
        moment.alias("moment"),
        mw_from_moment(moment).alias("mw"),
        reference.alias("reference_t_us"),
        number(1, 28, 6).alias("reference_lat"),
        number(1, 35, 7).alias("reference_lon"),
    )


ISC_GEM = "date string, lat double, lon double, smajax double, sminax double, strike double, q_location string, depth double, unc_depth double, q_depth string, mw double, unc_mw double, q_mw string"


def read_isc_gem(spark: SparkSession, path: str) -> DataFrame:
    """Events of the comma-separated catalogue with a `#` header; the repeated column names are told apart by what they qualify. The last column is the id."""
    line = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("c"))
    names = [x.split() for x in ISC_GEM.split(", ")]
    rows = line.select(*(F.get("c", k).try_cast(t).alias(n) for k, (n, t) in enumerate(names)), F.element_at("c", -1).alias("event_id"))
    return rows.withColumn("t_us", F.unix_micros(F.try_to_timestamp("date"))).filter("t_us IS NOT NULL AND lat IS NOT NULL AND mw IS NOT NULL")


def read_hazard_curves(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, depth, level, poe of wide curve files."""
    from ..operators.risk import unpivot_curves

    wide = spark.read.option("comment", "#").option("header", True).option("inferSchema", False).csv(path)
    wide = wide.select(*(F.col(f"`{c}`").try_cast("double").alias(c) for c in wide.columns))
    return unpivot_curves(wide, ["lon", "lat", "depth"])


def read_ground_motions(spark: SparkSession, path: str) -> DataFrame:
    """event_id, site_id, im of exported fields."""
    rows = spark.read.option("comment", "#").option("header", True).csv(path)
    value = next(c for c in rows.columns if c.startswith("gmv_"))
    return rows.select(F.col("event_id").try_cast("long").alias("event_id"), F.col("custom_site_id").alias("site_id"), F.col(value).try_cast("double").alias("im"))


def read_subfaults(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, x, y, z and slip of finite-source files, whose header lines start with %."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.trim(F.col("value")).startswith("%") & (F.size(part) >= 6))
    return rows.select(*(F.get(part, k).try_cast("double").alias(n) for k, n in enumerate(("lat", "lon", "x", "y", "z", "slip")))).filter("slip IS NOT NULL")


def read_fault_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of GeoJSON line strings: fault, k, and the ends x1, y1, x2, y2."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("fault", "f")).filter("f.geometry.type = 'LineString'")
    xy = F.col("f.geometry.coordinates")
    return features.select("fault", F.explode(F.sequence(F.lit(0), F.size(xy) - 2)).alias("k"), xy.alias("xy")).select(
        "fault", "k", *(F.get(F.get("xy", F.col("k") + a), b).alias(n) for n, a, b in (("x1", 0, 0), ("y1", 0, 1), ("x2", 1, 0), ("y2", 1, 1)))
    )


def fault_density(segments: DataFrame, west: float, south: float, size: float) -> DataFrame:
    """Kilometres of trace by cell: segments are cut into pieces of at most a fifth of a cell, credited to the cell of their middle."""
    from ..functions.seismology import cell_index, haversine_km

    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / F.lit(size / 5))).cast("int")
    rows = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b, s: F.col(a) + (F.col(b) - F.col(a)) * s / F.col("n")
    km = haversine_km(at("y1", "y2", F.col("i")), at("x1", "x2", F.col("i")), at("y1", "y2", F.col("i") + 1), at("x1", "x2", F.col("i") + 1))
    middle = F.col("i") + F.lit(0.5)
    return rows.groupBy(cell_index(at("x1", "x2", middle), west, size).alias("ix"), cell_index(at("y1", "y2", middle), south, size).alias("iy")).agg(F.sum(km).alias("km"))


def verify_files(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """manifest (name, sha256) rows whose file is missing or has other bytes."""
    found = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("found_name"), F.sha2("content", 256).alias("found_sha256"))
    joined = manifest.join(found, F.col("name") == F.col("found_name"), "left")
    return joined.filter(~F.col("sha256").eqNullSafe(F.col("found_sha256"))).select("name", F.when(F.col("found_name").isNull(), "missing").otherwise("changed").alias("problem"))


def save_grid(grid: DataFrame, folder: str, region: str, model: str, forecast: str) -> None:
    """grid (cell_ix, bin_ix, rate) under its region, model and forecast, which readers prune by."""
    held = grid.select(F.lit(region).alias("region_id"), F.lit(model).alias("model_id"), F.lit(forecast).alias("forecast_id"), "cell_ix", "bin_ix", "rate")
    held.write.mode("append").partitionBy("region_id", "model_id", "forecast_id").parquet(folder)


def load_grid(spark: SparkSession, folder: str, forecast: str) -> DataFrame:
    rows = spark.read.parquet(folder).filter(F.col("forecast_id") == forecast)
    if rows.select("region_id", "model_id").distinct().count() != 1:
        raise LookupError(f"{forecast} is not one stored forecast")
    return rows


def log_run(spark: SparkSession, folder: str, kind: str, region: str, fields: dict[str, str]) -> None:
    """Appends one record to a log of runs."""
    row = spark.createDataFrame([(kind, region, fields)], "kind string, region_id string, fields map<string,string>")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(folder)
