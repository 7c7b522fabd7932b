"""Readers of shaking grids, coverage slices, exposure tables, verification and coefficient tables, and of assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import parse_imt_column


def read_shaking_grid(spark: SparkSession, path: str) -> DataFrame:
    """path, event, magnitude, lon, lat and values (a map by field name in lower case) of ShakeMap grids in XML. Rows whose number of fields isn't the header's are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    names = F.transform(F.regexp_extract_all("value", F.lit(r'<grid_field[^>]*\bname="([^"]+)"'), 1), lambda x: F.lower(x))
    head = files.select(
        "path", F.regexp_extract("value", r'\bevent_id="([^"]*)"', 1).alias("event"), F.regexp_extract("value", r'<event [^>]*\bmagnitude="([^"]*)"', 1).try_cast("double").alias("magnitude"),
        names.alias("names"), F.regexp_extract("value", r"(?s)<grid_data>(.*?)</grid_data>", 1).alias("block"),
    )
    rows = head.select("path", "event", "magnitude", "names", F.explode(F.split(F.trim("block"), r"\s*\n\s*")).alias("line"))
    cells = rows.withColumn("cells", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))).filter(F.size("cells") == F.size("names"))
    values = cells.withColumn("values", F.map_from_arrays("names", "cells"))
    return values.select("path", "event", "magnitude", F.col("values")["lon"].alias("lon"), F.col("values")["lat"].alias("lat"), "values")


def read_slice(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """lon, lat and columns of a grid slice in CSV with a header; whatever isn't a number is null."""
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in ("lon", "lat", *columns) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*(F.col(c).try_cast("double").alias(c) for c in ("lon", "lat", *columns)))


def incomplete(grid: DataFrame) -> DataFrame:
    """One row if the places of a grid aren't all pairs of its longitudes and latitudes, each once; else none."""
    s = grid.agg(F.count("*").alias("n"), F.countDistinct("lon").alias("n_lon"), F.countDistinct("lat").alias("n_lat"), F.countDistinct("lon", "lat").alias("places"))
    return s.filter("n <> n_lon * n_lat OR places <> n")


def resolved(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by the first of their names that a table has, in any case; refused if it has none."""
    have = {c.lower(): c for c in rows.columns}
    out = []
    for name, others in aliases.items():
        found = next((have[x.lower()] for x in (name, *others) if x.lower() in have), None)
        if found is None:
            raise ValueError(f"no column for {name}")
        out.append(F.col(f"`{found}`").alias(name))
    return rows.select(*out)


def portfolio(rows: DataFrame, by: list[str]) -> DataFrame:
    """Assets, value and people by key of an exposure table (value, people)."""
    return rows.groupBy(*by).agg(F.count("*").alias("assets"), F.sum(F.col("value").cast("double")).alias("value"), F.sum(F.col("people").cast("double")).alias("people"))


def capacity_mw(properties: str = "properties") -> Column:
    """The best capacity, else the middle of the interval; null without either."""
    p = F.col(properties)["capacity_mw"]
    return F.coalesce(p["best"], (p["low"] + p["high"]) / 2)


ASSETS = (
    "features array<struct<properties:struct<id:string,kind:string,capacity_mw:struct<best:double,low:double,high:double>>,geometry:struct<type:string,coordinates:array<double>>>>"
)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """asset_id, kind, lon, lat and capacity_mw of GeoJSON points; assets without a capacity stay, with null."""
    rows = spark.read.schema(ASSETS).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    at = F.col("geometry.coordinates")
    return rows.select(F.col("properties.id").alias("asset_id"), F.col("properties.kind").alias("kind"), F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat"), capacity_mw().alias("capacity_mw"))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """imt, coefficient and value of white-space separated tables whose first line, from `IMT` on, names the columns."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s*\n\s*"), lambda x: F.trim(x) != "")).alias("at", "line"))
    head = lines.filter("at = 0").select(F.split(F.trim("line"), r"\s+").alias("names"))
    rows = lines.filter("at > 0").select(F.split(F.trim("line"), r"\s+").alias("cells")).join(F.broadcast(head))
    pairs = F.arrays_zip(F.slice("names", 2, F.size("names")).alias("coefficient"), F.slice("cells", 2, F.size("cells")).alias("value"))
    out = rows.select(F.get("cells", 0).alias("imt"), F.explode(pairs).alias("p"))
    return out.select("imt", F.col("p.coefficient").alias("coefficient"), F.col("p.value").try_cast("double").alias("value"))


#: The names of a finite-fault file's header that place its plane.
FAULT_HEADER = {"h_lat": "LAT", "h_lon": "LON", "h_depth_km": "DEP", "mag": "Mw", "strike": "STRK", "dip": "DIP", "rake": "RAKE", "dx_km": "Dx", "dz_km": "Dz"}


def read_faults(spark: SparkSession, path: str) -> DataFrame:
    """model_id (the file's name), lat, lon, depth_km and slip of each sub-fault of finite-fault files, with the header's hypocentre, magnitude, strike, dip, rake, dx_km and dz_km.

    Comments begin with %; rows are lat, lon, x, y, z, slip and further columns. A file that lacks one of the header's values is refused when it is read; rows that aren't numbers are left out.
    """
    number = r"(-?\d+\.?\d*)"
    texts = spark.read.text(path, wholetext=True).withColumn("model_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    found = {k: F.regexp_extract("value", rf"\b{v}\s*=\s*{number}", 1).try_cast("double") for k, v in FAULT_HEADER.items()}
    checked = {k: F.coalesce(v, F.raise_error(F.lit(f"a finite-fault file has no {FAULT_HEADER[k]}")).cast("double")) for k, v in found.items()}
    rows = texts.withColumns(checked).withColumn("line", F.explode(F.split("value", r"\r?\n"))).drop("value")
    cells = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.get(F.col("cells"), k).try_cast("double")
    rows = rows.filter(~F.trim("line").startswith("%")).withColumn("cells", cells).filter(F.size("cells") >= 6)
    out = rows.select("model_id", at(0).alias("lat"), at(1).alias("lon"), at(4).alias("depth_km"), at(5).alias("slip"), *FAULT_HEADER)
    return out.filter("lat IS NOT NULL AND lon IS NOT NULL AND depth_km IS NOT NULL AND slip IS NOT NULL")


def read_verification(spark: SparkSession, path: str) -> DataFrame:
    """case, result_type, kind, period, expected and inputs (a map of the columns rup_, dist_ and site_) of expected ground motions in CSV, one row a measure."""
    rows = spark.read.option("header", True).csv(path)
    inputs = [c for c in rows.columns if c.lower().startswith(("rup_", "dist_", "site_"))]
    others = [c for c in rows.columns if c not in inputs and c.lower() not in ("result_type", "damping", "case")]
    held = F.create_map(*(x for c in inputs for x in (F.lit(c.lower()), F.col(f"`{c}`").try_cast("double"))))
    case = F.xxhash64(*(F.col(f"`{c}`") for c in inputs))
    long = rows.select(case.alias("case"), "result_type", held.alias("inputs"), F.explode(F.array(*(F.struct(F.lit(c).alias("head"), F.col(f"`{c}`").try_cast("double").alias("expected")) for c in others))).alias("m"))
    long = long.withColumn("i", parse_imt_column(F.col("m.head"))).filter("i IS NOT NULL")
    return long.select("case", "result_type", "i.kind", "i.period", F.col("m.expected").alias("expected"), "inputs")


def off_table(computed: DataFrame, expected: DataFrame, percent: float = 0.1) -> DataFrame:
    """Cases (case, kind, period, value) further than a percentage from what a verification table expects."""
    same = (F.col("case") == F.col("c")) & (F.col("kind") == F.col("k")) & F.col("period").eqNullSafe(F.col("p"))
    held = expected.select(F.col("case").alias("c"), F.col("kind").alias("k"), F.col("period").alias("p"), "expected")
    return computed.join(held, same).withColumn("off", F.abs(F.col("value") / F.col("expected") - 1) * 100).filter(F.col("off") > percent).select("case", "kind", "period", "value", "expected", "off")


def read_assessments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Source type assessments (event_id, source_type, assessed_us) of JSON lines, and the lines that can't be read."""
    schema = "event_id string, source_type string, assessed_us long, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.col("_metadata.file_path"))
    unread = F.col("_bad").isNotNull() | F.col("event_id").isNull() | F.col("source_type").isNull()
    return rows.filter(~unread).drop("_bad", "file"), rows.filter(unread).select("file", F.col("_bad").alias("line"))


def with_assessments(events: DataFrame, assessments: DataFrame, as_of_us: int) -> DataFrame:
    """events (event_id, etype) with the type of the latest assessment known at the instant, where there is one."""
    known = assessments.filter(F.col("assessed_us") < as_of_us)
    last = known.groupBy(F.col("event_id").alias("of")).agg(F.max(F.struct("assessed_us", "source_type"))["source_type"].alias("assessed"))
    return events.join(last, F.col("event_id").cast("string") == F.col("of"), "left").withColumn("etype", F.coalesce("assessed", "etype")).drop("of", "assessed")


def clipped_lines(lines: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """lines (line_id, points: array of (lon, lat)) as the parts of their segments inside a box, by Liang and Barsky's bounds: line_id, k, x0, y0, x1, y1."""
    west, south, east, north = box
    segments = lines.select("line_id", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("k", "s"))
    s = segments.select("line_id", "k", F.col("s.a")[0].alias("ax"), F.col("s.a")[1].alias("ay"), (F.col("s.b")[0] - F.col("s.a")[0]).alias("dx"), (F.col("s.b")[1] - F.col("s.a")[1]).alias("dy"))
    low, high, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-F.col("dx"), F.col("ax") - west), (F.col("dx"), F.lit(east) - F.col("ax")), (-F.col("dy"), F.col("ay") - south), (F.col("dy"), F.lit(north) - F.col("ay"))):
        low = F.when(p < 0, F.greatest(low, q / p)).otherwise(low)
        high = F.when(p > 0, F.least(high, q / p)).otherwise(high)
        outside = outside | ((p == 0) & (q < 0))
    s = s.withColumns({"t0": low, "t1": high, "out": outside}).filter("NOT out AND t0 <= t1")
    return s.select("line_id", "k", *((F.col(a) + F.col(t) * F.col(d)).alias(n) for n, a, t, d in (("x0", "ax", "t0", "dx"), ("y0", "ay", "t0", "dy"), ("x1", "ax", "t1", "dx"), ("y1", "ay", "t1", "dy"))))


def fault_density(segments: DataFrame, size: float, lon0: float, lat0: float) -> DataFrame:
    """Kilometres of fault by cell (ix, iy): segments are cut into pieces of at most a fifth of a cell, each counted where its middle lies."""
    from ..functions import seismology as S

    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) / F.lit(size / 5))).cast("int")
    pieces = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("n")
    km = S.haversine_km(at("y0", "y1", F.col("i")), at("x0", "x1", F.col("i")), at("y0", "y1", F.col("i") + 1), at("x0", "x1", F.col("i") + 1))
    middle = F.col("i") + F.lit(0.5)
    return pieces.groupBy(S.cell_index(at("x0", "x1", middle), lon0, size).alias("ix"), S.cell_index(at("y0", "y1", middle), lat0, size).alias("iy")).agg(F.sum(km).alias("km"))
