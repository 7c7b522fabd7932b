"""Names, hashes, times and outlines as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Moment magnitude types.
MOMENT = ("mww", "mwc", "mwb", "mwr", "mw")


def format_horizon(seconds: Column) -> Column:
    """Days where they are whole, else hours, else seconds: 30d, 12h, 90s."""
    part = lambda n, unit: F.concat((seconds / n).cast("long").cast("string"), F.lit(unit))
    return F.when(seconds % 86400 == 0, part(86400, "d")).when(seconds % 3600 == 0, part(3600, "h")).otherwise(part(1, "s"))


def parse_utc(text: Column) -> Column:
    """Microseconds of an ISO 8601 time; without a zone it is UTC, whatever the session's zone is. Null where it is none."""
    zoned = F.when(text.rlike(r"(?i)(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\s*$") & text.rlike(r"\d[T ]\d"), text).when(text.rlike(r"\d[T ]\d"), F.concat(F.trim(text), F.lit("Z"))).otherwise(F.concat(F.trim(text), F.lit("T00:00:00Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def utc_text(us: Column) -> Column:
    """yyyyMMddTHHmmssZ of microseconds since 1970, whatever the session's zone is."""
    seconds = F.floor(us / F.lit(1_000_000)).cast("long")
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    within = F.pmod(seconds, F.lit(86400))
    return F.concat(F.regexp_replace(day.cast("string"), "-", ""), F.lit("T"), two(F.floor(within / 3600)), two(F.floor(within / 60) % 60), two(within % 60), F.lit("Z"))


def grid_id(model: Column, region: Column, issue_us: Column, horizon_s: Column) -> Column:
    return F.concat_ws("_", model, region, utc_text(issue_us), format_horizon(horizon_s))


def float_repr(x: Column) -> Column:
    """The shortest decimal of a double as Python writes it: positional from 1e-4 to below 1e16, else with an exponent of two digits at least. The digits are those of the JVM, which before version 19 may have one too many far from 1."""
    text = F.abs(x).cast("string")
    power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    mantissa = F.regexp_extract(text, r"^(\d)(?:\.(\d+))?E", 1)
    behind = F.regexp_replace(F.regexp_extract(text, r"^(\d)(?:\.(\d+))?E", 2), "0+$", "")
    digits = F.concat(mantissa, behind)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(F.rpad(F.substring(digits, 1, power + 1), power + 1, "0"), F.lit("."), F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.length(digits))).otherwise(F.lit("0")))
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(mantissa, F.when(behind == "", F.lit("")).otherwise(F.concat(F.lit("."), behind)), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    plain = F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.lit("inf")).when(~text.contains("E"), text)
    body = plain.when((power < 0) & (power >= -4), small).when((power >= 0) & (power < 16), large).otherwise(scientific)
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.concat(F.when(negative & ~F.isnan(x), F.lit("-")).otherwise(F.lit("")), body)


def snapshot_hash(columns: dict[str, Column]) -> Column:
    """Hash of a model's parameters: lines of name=value in order of names, texts in quotes and doubles as in `float_repr`; null is None."""

    def written(c: Column) -> Column:
        kind, text = F.typeof(c), c.cast("string")
        value = F.when(kind.isin("double", "float"), float_repr(c.try_cast("double"))).when(kind == "string", F.concat(F.lit("'"), text, F.lit("'"))).when(kind == "boolean", F.initcap(text)).otherwise(text)
        return F.coalesce(value, F.lit("None"))

    return F.sha2(F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), written(columns[k])) for k in sorted(columns))), 256)


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; null values are left out."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def parse_imt(text: Column) -> Column:
    """kind and period of PGA, PGV or SA(period); null for anything else."""
    token = F.upper(F.trim(text))
    period = F.regexp_extract(token, r"^SA\(([0-9]*\.?[0-9]+)\)$", 1).try_cast("double")
    plain = F.struct(token.alias("kind"), F.lit(None).cast("double").alias("period"))
    return F.when(token.isin("PGA", "PGV"), plain).when(period > 0, F.struct(F.lit("SA").alias("kind"), period.alias("period")))


def parse_imt_column(text: Column) -> Column:
    """The same for a table's column heads, where a bare number is a period."""
    token = F.upper(F.trim(text))
    period = token.try_cast("double")
    plain = F.struct(token.alias("kind"), F.lit(None).cast("double").alias("period"))
    return F.when(token.isin("PGA", "PGV"), plain).when(period > 0, F.struct(F.lit("SA").alias("kind"), period.alias("period")))


def months_touched(start_us: Column, end_us: Column) -> Column:
    """First days of the months that [start, end) touches."""
    day = lambda us: F.trunc(F.timestamp_micros(us).cast("date"), "month")
    return F.when(end_us > start_us, F.sequence(day(start_us), day(end_us - 1), F.expr("INTERVAL 1 MONTH"))).otherwise(F.array().cast("array<date>"))


def identity_mw(kind: Column, mag: Column) -> Column:
    """mw and its route for moment magnitudes; nulls for others."""
    moment = F.lower(kind).isin(*MOMENT)
    return F.struct(F.when(moment, mag).alias("mw"), F.when(moment, F.concat(F.lit("identity:"), F.lower(kind))).alias("route"))


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def bbox(ring: Column) -> Column:
    """west, south, east, north of an array of (lon, lat)."""
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def region_wkt(ring: Column) -> Column:
    """POLYGON of an array of (lon, lat), closed."""
    point = lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))
    closed = F.when(F.element_at(ring, -1) == F.get(ring, 0), ring).otherwise(F.concat(ring, F.array(F.get(ring, 0))))
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(closed, point), ", "), F.lit("))"))


def wkt_ring(wkt: Column) -> Column:
    """The outer ring of a POLYGON as an array of (lon, lat)."""
    inner = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\(([^()]*)\)", 1)
    return F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.try_cast("double")))


def region_geojson(region_id: Column, ring: Column) -> Column:
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(region_id.alias("id")).alias("properties"), shape.alias("geometry")))


def digest_floats(digest: Column, parts: int) -> Column:
    """Whole numbers below 2 ** 48 of a hex digest's first parts of twelve digits, which doubles hold exactly."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.conv(F.substring(digest, k * 12 + 1, F.lit(12)), 16, 10).cast("double"))


def data_holdings(lines: DataFrame) -> DataFrame:
    """Stations and the day of their last solution, from a listing (value) of white-space separated columns with a station of four characters first and ISO days after."""
    part = F.split(F.trim("value"), r"\s+")
    days = F.filter(part, lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rows = lines.filter(F.get(part, 0).rlike("^[A-Za-z0-9]{4}$") & (F.size(days) >= 2))
    return rows.select(F.get(part, 0).alias("site"), F.get(days, 0).alias("first_day"), F.get(days, 1).alias("last_day"))
