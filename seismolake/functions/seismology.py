"""Column expressions: geometry, magnitudes, aftershock rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The association radius of the Earth and that of aftershock zones, km.
EARTH_KM = 6371.0
ZONE_EARTH_KM = 6371.0088


def cell_index(value: Column | str, origin: float, size: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor((value - F.lit(float(origin))) / F.lit(float(size)) + F.lit(1e-9)).cast("long")


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cell_area_km2(lat0: Column, size: float, radius: float = EARTH_KM) -> Column:
    return F.lit(radius**2 * math.radians(size)) * (F.sin(F.radians(lat0 + F.lit(float(size)))) - F.sin(F.radians(lat0)))


def zone_radius_km(mag: Column) -> Column:
    return F.least(F.lit(600.0), F.greatest(F.lit(20.0), F.lit(1.5) * F.pow(F.lit(10.0), F.lit(0.59) * mag - F.lit(2.44))))


def scordilis_mw(kind: Column, mag: Column) -> Column:
    """Moment magnitude from mb and Ms by Scordilis' relations (two decimals); null outside their ranges."""
    return F.round(
        F.when((kind == "mb") & mag.between(3.5, 6.2), F.lit(0.85) * mag + F.lit(1.03))
        .when((kind == "ms") & mag.between(3.0, 6.1), F.lit(0.67) * mag + F.lit(2.07))
        .when((kind == "ms") & mag.between(6.2, 8.2), F.lit(0.99) * mag + F.lit(0.08)),
        2,
    )


def omori_integral(c: float, p: float, start: Column, end: Column) -> Column:
    """Integral of (t + c) ** -p."""
    if p == 1:
        return F.log(end + F.lit(c)) - F.log(start + F.lit(c))
    return (F.pow(end + F.lit(c), F.lit(1.0 - p)) - F.pow(start + F.lit(c), F.lit(1.0 - p))) / F.lit(1.0 - p)


def reasenberg_jones_count(a: float, b: float, c: float, p: float, main: Column, least: Column, start: Column, end: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(a) + F.lit(b) * (main - least)) * omori_integral(c, p, start, end)


def gutenberg_richter_mass(low: Column, b: float, width: float) -> Column:
    return F.pow(F.lit(10.0), F.lit(-b) * low) - F.pow(F.lit(10.0), F.lit(-b) * (low + F.lit(width)))


def stai_completeness(mag: Column, days: Column) -> Column:
    """Completeness after a trigger: min(m, m - 4.5 - 0.75 log10(days))."""
    return F.least(mag, mag - F.lit(4.5) - F.lit(0.75) * F.log10(days))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by Abramowitz and Stegun's 26.2.17; error below 7.5e-8."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.lit(1 / math.sqrt(2 * math.pi)) * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def log_factorial(n: Column) -> Column:
    """ln n! by summation."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2).cast("long"), n.cast("long")), F.lit(0.0), lambda s, k: s + F.log(k.cast("double"))))
