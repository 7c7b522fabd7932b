"""Azimuthal equidistant projection about a centre, and ground-failure and horizon expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seismology import EARTH_KM


def forward(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Kilometres east and north of the centre."""
    phi, phi0, dl = F.radians(lat), F.radians(F.lit(lat0)), F.radians(lon - F.lit(lon0))
    cos_c = F.sin(phi0) * F.sin(phi) + F.cos(phi0) * F.cos(phi) * F.cos(dl)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_c)))
    k = F.when(c < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c))
    return F.lit(EARTH_KM) * k * F.cos(phi) * F.sin(dl), F.lit(EARTH_KM) * k * (F.cos(phi0) * F.sin(phi) - F.sin(phi0) * F.cos(phi) * F.cos(dl))


def inverse(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    rho, phi0 = F.sqrt(x * x + y * y), F.radians(F.lit(lat0))
    c = rho / F.lit(EARTH_KM)
    lat = F.when(rho < 1e-9, F.lit(lat0)).otherwise(F.degrees(F.asin(F.cos(c) * F.sin(phi0) + y * F.sin(c) * F.cos(phi0) / rho)))
    lon = F.lit(lon0) + F.when(rho < 1e-9, F.lit(0.0)).otherwise(F.degrees(F.atan2(x * F.sin(c), rho * F.cos(phi0) * F.cos(c) - y * F.sin(phi0) * F.sin(c))))
    return lon, lat


def horizon_seconds(text: Column) -> Column:
    """`30d`, `12h`, `1w`, `1y` (365 days) in seconds; null for anything else."""
    unit = F.regexp_extract(text, r"^(\d+)([hdwy])$", 2)
    size = F.when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 7 * 86400).when(unit == "y", 365 * 86400)
    return F.regexp_extract(text, r"^(\d+)([hdwy])$", 1).try_cast("long") * size


def occupancy(intercept: float, slope: float, log_distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(intercept) + F.lit(slope) * log_distance)))


def moment_magnitude(area_km2: Column, slip_m: Column, rigidity_pa: float = 3e10) -> Column:
    return (F.log10(F.lit(rigidity_pa) * area_km2 * F.lit(1e6) * slip_m) - F.lit(9.1)) * F.lit(2 / 3)
