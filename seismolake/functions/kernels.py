"""Kernels of self-exciting models, their masses and inverse distributions, and small formulas of warning and fault size, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shortest delay that a temporal density is taken at, days.
LEAST_DELAY = 1e-6


def geometric_scales(low: float, high: float, n: int) -> Column:
    """n scales from low to high with equal ratios; one scale is their geometric mean."""
    if n < 1 or not 0 < low <= high:
        raise ValueError("scales need at least one element and 0 < low <= high")
    if n == 1:
        return F.array(F.lit(math.sqrt(low * high)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(low) * F.pow(F.lit(high / low), k / F.lit(float(n - 1))))


def omori_density(days: Column, c: float, p: float) -> Column:
    """Normalised: its integral over all delays is 1."""
    return F.lit((p - 1) / c) * F.pow(F.lit(1.0) + F.greatest(days, F.lit(LEAST_DELAY)) / F.lit(c), F.lit(-p))


def omori_mass(start: Column, end: Column, c: float, p: float) -> Column:
    low = F.greatest(start, F.lit(0.0))
    high = F.greatest(F.greatest(end, F.lit(0.0)), low)
    part = lambda x: F.pow(F.lit(1.0) + x / F.lit(c), F.lit(1 - p))
    return part(low) - part(high)


def sample_omori(u: Column, c: float, p: float, upper: Column | None = None) -> Column:
    """The delay below which the part u of the mass lies, of what falls before `upper` where it is given."""
    mass = F.lit(1.0) if upper is None else omori_mass(F.lit(0.0), upper, c, p)
    held = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(0.0), u * mass))
    return F.lit(c) * (F.pow(F.lit(1.0) - held, F.lit(-1 / (p - 1))) - F.lit(1.0))


def powerlaw_density(r: Column, d: float, s: float) -> Column:
    """Per unit area."""
    return F.lit((s - 1) / (math.pi * d * d)) * F.pow(F.lit(1.0) + r * r / F.lit(d * d), F.lit(-s))


def powerlaw_mass_within(r: Column, d: float, s: float) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) + r * r / F.lit(d * d), F.lit(1 - s))


def sample_powerlaw_radius(u: Column, d: float, s: float) -> Column:
    held = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(0.0), u))
    return F.lit(d) * F.sqrt(F.pow(F.lit(1.0) - held, F.lit(-1 / (s - 1))) - F.lit(1.0))


def gr_log_density(mag: Column, mc: float, beta: float) -> Column:
    return F.lit(math.log(beta)) - F.lit(beta) * (mag - F.lit(mc))


def influence_days(mag: Column, background: float) -> Column:
    """How long a trigger raises completeness above the background."""
    return F.pow(F.lit(10.0), (mag - F.lit(4.5) - F.lit(background)) / F.lit(0.75))


def hypocentral_km(epicentral_km: Column, depth_km: Column) -> Column:
    return F.hypot(epicentral_km, depth_km)


def warning_seconds(hypocentral: Column, s_wave_km_s: float, latency_s: float) -> Column:
    """Time from the alert to the shaking; below 0 where the shaking comes first."""
    return hypocentral / F.lit(s_wave_km_s) - F.lit(latency_s)


def shutdown_fires(im: Column, hypocentral: Column, threshold: float, s_wave_km_s: float, latency_s: float) -> Column:
    return (im >= threshold) & (warning_seconds(hypocentral, s_wave_km_s, latency_s) > 0)


def fault_length_km(mag: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(-2.44) + F.lit(0.59) * mag)


def horizon_years(days: Column) -> Column:
    return days / F.lit(365.0)
