"""Ground motion of shallow crustal earthquakes by the published equations of Boore, Stewart, Seyhan and Atkinson (2014), as column expressions over a row's coefficients."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The model's coefficients for peak ground acceleration (g), without a regional or basin term.
PGA_2014 = {
    "e0": 0.4473, "e1": 0.4856, "e2": 0.2459, "e3": 0.4539, "e4": 1.431, "e5": 0.05053, "e6": -0.1662, "Mh": 5.5, "c1": -1.134, "c2": 0.1917, "c3": -0.008088, "h": 4.5, "Dc3": 0.0,
    "c": -0.6, "Vc": 1500.0, "f4": -0.15, "f5": -0.00701, "R1": 110.0, "R2": 270.0, "DfR": 0.1, "DfV": 0.07, "f1": 0.695, "f2": 0.495, "tau1": 0.398, "tau2": 0.348,
}
#: What regions add to the loss with distance, for peak ground acceleration: little loss (China, Turkey), much (Italy, Japan).
LITTLE_LOSS, MUCH_LOSS = 0.0028576, -0.00255
#: Reference magnitude, distance (km), shear wave velocity (m/s) and acceleration (g), and the velocities between which soft sites damp the spread.
M_REF, R_REF, V_REF, A_REF, V_SOFT, V_FIRM = 4.5, 1.0, 760.0, 0.1, 225.0, 300.0

Coefficients = Mapping[str, Column | float] | Callable[[str], Column]


def of(c: Coefficients, name: str) -> Column:
    held = c(name) if callable(c) else c[name]
    return held if isinstance(held, Column) else F.lit(float(held))


def on_rock(c: Coefficients, mag: Column, rake: Column, rjb: Column) -> Column:
    """Logarithm of the motion at the reference velocity: size, mechanism (by rake, degrees; null is unknown) and path."""
    flat = F.abs(rake)
    mechanism = F.when(rake.isNull(), of(c, "e0")).when((flat <= 30) | (flat >= 150), of(c, "e1")).when(rake > 0, of(c, "e3")).otherwise(of(c, "e2"))
    over = mag - of(c, "Mh")
    size = F.when(over <= 0, of(c, "e4") * over + of(c, "e5") * over * over).otherwise(of(c, "e6") * over)
    r = F.sqrt(rjb * rjb + of(c, "h") * of(c, "h"))
    path = (of(c, "c1") + of(c, "c2") * (mag - F.lit(M_REF))) * F.log(r / F.lit(R_REF)) + (of(c, "c3") + of(c, "Dc3")) * (r - F.lit(R_REF))
    return mechanism + size + path


def site_term(c: Coefficients, vs30: Column, rock_pga: Column) -> Column:
    """What the site adds, linear and by the shaking on rock (g)."""
    linear = of(c, "c") * F.log(F.least(vs30, of(c, "Vc")) / F.lit(V_REF))
    softness = of(c, "f4") * (F.exp(of(c, "f5") * (F.least(vs30, F.lit(V_REF)) - F.lit(360.0))) - F.exp(of(c, "f5") * F.lit(V_REF - 360.0)))
    return linear + softness * F.log((rock_pga + F.lit(A_REF)) / F.lit(A_REF))


def between_magnitudes(low: Column, high: Column, mag: Column) -> Column:
    """low up to 4.5, high from 5.5 on, linear between."""
    return low + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), mag - F.lit(4.5)))


def spread(c: Coefficients, mag: Column, rjb: Column, vs30: Column) -> tuple[Column, Column]:
    """Deviations between events, and within an event: larger far away, smaller on soft ground."""
    within = between_magnitudes(of(c, "f1"), of(c, "f2"), mag)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(F.greatest(rjb, F.lit(1e-9)) / of(c, "R1")) / F.log(of(c, "R2") / of(c, "R1"))))
    soft = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(F.lit(V_FIRM) / vs30) / F.log(F.lit(V_FIRM / V_SOFT))))
    return between_magnitudes(of(c, "tau1"), of(c, "tau2"), mag), within + of(c, "DfR") * part - of(c, "DfV") * soft


def boore_2014(c: Coefficients, pga: Coefficients, mag: Column, rake: Column, rjb: Column, vs30: Column) -> tuple[Column, Column, Column]:
    """Mean logarithm, and the deviations between and within events. c: the measure's coefficients; pga: those of peak ground acceleration, whose motion on rock the site term needs."""
    mean = on_rock(c, mag, rake, rjb) + site_term(c, vs30, F.exp(on_rock(pga, mag, rake, rjb)))
    return mean, *spread(c, mag, rjb, vs30)


def coefficients_at(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """period and c, a map of coefficients, of wanted periods: linear in the period's logarithm between the rows of a table (period, coefficient, value) around; outside of it there are none."""
    w = Window.partitionBy("coefficient").orderBy("period")
    spans = table.select("coefficient", F.col("period").alias("p0"), F.col("value").alias("v0"), F.lead("period").over(w).alias("p1"), F.lead("value").over(w).alias("v1")).filter("p1 IS NOT NULL")
    # a table of coefficients has a few thousand rows
    met = wanted.select("period").distinct().join(F.broadcast(spans), (F.col("period") >= F.col("p0")) & (F.col("period") <= F.col("p1")))
    value = F.col("v0") + F.log(F.col("period") / F.col("p0")) / F.log(F.col("p1") / F.col("p0")) * (F.col("v1") - F.col("v0"))
    one = met.groupBy("period", "coefficient").agg(F.max(value).alias("value"))
    return one.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("coefficient", "value"))).alias("c"))


def allocation(weights: list[float], n: int) -> list[int]:
    """n realisations shared by weights: whole parts, and the rest to the largest remainders, the first of equals first."""
    if n < 1 or any(w < 0 for w in weights) or abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1, and there must be a realisation")
    exact = [round(w * n, 9) for w in weights]
    out = [int(x) for x in exact]
    for k in sorted(range(len(weights)), key=lambda k: (out[k] - exact[k], k))[: n - sum(out)]:
        out[k] += 1
    return out
