"""Finite-fault models: slip on a grid of sub-faults, the part of it that matters, and its plane."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ground

#: The part of all slip that the effective plane holds at least.
SLIP_PART = 0.9


def peeled(slip: np.ndarray, part: float) -> tuple[int, int, int, int]:
    """First and last row and column of the rectangle that is left of a grid (rows by columns) when outer rows and columns go, the one with the least slip first (of equals a first column, a last column, a first row, a last row), as long as `part` of all slip stays.

    Sums of rectangles come from two-dimensional cumulative sums, so a peel looks at four numbers; there are as many as rows and columns at most.
    """
    upto = np.zeros((slip.shape[0] + 1, slip.shape[1] + 1))
    upto[1:, 1:] = slip.cumsum(axis=0).cumsum(axis=1)
    of = lambda r0, r1, c0, c1: upto[r1 + 1, c1 + 1] - upto[r0, c1 + 1] - upto[r1 + 1, c0] + upto[r0, c0]
    total = upto[-1, -1]
    if total <= 0:
        raise ValueError("a fault model has no positive slip")
    r0, r1, c0, c1 = 0, slip.shape[0] - 1, 0, slip.shape[1] - 1
    while r1 > r0 and c1 > c0:
        smaller = [(r0, r1, c0 + 1, c1), (r0, r1, c0, c1 - 1), (r0 + 1, r1, c0, c1), (r0, r1 - 1, c0, c1)]
        edges = [of(r0, r1, c0, c0), of(r0, r1, c1, c1), of(r0, r0, c0, c1), of(r1, r1, c0, c1)]
        best = int(np.argmin(np.round(edges, 12)))
        if of(*smaller[best]) / total < part - 1e-12:
            break
        r0, r1, c0, c1 = smaller[best]
    return r0, r1, c0, c1


RECTANGLE = "model_id string, row0 long, row1 long, column0 long, column1 long, kept double"


def effective_cells(grids: DataFrame, part: float = SLIP_PART) -> DataFrame:
    """RECTANGLE of each model of grids (model_id, row, column, slip): what `peeled` leaves, and the part of the slip in it. Sub-faults of one place add up; missing ones have none. A model's grid is what one task holds."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top, left = rows["row"].min(), rows["column"].min()
        slip = np.zeros((rows["row"].max() - top + 1, rows["column"].max() - left + 1))
        np.add.at(slip, (rows["row"] - top, rows["column"] - left), rows["slip"])
        r0, r1, c0, c1 = peeled(slip, part)
        kept = slip[r0 : r1 + 1, c0 : c1 + 1].sum() / slip.sum()
        return pd.DataFrame([(key[0], r0 + top, r1 + top, c0 + left, c1 + left, kept)], columns=[x.split()[0] for x in RECTANGLE.split(", ")])

    cells = grids.groupBy("model_id", "row", "column").agg(F.sum("slip").alias("slip"))
    return cells.groupBy("model_id").applyInPandas(run, RECTANGLE)


def placed(faults: DataFrame) -> DataFrame:
    """faults (model_id, lon, lat, depth_km, slip and the model's h_lon, h_lat, strike, dip (degrees), dx_km, dz_km) with along and across (km along the strike and to its right from the hypocentre), row and column."""
    x, y = ground.local_frame(F.col("lon"), F.col("lat"), F.col("h_lon"), F.col("h_lat"))
    strike = F.radians("strike")
    rows = faults.withColumns({"along": x * F.sin(strike) + y * F.cos(strike), "across": x * F.cos(strike) - y * F.sin(strike)})
    low = rows.groupBy(F.col("model_id").alias("of")).agg(F.min("along").alias("along0"), F.min("depth_km").alias("depth0"))
    rows = rows.join(low, F.col("model_id") == F.col("of"))
    column = F.rint((F.col("along") - F.col("along0")) / F.col("dx_km")).cast("long")
    row = F.rint((F.col("depth_km") - F.col("depth0")) / (F.col("dz_km") * F.sin(F.radians("dip")))).cast("long")
    return rows.withColumns({"column": column, "row": row}).drop("of", "along0", "depth0")


def effective_planes(faults: DataFrame, part: float = SLIP_PART) -> DataFrame:
    """model_id, length_km, width_km, ztor_km, kept and corners (lon, lat, depth_km: top left, top right, bottom right, bottom left, the strike from left to right) of each model's effective plane.

    The plane goes half a sub-fault beyond the centres that are kept, not above the surface. Where it lies across the strike is the median over the centres, as tables are rounded.
    """
    rows = placed(faults)
    inside = effective_cells(rows.select("model_id", "row", "column", "slip"), part).withColumnRenamed("model_id", "of")
    held = rows.join(inside, (F.col("model_id") == F.col("of")) & F.col("row").between(F.col("row0"), F.col("row1")) & F.col("column").between(F.col("column0"), F.col("column1")))
    tan, half = F.tan(F.radians("dip")), F.col("dz_km") * F.sin(F.radians("dip")) / 2
    own = [F.first(c).alias(c) for c in ("h_lon", "h_lat", "strike", "dip", "kept")]
    ends = held.groupBy("model_id").agg(
        F.min(F.col("along") - F.col("dx_km") / 2).alias("s0"), F.max(F.col("along") + F.col("dx_km") / 2).alias("s1"), F.greatest(F.min(F.col("depth_km") - half), F.lit(0.0)).alias("z0"),
        F.max(F.col("depth_km") + half).alias("z1"), F.median(F.col("across") - F.col("depth_km") / tan).alias("at"), *own,
    )

    def corner(s: str, z: str):
        p, strike = F.col("at") + F.col(z) / tan, F.radians("strike")
        x, y = F.col(s) * F.sin(strike) + p * F.cos(strike), F.col(s) * F.cos(strike) - p * F.sin(strike)
        lon, lat = ground.from_local_frame(x, y, F.col("h_lon"), F.col("h_lat"))
        return F.struct(lon.alias("lon"), lat.alias("lat"), F.col(z).alias("depth_km"))

    corners = F.array(corner("s0", "z0"), corner("s1", "z0"), corner("s1", "z1"), corner("s0", "z1"))
    return ends.select("model_id", (F.col("s1") - F.col("s0")).alias("length_km"), ((F.col("z1") - F.col("z0")) / F.sin(F.radians("dip"))).alias("width_km"), F.col("z0").alias("ztor_km"), "kept", corners.alias("corners"))
