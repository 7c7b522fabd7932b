"""Finite-fault files, and effective planes against peeling by hand and a plane that is known."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismolake.operators import faults as X
from seismolake.sources import products


def by_hand(slip, part):
    r0, r1, c0, c1 = 0, slip.shape[0] - 1, 0, slip.shape[1] - 1
    while r1 > r0 and c1 > c0:
        edges = [slip[r0 : r1 + 1, c0].sum(), slip[r0 : r1 + 1, c1].sum(), slip[r0, c0 : c1 + 1].sum(), slip[r1, c0 : c1 + 1].sum()]
        k = edges.index(min(edges))
        if slip[r0 : r1 + 1, c0 : c1 + 1].sum() - edges[k] < part * slip.sum() - 1e-9:
            break
        c0, c1, r0, r1 = c0 + (k == 0), c1 - (k == 1), r0 + (k == 2), r1 - (k == 3)
    return r0, r1, c0, c1


def test_peeling_is_by_the_least_edge():
    rng = np.random.default_rng(1)
    for _ in range(60):
        slip = rng.integers(0, 9, (rng.integers(1, 9), rng.integers(1, 9))).astype(float) ** 2
        slip[0, 0] += 1
        assert X.peeled(slip, 0.8) == by_hand(slip, 0.8)
    with pytest.raises(ValueError, match="slip"):
        X.peeled(np.zeros((2, 2)), 0.9)


def test_cells_of_many_models(spark):
    rng = random.Random(2)
    rows = [(m, rng.randrange(-3, 6), rng.randrange(10), rng.random() ** 3) for m in "abc" for _ in range(70)]
    got = {r.model_id: tuple(r)[1:] for r in X.effective_cells(spark.createDataFrame(rows, "model_id string, row long, column long, slip double"), 0.85).collect()}
    for m in "abc":
        own = [r for r in rows if r[0] == m]
        top, left = min(r[1] for r in own), min(r[2] for r in own)
        slip = np.zeros((max(r[1] for r in own) - top + 1, max(r[2] for r in own) - left + 1))
        for _, r, c, s in own:
            slip[r - top, c - left] += s
        r0, r1, c0, c1 = by_hand(slip, 0.85)
        assert got[m] == (r0 + top, r1 + top, c0 + left, c1 + left, pytest.approx(slip[r0 : r1 + 1, c0 : c1 + 1].sum() / slip.sum()))


def fault_text(strike, dip, dx, dz, nx, nz, slips, lon0=85.0, lat0=28.0, z0=12.0):
    """A plane of sub-faults whose first row is 4 km deep, in the public format; the hypocentre is on the plane."""
    head = f"% Event : TEST\n% Loc  : LAT = {lat0}  LON = {lon0}  DEP = {z0}\n% Size : LEN = 1 km  WID = 1 km  Mw = 7.1  Mo = 1e+20 Nm\n% Mech : STRK = {strike}  DIP = {dip}  RAKE = 108  Htop = 1 km\n% Invs : Dx = {dx} km  Dz = {dz} km\n% LAT LON X Y Z SLIP\n"
    lines, degree = [], math.pi * 6371 / 180
    for k in range(nz):
        for i in range(nx):
            z = 4 + k * dz * math.sin(math.radians(dip))
            s, p = (i - nx / 2 + 0.5) * dx, (z - z0) / math.tan(math.radians(dip))
            x = s * math.sin(math.radians(strike)) + p * math.cos(math.radians(strike))
            y = s * math.cos(math.radians(strike)) - p * math.sin(math.radians(strike))
            lines.append(f" {lat0 + y / degree:.6f} {lon0 + x / degree / math.cos(math.radians(lat0 + y / degree / 2)):.6f} {x:.3f} {y:.3f} {z:.4f} {slips[k][i]:.4f} 90.0")
    return head + "\n".join(lines) + "\n% end\nnot a row of six numbers at all\n"


def test_planes_from_files(spark, tmp_path):
    slips = [[0.01] * 9 for _ in range(6)]
    for k in (1, 2, 3):
        for i in (2, 3, 4, 5):
            slips[k][i] = 2.0 + k
    (tmp_path / "a.fsp").write_text(fault_text(293.0, 20.0, 8.0, 7.0, 9, 6, slips))
    (tmp_path / "b.fsp").write_text(fault_text(40.0, 60.0, 5.0, 4.0, 9, 6, slips))
    faults = products.read_faults(spark, str(tmp_path / "*.fsp"))
    assert faults.groupBy("model_id").count().filter("count <> 54").isEmpty() and {r.mag for r in faults.collect()} == {7.1}
    got = {r.model_id: r for r in X.effective_planes(faults).collect()}
    for name, dx, dz, dip, strike in (("a.fsp", 8.0, 7.0, 20.0, 293.0), ("b.fsp", 5.0, 4.0, 60.0, 40.0)):
        r, sin = got[name], math.sin(math.radians(dip))
        assert (r.length_km, r.width_km, r.ztor_km) == (pytest.approx(4 * dx, rel=0.02), pytest.approx(3 * dz, rel=1e-3), pytest.approx(4 + 0.5 * dz * sin, abs=1e-3))
        assert r.kept == pytest.approx(48 / (48 + 42 * 0.01), rel=1e-3)
        (x0, y0, z0), (x1, y1, z1), (_, _, z2), _ = [tuple(c) for c in r.corners]
        assert z0 == z1 < z2
        bearing = math.degrees(math.atan2((x1 - x0) * math.cos(math.radians(28)), y1 - y0)) % 360
        assert bearing == pytest.approx(strike, abs=1.5)
    whole = {r.model_id: r for r in X.effective_planes(faults, 1.0).collect()}
    assert all(whole[k].length_km > got[k].length_km and whole[k].kept == pytest.approx(1.0) for k in got)
    (tmp_path / "bad.txt").write_text("% Loc : LAT = 1 LON = 2\n1 2 3 4 5 6\n")
    with pytest.raises(Exception, match="finite-fault file has no"):
        products.read_faults(spark, str(tmp_path / "bad.txt")).agg(F.sum("strike")).collect()
