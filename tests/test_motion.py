"""The ground motion model against the equations in plain Python, its branches' shares, and coefficients between periods."""

import math

import pytest
from pyspark.sql import functions as F

from seismolake.functions import motion as G
from seismolake.operators import event_based as B


def plain(c, mag, rake, rjb, vs30):
    """Equations of the paper, one after the other."""

    def rock(c):
        base = c["e0"] if rake is None else c["e1"] if abs(rake) <= 30 or 180 - abs(rake) <= 30 else c["e3"] if 30 < rake < 150 else c["e2"]
        size = c["e4"] * (mag - c["Mh"]) + c["e5"] * (mag - c["Mh"]) ** 2 if mag <= c["Mh"] else c["e6"] * (mag - c["Mh"])
        r = math.hypot(rjb, c["h"])
        return base + size + (c["c1"] + c["c2"] * (mag - 4.5)) * math.log(r) + (c["c3"] + c["Dc3"]) * (r - 1)

    pga = math.exp(rock(G.PGA_2014 | {"Dc3": c["Dc3"]}))
    f2 = c["f4"] * (math.exp(c["f5"] * (min(vs30, 760) - 360)) - math.exp(c["f5"] * 400))
    mean = rock(c) + c["c"] * math.log(min(vs30, c["Vc"]) / 760) + f2 * math.log((pga + 0.1) / 0.1)
    near = min(1, max(0, mag - 4.5))
    phi = c["f1"] + (c["f2"] - c["f1"]) * near
    phi += c["DfR"] if rjb > c["R2"] else c["DfR"] * math.log(rjb / c["R1"]) / math.log(c["R2"] / c["R1"]) if rjb > c["R1"] else 0
    phi -= c["DfV"] if vs30 <= 225 else c["DfV"] * math.log(300 / vs30) / math.log(300 / 225) if vs30 <= 300 else 0
    return mean, c["tau1"] + (c["tau2"] - c["tau1"]) * near, phi


def test_model_is_the_equations(spark):
    cases = [(m, rake, r, v) for m in (4.0, 5.0, 5.5, 6.2, 8.0) for rake in (None, 0.0, 90.0, -90.0, 170.0, 31.0) for r in (0.0, 10.0, 110.0, 200.0, 400.0) for v in (150.0, 260.0, 500.0, 760.0, 1800.0)]
    df = spark.createDataFrame(cases, "mag double, rake double, rjb double, vs30 double").coalesce(1)
    for c in (G.PGA_2014, G.PGA_2014 | {"Dc3": G.MUCH_LOSS, "c": -0.8}):
        pga = G.PGA_2014 | {"Dc3": c["Dc3"]}
        mean, tau, phi = G.boore_2014(c, pga, F.col("mag"), F.col("rake"), F.col("rjb"), F.col("vs30"))
        for r in df.select("*", mean.alias("mean"), tau.alias("tau"), phi.alias("phi")).collect():
            assert (r.mean, r.tau, r.phi) == pytest.approx(plain(c, r.mag, r.rake, r.rjb, r.vs30), rel=1e-9)
    # known behaviour: a strike-slip event of 7 at 20 km on rock shakes by some 0.15 g
    assert 0.13 < math.exp(plain(G.PGA_2014, 7.0, 0.0, 20.0, 760.0)[0]) < 0.17


def test_realisations_are_apportioned_and_share_the_events_draw(spark):
    assert G.allocation([1 / 3] * 3, 4) == [2, 1, 1] and G.allocation([0.5, 0.3, 0.2], 10) == [5, 3, 2] and G.allocation([1.0], 3) == [3] and G.allocation([0.6, 0.4], 1) == [1, 0]
    for bad in (([0.5, 0.4], 3), ([1.0], 0), ([1.5, -0.5], 2)):
        with pytest.raises(ValueError):
            G.allocation(*bad)
    events = spark.createDataFrame([(k, 179.95, 10.0, 6.0, None) for k in range(40)], "event_id long, lon double, lat double, mag double, rake double")
    sites = spark.createDataFrame([(1, -179.95, 10.0, 400.0), (2, -179.95, 10.0, 400.0), (3, 0.0, 10.0, 400.0)], "site_id long, s_lon double, s_lat double, vs30 double")
    rows = B.logic_tree_fields(events, sites, [("a", 0.5, 0.0), ("b", 0.5, -0.01)], 6, 3.0, 1, 100.0).collect()
    assert len(rows) == 40 * 2 * 6 and {r.site_id for r in rows} == {1, 2} and sum(r.branch == "a" for r in rows) == len(rows) / 2
    assert all((r.realisation < 3) == (r.branch == "a") for r in rows)
    residual = {(r.event_id, r.realisation, r.site_id): math.log(r.im) - r.mean_ln for r in rows}
    pairs = [(residual[e, k, 1], residual[e, k, 2]) for e in range(40) for k in range(6)]
    shared = sum(a * b for a, b in pairs) / len(pairs)
    assert shared == pytest.approx(0.348**2, rel=0.5) and all(r.im == pytest.approx(math.exp(r.mean_ln)) for r in B.logic_tree_fields(events, sites, [("a", 1.0, 0.0)], 1, 0.0, 1, 100.0).collect())


def test_coefficients_between_periods(spark):
    table = spark.createDataFrame([(0.1, "e0", 1.0), (1.0, "e0", 3.0), (10.0, "e0", 2.0), (0.1, "e1", 0.0), (10.0, "e1", 4.0)], "period double, coefficient string, value double")
    got = {r.period: r.c for r in G.coefficients_at(table, spark.createDataFrame([(0.1,), (math.sqrt(0.1),), (1.0,), (10.0,), (11.0,)], "period double")).collect()}
    assert set(got) == {0.1, math.sqrt(0.1), 1.0, 10.0}
    assert got[1.0] == {"e0": pytest.approx(3.0), "e1": pytest.approx(2.0)} and got[math.sqrt(0.1)] == {"e0": pytest.approx(2.0), "e1": pytest.approx(1.0)} and got[10.0]["e0"] == pytest.approx(2.0)
