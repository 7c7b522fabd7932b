"""The inversion of the space-time model against all pairs in numpy, a simulated catalogue and its own likelihood; pairs within reach on the whole sphere."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismolake.operators import inversion as I
from seismolake.plans import nearby

DAY = 86_400_000_000
MC, BETA = 3.0, 2.1
TRUE = {"log10_mu": -4.75, "log10_k0": -1.75, "a": 1.6, "log10_c": -2.0, "omega": 0.05, "log10_tau": 2.5, "log10_d": 0.0, "gamma": 1.0, "rho": 0.9}
DAYS, SIDE_KM = 400.0, 400.0
COLUMNS = "event_id long, t_us long, lon double, lat double, mag double"


def simulated(seed: int) -> list[tuple]:
    """A catalogue near the equator: background, and offspring of all generations by the kernel's own laws."""
    rng = np.random.default_rng(seed)
    c, tau, d = (10 ** TRUE[f"log10_{x}"] for x in ("c", "tau", "d"))
    delays = np.geomspace(1e-6, 20 * tau, 4000)
    mass = I.time_mass(np.zeros(len(delays)), delays, c, TRUE["omega"], tau)
    n = rng.poisson(10 ** TRUE["log10_mu"] * SIDE_KM**2 * DAYS)
    waiting = list(zip(rng.uniform(0, DAYS, n), rng.uniform(0, SIDE_KM, n), rng.uniform(0, SIDE_KM, n), MC + rng.exponential(1 / BETA, n), strict=True))
    out = []
    while waiting:
        t, x, y, m = waiting.pop()
        out.append((t, x, y, m))
        wide = d * math.exp(TRUE["gamma"] * (m - MC))
        k = rng.poisson(10 ** TRUE["log10_k0"] * math.exp(TRUE["a"] * (m - MC)) * mass[-1] * math.pi / TRUE["rho"] * wide ** -TRUE["rho"])
        s = t + np.interp(rng.uniform(0, mass[-1], k), mass, delays)
        r = np.sqrt(wide * (rng.uniform(size=k) ** (-1 / TRUE["rho"]) - 1))
        turn = rng.uniform(0, 2 * math.pi, k)
        born = zip(s, x + r * np.cos(turn), y + r * np.sin(turn), MC + rng.exponential(1 / BETA, k), strict=True)
        waiting += [e for e in born if e[0] < DAYS and 0 <= e[1] < SIDE_KM and 0 <= e[2] < SIDE_KM]
    degree = math.pi * 6371.0 / 180
    return [(k, int(t * DAY), float(x / degree), float(y / degree - 1.8), float(m)) for k, (t, x, y, m) in enumerate(sorted(out))]


def all_pairs(events, start_us, theta):
    """Rates of the targets from every earlier source within reach."""
    rates = {}
    for i, t, lon, lat, _ in events:
        if t >= start_us:
            rate = 10 ** theta["log10_mu"]
            for _, s, x, y, m in events:
                if s < t:
                    a = math.sin(math.radians(lat - y) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(lon - x) / 2) ** 2
                    km = 2 * 6371.0 * math.asin(min(1, math.sqrt(a)))
                    if km <= min(2000.0, 100 * 10 ** (-2.44 + 0.59 * m)):
                        rate += float(I.kernel(theta, MC, np.array([m]), np.array([(t - s) / I.DAY_US]), np.array([km * km]))[0])
            rates[i] = rate
    return rates


def test_expectation_is_that_of_all_pairs(spark):
    events = simulated(1)[:220]
    start = events[40][1]
    df = spark.createDataFrame(events, COLUMNS)
    want = all_pairs(events, start, TRUE)
    exact = I.expectation(I.pair_table(df, start, int(DAYS * DAY), compressed=False), TRUE, MC).collect()
    assert {r.event_id: pytest.approx(r.rate, rel=1e-9) for r in exact} == want and all(r.background == pytest.approx(10 ** TRUE["log10_mu"] / want[r.event_id]) for r in exact)
    close = I.expectation(I.pair_table(df.repartition(3), start, int(DAYS * DAY)), TRUE, MC).collect()
    assert {r.event_id: pytest.approx(r.rate, rel=2e-3) for r in close} == want
    sums = I.expected_sums(I.pair_table(df, start, int(DAYS * DAY)), TRUE, MC).toPandas()
    assert sums[sums.kind == 0].x.sum() == pytest.approx(sum(map(math.log, want.values())), rel=1e-4)
    assert sums[sums.kind == 1].p.sum() == pytest.approx(sums[sums.kind == 2].p.sum()) == pytest.approx(sum(1 - 10 ** TRUE["log10_mu"] / r for r in want.values()), rel=1e-3)


def test_time_mass_is_the_integral():
    s = np.linspace(0.5, 40, 2_000_001)
    f = np.exp(-s / 30) * (s + 0.01) ** -1.1
    assert I.time_mass(np.array([0.5]), np.array([40.0]), 0.01, 0.1, 30.0)[0] == pytest.approx(((f[1:] + f[:-1]) / 2 * np.diff(s)).sum(), rel=1e-8)


def test_inversion_recovers_a_simulated_catalogue(spark):
    events = simulated(7)
    df = spark.createDataFrame(events, COLUMNS).repartition(4)
    start, end = int(20 * DAY), int(DAYS * DAY)
    beta = I.aki_beta(df, MC, 0.0)
    assert beta == pytest.approx(BETA, rel=0.15)
    begin = TRUE | {"log10_mu": -5.5, "log10_k0": -2.2, "a": 1.2, "log10_c": -2.4, "omega": -0.1, "log10_d": -0.4, "gamma": 0.6, "rho": 0.6}
    steps = I.invert(df, SIDE_KM**2, start, end, MC, beta, begin, iterations=22, most_km=400.0).orderBy("iteration").collect()
    assert all(b.ll >= a.ll - 0.05 for a, b in zip(steps, steps[1:], strict=False))
    truth = I.Objective(I.expected_sums(I.pair_table(df, start, end, 400.0), TRUE, MC).toPandas(), I.source_table(df, start, end).toPandas(), MC)
    at_truth = truth.log_rates - 10 ** TRUE["log10_mu"] * SIDE_KM**2 * (DAYS - 20) - truth.expected(TRUE)
    fit = steps[-1]
    assert fit.ll > at_truth - 1.5 and fit.n_targets == sum(start <= e[1] for e in events)
    assert fit.log10_mu == pytest.approx(TRUE["log10_mu"], abs=0.1) and fit.rho == pytest.approx(TRUE["rho"], abs=0.3) and fit.a == pytest.approx(TRUE["a"], abs=0.5)
    assert fit.branching_ratio == pytest.approx(I.branching_ratio(TRUE, BETA), abs=0.2)
    assert fit.n_background + truth.triggered == pytest.approx(fit.n_targets, rel=0.15)


def test_maximisation_keeps_bounds_and_the_best_productivity(spark):
    events = simulated(3)[:150]
    df = spark.createDataFrame(events, COLUMNS)
    end = int(DAYS * DAY)
    o = I.Objective(I.expected_sums(I.pair_table(df, 0, end), I.START, MC).toPandas(), I.source_table(df, 0, end).toPandas(), MC)
    theta = I.maximised(o, I.START)
    assert all(low <= theta[n] <= high for n, (low, high) in I.BOUNDS.items()) and o.value(theta) >= o.value(I.START)
    for name in I.NAMES[1:]:
        for step in (-0.01, 0.01):
            moved = theta | {name: float(np.clip(theta[name] + step, *I.BOUNDS[name]))}
            assert o.value(moved) <= o.value(theta) + 1e-4 * abs(o.value(theta))
    with pytest.raises(ValueError, match="bounds"):
        I.invert(df, 1.0, 0, end, MC, BETA, I.START | {"rho": 9.0})
    with pytest.raises(ValueError, match="no events"):
        I.invert(df, 1.0, end, 2 * end, MC, BETA)


def test_pairs_within_reach_on_the_whole_sphere(spark, monkeypatch):
    """Poles, 180 degrees, equal points, points without a place, reaches of all classes, and cells that are split."""
    monkeypatch.setattr(nearby, "HOT_ROWS", 20)
    monkeypatch.setattr(nearby, "HOT_PART", 10**6)
    rng = random.Random(5)
    points = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(150)]
    points += [(rng.choice([-179.99, 179.99, 180.0, -180.0, 0.0]), rng.choice([-90.0, 90.0, 89.9, -89.95, 80.0, 0.0])) for _ in range(60)]
    points += [(10.0 + rng.uniform(0, 0.01), 20.0) for _ in range(60)] + [(None, 1.0), (1.0, None), (370.0, 10.0), (10.0, 10.0)]
    rows = [(k, lon, lat, rng.choice([0.0, 1.0, 30.0, 300.0, 1500.0, None])) for k, (lon, lat) in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, reach_km double")
    got = {(r.id_l, r.id_r): r.km for r in nearby.pairs_within(df, df, F.col("reach_km"), 1500.0, F.col("id_l") < F.col("id_r")).collect()}
    want = {}
    for i, x, y, _ in rows:
        for j, u, v, reach in rows:
            if i < j and None not in (x, y, u, v, reach):
                a = math.sin(math.radians(y - v) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(x - u) / 2) ** 2
                km = 2 * 6371.0 * math.asin(min(1, math.sqrt(a)))
                if abs(km - reach) > 1e-6 and km <= reach:
                    want[i, j] = pytest.approx(km, abs=1e-6)
    assert {k: v for k, v in got.items() if abs(v - rows[k[1]][3]) > 1e-6} == want
    with pytest.raises(Exception, match="most_km"):
        nearby.pairs_within(df, df, F.col("reach_km"), 100.0).collect()


def test_summed_rates_are_those_of_all_pairs_without_a_list_of_them(spark):
    events = simulated(1)[:220]
    start = events[40][1]
    rows = I.summed_rates(spark.createDataFrame(events, COLUMNS), TRUE, MC, start, int(DAYS * DAY))
    want = all_pairs(events, start, TRUE)
    got = rows.collect()
    assert {r.event_id: pytest.approx(r.rate, rel=1e-9) for r in got} == want and all(r.background == pytest.approx(10 ** TRUE["log10_mu"] / want[r.event_id]) for r in got)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan


def test_points_that_become_many_rows_are_not_broadcast(spark, monkeypatch):
    """Left is small by Spark's estimate, right has more points; only a right of few points is broadcast, whatever the classes."""
    left = spark.range(60).select("id", (F.col("id") / 10).alias("lon"), (F.col("id") % 7).cast("double").alias("lat"))
    right = spark.range(90).select("id", (F.col("id") / 15).alias("lon"), (F.col("id") % 5).cast("double").alias("lat"))
    found = []
    for most in (100_000, 10):
        monkeypatch.setattr(nearby, "BROADCAST_ROWS", most)
        met = nearby.pairs_within(left, right, F.lit(40.0), 600.0)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Inner, BuildLeft" not in plan and ("Inner, BuildRight" in plan) == (most > 10)
        assert "explode([4])" in plan
        found.append(sorted((r.id_l, r.id_r, round(r.km, 6)) for r in met.collect()))
    assert found[0] == found[1] and found[0]


def test_pairs_are_equal_in_what_they_share(spark):
    rows = [(k, float(k % 9) / 4, float(k % 4) / 4, k % 3) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, slot int")
    both = nearby.pairs_within(df, df, F.lit(50.0), 50.0, F.col("id_l") < F.col("id_r"))
    want = sorted((r.id_l, r.id_r) for r in both.collect() if r.slot_l == r.slot_r)
    assert sorted((r.id_l, r.id_r) for r in nearby.pairs_within(df, df, F.lit(50.0), 50.0, F.col("id_l") < F.col("id_r"), same=("slot",)).collect()) == want and want


def test_blocks_sum_all_pairs_on_the_whole_sphere(spark, monkeypatch):
    """Against the uncompressed pair table: poles, 180 degrees, equal times and places, split blocks and small pieces. Blocks hold events, not pairs."""
    monkeypatch.setattr(I, "BLOCK_TARGETS", 15)
    monkeypatch.setattr(I, "PIECE", 400)
    rng = random.Random(2)
    at = lambda: rng.choice([(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))), (rng.choice([179.9, -179.9, 180.0, 0.0]), rng.choice([89.7, -89.8, 90.0, 60.0])), (10 + rng.uniform(0, 3), 20 + rng.uniform(0, 3))])
    rows = [(i, rng.randrange(200) * DAY // 4, *at(), 3.0 + rng.choice([0.0, 0.4, 2.0, 3.1])) for i in range(500)] + [(900, 30 * DAY, None, 1.0, 4.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    start, end = 5 * DAY, 48 * DAY
    table = I.pair_table(df.filter("lon IS NOT NULL"), start, end, 700.0, compressed=False)
    want = {(r.kind, r.i, r.j): (r.p, r.x, r.y) for r in I.expected_sums(table, TRUE, MC).collect()}
    blocks = I.block_table(df, start, end, 700.0).collect()
    got = {(r.kind, r.i, r.j): (r.p, r.x, r.y) for r in I.summed_blocks(I.block_table(df, start, end, 700.0), TRUE, MC).collect()}
    assert sum(len(r.targets) for r in blocks) == table.count() and max(len(r.targets) for r in blocks) < 60
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)
    assert want[0, 0, 0][0] == table.count() and len(want) > 50
