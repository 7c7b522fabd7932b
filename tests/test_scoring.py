"""Scores, alarms, schedules and ground models against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismolake import scoring_queries as Q
from seismolake.functions import ground as D
from seismolake.functions.shared_draws import PRIME, uniform
from seismolake.operators import alarms as A
from seismolake.operators import consistency as N
from seismolake.operators import features as X
from seismolake.operators import schedule as P


def test_shared_draws_follow_the_arithmetic_and_spread(spark):
    once = lambda h: (h * h + 48271 * h + 12345) % PRIME
    h = 7
    for k in (3, 5):
        h = once(once((h + k) % PRIME))
    assert spark.range(1).select(uniform(7, F.lit(3), F.lit(5))).first()[0] == (h + 0.5) / PRIME
    u = np.array([r[0] for r in spark.range(20000).select(uniform(1, "id")).collect()])
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02 and (np.histogram(u, 20, (0, 1))[0] > 850).all()


def test_conditional_tests_pass_the_truth_and_refuse_its_opposite(spark):
    rng = np.random.default_rng(1)
    rate = np.r_[np.full(20, 5.0), np.full(20, 0.2)]
    n = rng.poisson(rate)
    rows = [(i, 0, float(r), int(k)) for i, (r, k) in enumerate(zip(rate, n, strict=True))]
    good = spark.createDataFrame(rows, "cell_ix long, m_bin long, rate double, n long")
    bad = spark.createDataFrame([(i, m, float(rate[-1 - i]), k) for i, m, _, k in rows], good.schema)
    assert {r.test: r.passed for r in N.consistency_tests(good, 200, 3).collect()} == dict.fromkeys(("L", "CL", "S", "M"), True)
    assert not any(r.passed for r in N.consistency_tests(bad, 200, 3).filter("test IN ('L', 'CL', 'S')").collect())
    power = N.simulated_power(N.marginal(good, "cell_ix"), N.marginal(bad, "cell_ix"), 200, 3).first()
    assert power.power > 0.95 and power.level <= 0.05


def test_no_events_no_verdict(spark):
    none = spark.createDataFrame([(0, 0, 1.0, 0), (1, 0, 2.0, 0)], "cell_ix long, m_bin long, rate double, n long")
    assert all(r.passed is None and r.quantile is None for r in N.consistency_tests(none, 20, 1).filter("test <> 'L'").collect())
    assert N.number_test(none).first().delta1 == 1.0


def test_alternatives_keep_the_total(spark, sf_dir):
    bins = Q.forecast_bins(spark, sf_dir)
    total = bins.agg(F.sum("rate")).first()[0]
    for other in (N.spatial_concentration(bins, 2.0), N.spatial_hotspot(bins, [1, 2], 0.3), N.magnitude_tilt(bins, 0.3, 0.5)):
        assert other.agg(F.sum("rate")).first()[0] == pytest.approx(total)
    assert N.rate_multiplier(bins, 2.0).agg(F.sum("rate")).first()[0] == pytest.approx(2 * total)


def test_alarm_refusals_and_tails(spark):
    cells = spark.createDataFrame([(0, 2.0, 0.5, 3), (1, 1.0, 0.5, 0)], "cell_ix long, alarm double, mass double, n long")
    with pytest.raises(ValueError):
        A.score_alarm(cells, 1.5, 10, 1, uniform_reference=True)
    r = A.score_alarm(cells, 1.5, 99, 1).first()
    assert (r.tau, r.hits, r.gain, r.p_value) == (0.5, 3, 2.0, pytest.approx(0.125)) and 0.3 < r.matched_p < 0.7
    assert A.declared_point(cells, 5.0).first().gain is None
    with pytest.raises(ValueError):
        A.pooled_schedule(cells.withColumn("window", F.lit(1)).withColumn("expected", F.lit(0.0)))
    assert A.minimum_detectable_gain(3, 0.5, 0.05, 0.8) is None
    assert 1 < A.minimum_detectable_gain(50, 0.1, 0.05, 0.8) < 10


def numpy_distances(lon, lat):
    """Densely sampled planes and edges instead of geometry."""
    o = np.mean([c[:2] for c in Q.FAULT], 0)

    def plane(x, y):
        la, lo, la0, lo0 = map(np.radians, (y, x, o[1], o[0]))
        km = 2 * 6371.0 * np.arcsin(np.sqrt(np.sin((la - la0) / 2) ** 2 + np.cos(la0) * np.cos(la) * np.sin((lo - lo0) / 2) ** 2))
        az = np.arctan2(np.sin(lo - lo0) * np.cos(la), np.cos(la0) * np.sin(la) - np.sin(la0) * np.cos(la) * np.cos(lo - lo0))
        return np.array([km * np.sin(az), km * np.cos(az)])

    corners = np.array([[*plane(x, y), z] for x, y, z in Q.FAULT])
    s, t = np.meshgrid(np.linspace(0, 1, 400), np.linspace(0, 1, 400))
    a, b, c, d = corners
    keep = s >= t
    first = a + s[keep][:, None] * (b - a) + t[keep][:, None] * (c - b)
    second = a + s[keep][:, None] * (c - a) + t[keep][:, None] * (d - c)
    surface = np.r_[first, second]
    p = plane(lon, lat)
    return np.sqrt(((surface - [*p, 0]) ** 2).sum(1).min()), np.sqrt(((surface[:, :2] - p) ** 2).sum(1).min())


def test_plane_distances_match_a_sampled_plane(spark):
    rng = random.Random(4)
    points = [(rng.uniform(83.5, 85.6), rng.uniform(27.5, 28.8)) for _ in range(40)]
    got = D.plane_distances(F.col("lon"), F.col("lat"), Q.FAULT, Q.HYPOCENTRE)
    rows = spark.createDataFrame(points, "lon double, lat double").select("lon", "lat", *(got[k].alias(k) for k in ("rrup", "rjb", "rhypo"))).collect()
    for r in rows:
        rrup, rjb = numpy_distances(r.lon, r.lat)
        assert abs(r.rrup - rrup) < 0.4 and abs(r.rjb - rjb) < 0.4 and r.rhypo >= r.rrup - 1 and r.rjb <= r.rrup + 1e-9
    point = D.plane_distances(F.col("lon"), F.col("lat"), [], Q.HYPOCENTRE)
    r = spark.createDataFrame([Q.HYPOCENTRE[:2]], "lon double, lat double").select(point["rjb"].alias("rjb"), point["rhypo"].alias("rhypo")).first()
    assert r.rjb == pytest.approx(0, abs=1e-9) and r.rhypo == pytest.approx(12.0)
    with pytest.raises(ValueError):
        D.plane_distances(F.col("lon"), F.col("lat"), Q.FAULT[:3], Q.HYPOCENTRE)


def test_blur_reflects_and_keeps_a_constant(spark):
    flat = spark.createDataFrame([(x, y, 3.0) for x in range(5) for y in range(4)], "ix long, iy long, value double")
    assert all(r.value == pytest.approx(3.0) for r in X.gaussian_blur(flat, 5, 4, 1.0).collect())


def test_snapshots_change_only_at_refits(spark):
    windows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "issue_us long, snapshot string")
    refits = spark.createDataFrame([(3, "b")], "boundary_us long, snapshot string")
    assert [r.issue_us for r in P.snapshot_breaks(windows, refits).collect()] == [4]
    fits = spark.createDataFrame([(1, 10, 9), (2, 10, 10), (3, 10, None)], "fit_id long, cutoff_us long, training_max_us long")
    assert sorted(r.fit_id for r in P.late_training(fits).collect()) == [2, 3]


def test_undecided_comparisons_say_why(spark):
    totals = spark.range(1).select(F.lit(1.0).alias("n_a"), F.lit(1.0).alias("n_b"))
    why = lambda rows: P.paired_interval(spark.createDataFrame(rows, "d double"), totals).first().reason
    assert why([(1.0,)]) == "fewer than two events" and why([(1.0,), (math.inf,)]) == "a rate of zero" and why([(1.0,), (1.0,)]) == "no variance"
    assert why([(1.0,), (2.0,)]) is None


def test_each_iteration_of_the_fit_is_at_least_as_likely(spark, sf_dir):
    steps = [r.ll for r in Q.etas_fit(spark, sf_dir).orderBy("iteration").collect()]
    assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:], strict=False))
    assert Q.M.branching_ratio(0.02, 1.2, 0.01, 1.1, 1.0) == pytest.approx(0.02 * 0.01**-0.1 / 0.1 * math.log(10) / (math.log(10) - 1.2))
    with pytest.raises(ValueError):
        Q.M.triggered_forecast(None, None, 0, 1.0, 1.0, 1.0, 1.0, 0.01, 1.1, 1.0, 1.5, 4.0, 1.0, 0.5)
