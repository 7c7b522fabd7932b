"""Detectable effects against bisection over the same draws, theory for counts, and whole catalogues in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismolake.operators import power as W


@pytest.fixture(scope="module")
def forecast():
    cells, m = np.repeat(np.arange(12), 3), np.tile(np.arange(3), 12)
    return W.Forecast(cells, m, (1 + cells % 4) * 10.0**-m * 2)


def test_statistics_are_the_definitions(forecast):
    rng = np.random.default_rng(1)
    counts = rng.poisson(forecast.rates)
    n, rates = counts.sum(), forecast.rates
    term = lambda c, r: sum(k * math.log(x) - math.lgamma(k + 1) for k, x in zip(c, r, strict=True)) - sum(r)
    cell = lambda v: v.reshape(12, 3).sum(axis=1)
    assert W.statistic("N", forecast, rates, counts) == n and W.statistic("L", forecast, rates, counts) == pytest.approx(term(counts, rates))
    assert W.statistic("CL", forecast, rates, counts) == pytest.approx(term(counts, rates * n / rates.sum()))
    assert W.statistic("S", forecast, rates, counts) == pytest.approx(term(cell(counts), cell(rates) * n / rates.sum()))
    assert W.statistic("M", forecast, rates, counts) == pytest.approx(term(counts.reshape(12, 3).sum(axis=0), rates.reshape(12, 3).sum(axis=0) * n / rates.sum()))
    assert forecast.concentrated(1.0) == pytest.approx(rates) and forecast.concentrated(3.0).sum() == pytest.approx(rates.sum())


def test_candidates_share_draws_and_have_their_own_rates(spark, forecast):
    drawn = [forecast.rates, forecast.rates * 1.5, forecast.rates * 3]
    rows = W.simulated(spark, forecast, "N", drawn, drawn, 600, 3)
    by = {}
    for r in rows.collect():
        by.setdefault(r.simulation, {})[r.candidate] = r.statistic
    assert len(by) == 600 and all(v[0] <= v[1] <= v[2] for v in by.values())
    for k, rates in enumerate(drawn):
        counts = np.array([v[k] for v in by.values()])
        assert counts.mean() == pytest.approx(rates.sum(), rel=0.03) and counts.var() == pytest.approx(rates.sum(), rel=0.2)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, W.simulated(spark, forecast, "N", drawn, drawn, 600, 3).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def bisected(spark, forecast, test, family, null, extreme, simulations, seed):
    def power_of(p):
        got = W.powers(W.simulated(spark, forecast, test, [forecast.rates, family(p)], [forecast.rates] * 2, simulations, seed), test, {1: 0}, simulations, 0.05)
        return got[1]

    low, high = null, extreme
    while abs(math.log(high / low)) > math.log(1.04):
        middle = math.sqrt(low * high)
        low, high = (low, middle) if power_of(middle) >= 0.8 else (middle, high)
    return low, high


@pytest.mark.parametrize(("test", "extreme"), [("N", 20.0), ("N", 0.05), ("S", 8.0)])
def test_least_effect_is_what_bisection_finds(spark, forecast, test, extreme):
    family = forecast.multiplied if test == "N" else forecast.concentrated
    got = W.minimum_detectable_effect(spark, forecast, test, family, 1.0, extreme, simulations=300, seed=5, tolerance=0.03)
    low, high = bisected(spark, forecast, test, family, 1.0, extreme, 300, 5)
    assert got == pytest.approx(math.sqrt(low * high), rel=0.08)
    if test == "N":  # a normal count: k n - n = 1.96 sqrt(n) + 0.84 sqrt(k n)
        n = forecast.rates.sum()
        gap = abs(got - 1) * n - 1.96 * math.sqrt(n) - 0.84 * math.sqrt(got * n)
        assert abs(gap) < 0.35 * math.sqrt(n)


def test_what_no_test_sees(spark, forecast):
    assert W.minimum_detectable_effect(spark, forecast, "N", forecast.concentrated, 1.0, 5.0, simulations=200, seed=1) is None
    even = W.Forecast(np.arange(5), np.zeros(5), np.ones(5))
    assert W.minimum_detectable_effect(spark, even, "S", even.concentrated, 1.0, 8.0, simulations=200, seed=1) is None
    for bad in (dict(power=0.01), dict(null=0.0), dict(test="X")):
        with pytest.raises(ValueError):
            W.minimum_detectable_effect(spark, forecast, **(dict(test="N", family=forecast.multiplied, null=1.0, extreme=2.0) | bad))
    with pytest.raises(ValueError, match="positive"):
        W.Forecast(np.arange(2), np.arange(2), np.array([1.0, 0.0]))


def test_events_needed_fall_with_the_effect(spark, forecast):
    need = lambda k: W.events_needed(spark, forecast, "N", lambda f: f.multiplied(k), simulations=200, seed=2)
    strong, weak = need(1.8), need(1.3)
    assert strong < weak
    for k, n in ((1.8, strong), (1.3, weak)):  # (k - 1) sqrt(n) = 1.96 + 0.84 sqrt(k)
        assert n == pytest.approx(((1.96 + 0.84 * math.sqrt(k)) / (k - 1)) ** 2, rel=0.35)
    assert W.events_needed(spark, forecast, "N", lambda f: f.multiplied(1.001), simulations=100, seed=2, most=100.0) is None


def test_forecast_from_bins(spark):
    bins = spark.range(6).select((F.col("id") % 3).alias("cell_ix"), F.floor(F.col("id") / 3).alias("m_bin"), (F.col("id") + 1.0).alias("rate"))
    f = W.Forecast.of(bins)
    assert f.rates.tolist() == [1.0, 4.0, 2.0, 5.0, 3.0, 6.0] and f.cells.tolist() == [0, 0, 1, 1, 2, 2] and f.m_bins.tolist() == [0, 1] * 3
