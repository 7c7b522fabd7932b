"""Completeness by goodness of fit against magnitudes in numpy, and fields against counting by hand."""

import math
import random

import numpy as np
import pytest

from seismolake.operators import completeness as K


def distances(bins: np.ndarray, cut: int) -> tuple[int, float, float]:
    tail = bins[bins >= cut]
    beta = math.log1p(0.1 / (0.1 * (tail.mean() - cut))) / 0.1
    k = np.arange(cut, tail.max() + 1)
    emp = (tail[:, None] <= k).mean(axis=0)
    return len(tail), beta, float(np.abs(emp - (1 - np.exp(-beta * 0.1 * (k - cut + 1)))).max())


@pytest.fixture(scope="module")
def bins():
    """Exponential above 3.0, thinned below, one far outlier and a gap."""
    rng = np.random.default_rng(4)
    m = np.floor(rng.exponential(1 / 2.1, 6000) * 10).astype(int) + 20
    keep = rng.uniform(size=len(m)) < np.where(m < 30, (m - 18) / 14, 1.0)
    return np.r_[m[keep], [95]]


def test_distances_are_those_of_the_events(spark, bins):
    df = spark.createDataFrame([(int(b),) for b in bins] + [(None,)], "mbin long")
    got = {r.cut_bin: (r.n, r.beta, r.distance) for r in K.ks_distances(df).collect()}
    highest = np.sort(bins)[math.ceil(len(bins) * 0.9) - 1]
    assert sorted(got) == list(range(bins.min(), highest + 1))
    assert got == {c: (pytest.approx(d[0]), pytest.approx(d[1]), pytest.approx(d[2])) for c in got for d in [distances(bins, c)]}
    sparse = np.array([20, 20, 25, 25, 25, 40])
    got = {r.cut_bin: r.distance for r in K.ks_distances(spark.createDataFrame([(int(b),) for b in sparse], "mbin long")).collect()}
    assert got.pop(40) is None and got == {c: pytest.approx(distances(sparse, c)[2]) for c in got} and {20, 21, 25} <= set(got)


def test_probabilities_are_the_same_for_any_partitioning_and_like_those_of_simulated_events(spark, bins):
    df = spark.createDataFrame([(int(b),) for b in bins], "mbin long")
    got = {r.cut_bin: r.p for r in K.ks_probabilities(df, 400, 5).collect()}
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    again = {r.cut_bin: r.p for r in K.ks_probabilities(df.repartition(7), 400, 5).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == again
    rng = np.random.default_rng(9)
    for cut in (22, 30, 34):
        n, beta, apart = distances(bins, cut)
        far = 0
        for _ in range(400):
            tail = np.floor(rng.exponential(1 / beta, n) * 10).astype(int) + cut
            k = np.arange(cut, tail.max() + 1)
            emp = np.searchsorted(np.sort(tail), k, "right") / n
            far += np.abs(emp - (1 - np.exp(-beta * 0.1 * (k - cut + 1)))).max() >= apart
        assert got[cut] == pytest.approx(far / 400, abs=0.1)
    best = K.ks_completeness(df, 400, 5).first()
    assert 2.6 <= best.mc <= 3.2 and best.p >= 0.1 and best.beta == pytest.approx(2.1, rel=0.1)
    assert got[22] < 0.1
    empty = df.limit(0)
    assert K.ks_completeness(empty, 10, 1).count() == 0 and K.ks_distances(df.limit(1)).collect()[0].beta is None


def test_fields_take_the_fewest_rings(spark):
    rng = random.Random(2)
    cells = [(iy * 6 + ix, ix, iy) for iy in range(5) for ix in range(6)]
    events = [(rng.choice([7, 7, 7, 8, 14, 29, 20]), rng.choice([25, 26, 26, 27, 31])) for _ in range(150)] + [(0, 30)] * 500 + [(3, None)]
    got = K.completeness_field(spark.createDataFrame(events, "cell_ix long, mbin long"), spark.createDataFrame(cells, "cell_ix long, ix long, iy long"), 20, 2).collect()
    assert len(got) == 30
    for r in got:
        near = lambda ring, r=r: [m for c, m in events if m is not None and max(abs(c % 6 - r.ix), abs(c // 6 - r.iy)) <= ring]
        rings = next((k for k in range(3) if len(near(k)) >= 20), None)
        assert r.n_events == len(near(0)) and r.rings == rings
        if rings is None:
            assert r.mc is None and r.n_used is None
        else:
            counts = {m: near(rings).count(m) for m in near(rings)}
            top = min(m for m in counts if counts[m] == max(counts.values()))
            assert (r.n_used, r.mc) == (len(near(rings)), pytest.approx(top / 10 + 0.2))
