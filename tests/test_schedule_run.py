"""The schedule's checks, parameters' hashes, times in any session zone, tails, and fields across 180 degrees and near the poles."""

import datetime
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from seismolake.functions import tails
from seismolake.functions import texts as T
from seismolake.operators import event_based as B
from seismolake.operators import schedule as S

DAY = 86_400_000_000
EVENTS = "t_us long, mag double, etype string, cell_ix long"


def toy(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(40 * DAY), rng.choice([None, 2.9, 3.0, 4.0]), rng.choice(["earthquake"] * 4 + ["quarry"]), rng.choice([-1, 0, 1, 2, 2, 2])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, EVENTS), spark.range(4).withColumnRenamed("id", "cell_ix")


def test_schedule_is_a_recomputation_from_scratch(spark):
    rows, events, cells = toy(spark)
    model, cuts = S.Smoothed(3.0, recent=0.4, fade_days=2.0), [10 * DAY, 21 * DAY]
    got = S.run_schedule(events, cells, model, 10 * DAY, 38 * DAY, 3 * DAY, 4 * DAY, spark.createDataFrame([(c,) for c in cuts], "c long").toDF("cutoff_us"), 36 * DAY).orderBy("issue_us").collect()
    assert [r.issue_us // DAY for r in got] == list(range(10, 35, 3))
    used = [(t, c) for t, m, e, c in rows if m is not None and m >= 3 and e == "earthquake" and c >= 0]
    t0 = min(r[0] for r in rows)
    for r in got:
        cut = max(c for c in cuts if c <= r.issue_us)
        n = sum(t < cut for t, _ in used)
        total = ll = 0.0
        for cell in range(4):
            own = sum(t < cut and c == cell for t, c in used)
            faded = sum(math.exp(-(r.issue_us - t) / (2 * DAY)) for t, c in used if c == cell and t < r.issue_us)
            rate = 4 * (0.6 * n / ((cut - t0) / DAY) * (own + 0.5) / (n + 2) + 0.2 * faded)
            k = sum(c == cell and r.issue_us <= t < r.end_us for t, c in used)
            total, ll = total + rate, ll + (k * math.log(rate) - math.lgamma(k + 1) if k else 0) - rate
        assert (r.fit_cutoff_us, r.n_train, r.total_expected) == (cut, n, pytest.approx(total))
        inside = [(m, e) for t, m, e, c in rows if c >= 0 and r.issue_us <= t < r.end_us]
        if r.end_us > 36 * DAY:
            assert r.not_scored and r.n_targets is None and r.delta1 is None and r.passed is None
        else:
            assert (r.n_targets, r.n_excluded_type, r.n_excluded_magnitude) == (sum(e == "earthquake" and m is not None and m >= 3 for m, e in inside), sum(e == "quarry" for _, e in inside), sum(e == "earthquake" and m is None for m, e in inside))
            assert r.log_likelihood == pytest.approx(ll) and r.not_scored is None
    assert len({r.snapshot for r in got}) == 2


def test_schedule_refuses_leaks_and_empty_plans(spark, monkeypatch):
    _, events, cells = toy(spark)
    cutoffs = spark.createDataFrame([(10 * DAY,)], "cutoff_us long")
    run = lambda: S.run_schedule(events, cells, S.Smoothed(3.0), 10 * DAY, 30 * DAY, 3 * DAY, 4 * DAY, cutoffs, 36 * DAY)
    held = S.refits
    monkeypatch.setattr(S, "refits", lambda *a: held(*a).withColumn("training_max_us", F.col("cutoff_us")))
    with pytest.raises(ValueError, match="cut-off"):
        run()
    monkeypatch.setattr(S, "refits", held)
    plan = S.last_cutoff
    monkeypatch.setattr(S, "refits", lambda *a: held(*a).unionByName(held(*a).withColumn("cutoff_us", F.lit(9 * DAY)).withColumn("training_max_us", F.lit(0)).withColumn("snapshot", F.lit("other"))))
    monkeypatch.setattr(S, "last_cutoff", lambda i, c: plan(i, c).withColumn("cutoff_us", F.when(F.col("issue_us") > 20 * DAY, F.lit(9 * DAY)).otherwise(F.col("cutoff_us"))))
    with pytest.raises(ValueError, match="without a refit"):
        run()
    with pytest.raises(ValueError, match="no window"):
        S.run_schedule(events, cells, S.Smoothed(3.0), 10 * DAY, 11 * DAY, DAY, 4 * DAY, cutoffs, 36 * DAY)


def test_hashes_of_parameters_and_doubles_as_python_writes_them(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, 0.1, -2.5, 1e-4, 9.99e-5, 1e-5, 1.5e-7, 123456.75, 1e7, 12345678.9, 1e15, 1e16, 1e22, 3e300, 1e-300, math.inf, -math.inf, 100.0] + [round(rng.uniform(-1, 1), 6) * 10.0 ** rng.randrange(-6, 9) for _ in range(300)]
    values = [v for v in values if repr(v) == repr(float(f"{v:.15g}"))]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    assert [r.s for r in df.select(T.float_repr(F.col("x")).alias("s")).collect()] == [repr(v) for v in values]
    params = {"b": 0.91, "a": -1.67, "n": 12, "name": "etas", "ok": True, "none": None}
    row = spark.range(1).select(T.snapshot_hash({k: F.lit(v) if v is not None else F.lit(None).cast("double") for k, v in params.items()}).alias("h")).first()
    assert row.h == hashlib.sha256("\n".join(f"{k}={params[k]!r}" for k in sorted(params)).encode()).hexdigest()


def test_times_are_utc_in_any_session_zone(spark):
    us = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp()) * 10**6
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kathmandu", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            texts = ["2024-01-01", "2024-01-01T00:00:00", "2024-01-01 00:00:00Z", "2024-01-01T05:45:00+05:45", "none"]
            got = [r.u for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.parse_utc(F.col("t")).alias("u")).collect()]
            assert got == [us] * 4 + [None], zone
            ids = spark.range(1).select(T.grid_id(F.lit("m"), F.lit("r"), F.lit(us), F.lit(86400)).alias("a"), T.utc_text(F.lit(us - 1)).alias("b")).first()
            assert (ids.a, ids.b) == ("m_r_20240101T000000Z_1d", "20231231T235959Z"), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_poisson_tails_of_any_size(spark):
    for n, rate in ((0, 0.5), (3, 2.0), (10, 30.0), (40, 30.0), (200, 180.0)):
        want = math.fsum(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(n + 1))
        assert tails._poisson_cdf(n, rate) == pytest.approx(want, rel=1e-10)
    assert tails._poisson_cdf(10**9, 1e9) == pytest.approx(0.5, abs=1e-4) and tails._poisson_cdf(-1, 3.0) == 0.0 and tails._poisson_cdf(5, 0.0) == 1.0


def test_fields_have_all_pairs_within_reach(spark):
    """An event 22 km from its site across 180 degrees, and one at 80 degrees north."""
    events = spark.createDataFrame([(1, 179.9, 0.0, 5.0, 6.0), (2, 12.0, 80.0, 5.0, 6.0), (3, 0.0, 89.9, 5.0, 6.0)], "event_id long, lon double, lat double, depth_km double, mag double")
    sites = spark.createDataFrame([(1, -179.9, 0.0), (2, 0.0, 80.0), (3, 180.0, 89.9)], "site_id long, s_lon double, s_lat double")
    got = {(r.event_id, r.site_id): r.hypocentral_km for r in B.fields(events, sites, lambda mag, km: -km / 100, 0.3, 0.5, 0.0, 1, 300.0).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)} and got[1, 1] == pytest.approx(math.hypot(22.24, 5), abs=0.1) and 220 < got[2, 2] < 240
