"""Models, draws, tails and streams of the catalogue engine by their identities."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from seismolake.functions import projection as P
from seismolake.functions import seismology as S
from seismolake.functions import tails
from seismolake.operators import models as M
from seismolake.operators import stochastic as T
from seismolake.streaming import feed


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(84.0, 28.0), (85.5, 27.1), (80.0, 30.0)], "lon double, lat double")
    x, y = P.forward(F.col("lon"), F.col("lat"), 84.0, 28.0)
    lon, lat = P.inverse(F.col("x"), F.col("y"), 84.0, 28.0)
    for r in df.withColumn("x", x).withColumn("y", y).withColumn("lon2", lon).withColumn("lat2", lat).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    assert [r[0] for r in spark.createDataFrame([("30d",), ("12h",), ("1y",), ("x",)], "t string").select(P.horizon_seconds(F.col("t"))).collect()] == [2592000, 43200, 31536000, None]


def test_tails(spark):
    df = spark.createDataFrame([(3, 2.5, 10, 0.2)], "n int, rate double, total int, p double")
    r = df.select(tails.poisson_cdf(F.col("n"), F.col("rate")).alias("a"), tails.binomial_sf(F.col("n"), F.col("total"), F.col("p")).alias("b")).first()
    assert abs(r.a - math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2 + 2.5**3 / 6)) < 1e-12
    assert abs(r.b - (1 - sum(math.comb(10, k) * 0.2**k * 0.8 ** (10 - k) for k in range(3)))) < 1e-12
    assert tails.critical_hits(2, 0.5, 0.01) is None and tails.critical_hits(10, 0.1, 0.05) == 4
    n = tails.events_needed(0.1, 3.0, 0.05, 0.8)
    assert tails.power_at_gain(n, 0.1, 3.0, 0.05) >= 0.8
    x = [r[0] for r in spark.createDataFrame([(v,) for v in (-2.0, 0.0, 1.96)], "x double").select(S.normal_cdf(F.col("x"))).collect()]
    assert all(abs(a - 0.5 * (1 + math.erf(v / math.sqrt(2)))) < 1e-7 for a, v in zip(x, (-2.0, 0.0, 1.96), strict=True))


def test_posterior_moves_towards_what_was_seen(spark):
    prior = M.productivity_prior(spark, -1.67, 0.5)
    assert abs(prior.agg(F.sum("p")).first()[0] - 1) < 1e-9
    mean = lambda d: d.agg(F.sum(F.col("a") * F.col("p"))).first()[0]
    assert mean(M.productivity_posterior(prior, 100, 40.0)) > mean(prior) > mean(M.productivity_posterior(prior, 0, 400.0))


def test_number_test():
    assert M.number_test(10, 10.0)["passed"] and not M.number_test(30, 10.0)["passed"] and not M.number_test(0, 10.0)["passed"]


def test_draws_have_their_moments_and_do_not_depend_on_partitions(spark):
    df = spark.range(20000).select("id", T.poisson(F.lit(1.5), T.uniform(3, "id")).alias("n"), T.truncated_magnitude(F.lit(4.0), F.lit(7.0), 1.0, T.uniform(4, "id")).alias("m"))
    r = df.agg(F.avg("n"), F.var_samp("n"), F.min("m"), F.max("m"), F.avg("m")).first()
    assert abs(r[0] - 1.5) < 0.04 and abs(r[1] - 1.5) < 0.06 and 4 <= r[2] and r[3] <= 7 and abs(r[4] - 4.43) < 0.02
    again = spark.range(20000).repartition(7).select("id", T.poisson(F.lit(1.5), T.uniform(3, "id")).alias("n"))
    assert df.select("id", "n").exceptAll(again).count() == 0


def test_cascades_stay_subcritical_and_in_the_window(spark):
    parents = spark.createDataFrame([(1, 0.0, 6.0)], "event_id long, t_days double, mag double")
    out = T.cascade(spark, parents, 20, 0.02, 1.0, 0.01, 1.2, 1.0, 4.0, 30.0, 3, 9)
    r = out.agg(F.min("t_days"), F.max("t_days"), F.min("mag"), F.count("*")).first()
    assert r[0] >= 0 and r[1] < 30 and r[2] >= 4 and r[3] > 0


def test_ground_motions(spark):
    events = spark.createDataFrame([(1,)], "event_id long")
    sites = spark.range(2000).select(F.lit(1).cast("long").alias("event_id"), F.col("id").alias("site_id"), F.lit(-1.0).alias("mean_ln"))
    assert {round(r.im, 9) for r in T.ground_motions(events, sites, 1, 0.3, 0.5, 3.0, 1).collect()} == {round(math.exp(-1), 9)}
    r = T.ground_motions(events, sites, 20, 0.3, 0.5, 3.0, 1).agg(F.avg(F.log("im")), F.stddev(F.log("im"))).first()
    assert abs(r[0] + 1) < 0.2 and 0.45 < r[1] < 0.75


def test_regressions(spark):
    cells = spark.range(400).select((F.col("id") % 20 / 10.0).alias("x"), F.col("id"))
    cells = cells.withColumn("y", (F.col("x") + T.uniform(1, "id") > 1.4).cast("double")).withColumn("n", T.poisson(F.exp(F.col("x")), T.uniform(2, "id")).cast("double"))
    assert M.fit_occupancy(cells, ["x"], "y").coefficients[0] > 1
    assert abs(M.fit_rates(cells, ["x"], "n").coefficients[0] - 1) < 0.2
    with pytest.raises(ValueError, match="alike"):
        M.fit_occupancy(cells.withColumn("y", F.lit(1.0)), ["x"], "y")


def test_upsert_and_sessions(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    schema = "id string, ts timestamp, version long, value double, lane string"
    spark.createDataFrame([("a", t, 1, 1.0, "x"), ("b", t + datetime.timedelta(seconds=10), 1, 2.0, "x")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", t, 2, 9.0, "x"), ("c", t + datetime.timedelta(seconds=200), 1, 3.0, "x")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feed.read_feed(spark, str(tmp_path / "in"), schema)
    q = stream.writeStream.foreachBatch(feed.upsert_latest("id", "version", str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.value) for r in spark.read.parquet(str(tmp_path / "t" / "1")).collect()} == {("a", 9.0), ("b", 2.0), ("c", 3.0)}
    blocks = feed.session_blocks(spark.read.parquet(str(tmp_path / "in")), "ts", "16 seconds", "1 minute", "lane").collect()
    assert sorted(r.n for r in blocks) == [1, 3]


def test_upserts_survive_gaps_in_epochs(spark, tmp_path):
    schema, path = "id string, version long, value double", str(tmp_path / "t")
    run = feed.upsert_latest("id", "version", path)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    run(batch(("a", 1, 1.0), ("b", 1, 1.0)), 0)
    run(batch(("a", 2, 2.0)), 4)
    (tmp_path / "t" / "5").mkdir()  # begun, never finished
    for _ in range(2):
        run(batch(("c", 1, 3.0), ("a", 1, 9.0)), 7)
    assert {(r.id, r.value) for r in spark.read.parquet(f"{path}/7").collect()} == {("a", 2.0), ("b", 1.0), ("c", 3.0)}


def test_etas_takes_all_earlier_sources(spark):
    day = 86_400_000_000
    rows = [(i, i * i * 30_000_000_000 % (30 * day), 4.0 + i * 7 % 20 / 10) for i in range(150)]
    r = M.etas_log_likelihood(spark.createDataFrame(rows, "event_id long, t_us long, mag double"), 30 * day, 30.0, 20.0, 0.02, 1.2, 0.01, 1.1, 4.0).first()
    part = lambda t, s, m: 0.02 * math.exp(1.2 * (m - 4)) * ((t - s) / day + 0.01) ** -1.1
    logs = sum(math.log(20 + sum(part(t, s, m) for _, s, m in rows if s < t)) for _, t, _ in rows)
    mass = sum(0.02 * math.exp(1.2 * (m - 4)) * (((30 * day - s) / day + 0.01) ** -0.1 - 0.01**-0.1) / -0.1 for _, s, m in rows)
    assert abs(r.log_rates - logs) < 1e-8 and abs(r.integral - 600 - mass) < 1e-8 and r.n == 150


def test_counts_of_large_rates_are_not_cut_off(spark):
    df = spark.range(4000).select("id", T.poisson(F.lit(150.0), T.uniform(3, "id")).alias("n"))
    r = df.agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(r[0] - 150) < 1 and abs(r[1] - 150) < 15
    grid = spark.createDataFrame([(0, 80.0, 26.0, 4.5, 150.0)], "cell_ix long, lon0 double, lat0 double, m0 double, rate double")
    rows = T.event_set(grid, 100, 1.0, 0.9, 0.5, 3.0, 11)
    assert abs(rows.count() / 100 - 150) < 6 and rows.select("catalogue", "cell_ix", "k").distinct().count() == rows.count()


def test_cascades_go_on_until_none_is_born(spark):
    parents = spark.createDataFrame([(1, 0.0, 9.5)], "event_id long, t_days double, mag double")
    out = T.cascade(spark, parents, 100, 0.02, 1.0, 0.01, 1.2, 1.0, 4.0, 1e12, None, 9)
    sizes = {r.generation: r["count"] for r in out.groupBy("generation").count().collect()}
    assert max(sizes) > 5 and abs(sizes[1] / 100 / (0.02 * math.exp(5.5) * 0.01**-0.2 / 0.2) - 1) < 0.1
    with pytest.raises(ValueError, match="branching ratio"):
        T.cascade(spark, parents, 1, 0.2, 1.0, 0.01, 1.2, 1.0, 4.0, 30.0, None, 9)


def test_avoided_losses_are_not_negative_by_rounding(spark):
    """Losses that no order of rows sums alike: with none avoided the difference is exactly 0, with some avoided it isn't below. The query takes both from one sum."""
    from seismolake import catalogue_queries as Q
    from seismolake import risk_queries  # noqa: F401 - adds to the table
    from seismolake.operators import event_based as B
    from seismolake.operators import risk as R

    rows = [(i, 10.0 ** (i % 17 - 8) / 3, 10.0 ** (i % 17 - 8) / 3 * (0.6 if i % 4 == 0 and i % 10 == 0 else 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, loss double, other double")
    of = df.select("event_id", (F.col("event_id") % 10).alias("catalogue"))
    years = spark.range(11).withColumnRenamed("id", "catalogue")
    for parts in (1, 3, 7):
        got = {r.catalogue: r.loss - r.other for r in B.annual_branches(df.repartition(parts), of, years, 2.0).collect()}
        assert len(got) == 11 and got[0] > 0 and all(got[k] == 0 for k in range(1, 11))
    assert R.differences(B.annual_branches(df, of, years, 2.0)).first().negative_share == 0
    assert Q.QUERIES["avoided_loss"](spark, "/root/testdata/sf0.001").first().negative_share == 0
