"""What grows with the events no faster than they do: draws, rates, states and inversions of the third review's findings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismolake.functions import ground as D
from seismolake.operators import consistency as N
from seismolake.operators import models as M
from seismolake.operators import power as W
from seismolake.operators import stochastic as T
from seismolake.streaming import posterior as P


def test_draws_of_few_simulations_are_dealt_out(spark, monkeypatch):
    """one simulation's numbers are made by several tasks."""
    monkeypatch.setattr(N, "PIECE", 10)
    rows = N.numbered(spark.createDataFrame([(0, 1003), (1, 0), (2, 10)], "simulation long, n_events long")).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.simulation, r.k) for r in rows) == [(0, k) for k in range(1, 1004)] + [(2, k) for k in range(1, 11)]
    assert len({r.task for r in rows if r.simulation == 0}) > 1


def test_dense_rates_are_summed_without_pairs(spark, monkeypatch):
    """bursts within a cell, equal times, gaps; the fit sums rates once."""
    rng = random.Random(4)
    times = [rng.randrange(30_000_000) for _ in range(150)] + [77] * 20 + [rng.randrange(3 * 86_400_000_000) for _ in range(200)] + [rng.randrange(5_000_000_000) for _ in range(150)]
    rows = [(i, t, 4 + rng.expovariate(2)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, mag double")
    got = {r.event_id: r.triggered for r in M.etas_triggered(df, 1.2, 0.01, 1.1, 4.0).collect()}
    want = {i: sum(math.exp(1.2 * (m - 4)) * ((t - s) / 8.64e10 + 0.01) ** -1.1 for _, s, m in rows if s < t) for i, t, _ in rows}
    assert got == {i: pytest.approx(v, rel=1e-11) for i, v in want.items()}
    kept, held = [], M.written
    monkeypatch.setattr(M, "written", lambda d, name: kept.append(name) or held(d, name))
    M.etas_expectation_maximisation(df, 4 * 86_400_000_000, 4.0, 20.0, 0.02, 1.2, 0.01, 1.1, 4.0, 3).collect()
    assert kept == ["triggered"]


def test_a_sequences_parts_are_its_whole(spark, tmp_path):
    """the state is held by parts of a sequence's events, revisions among them."""
    day, rng = P.DAY_US, random.Random(2)
    rows = [("s", 10 * day, 6.0, str(k), 10 * day + int(rng.random() * 4 * day), rng.choice([3.0, 4.0]), v) for k in range(300) for v in range(rng.choice([1, 2]))] + [("end", 60 * day, 5.0, "x", 60 * day, 3.0, 0)]
    df = spark.createDataFrame(rows, "sequence string, main_us long, main_mag double, event_id string, t_us long, mag double, version long").withColumn("ts", F.timestamp_micros("t_us"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, law, delays = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), P.Law(), [1.0, 3.0]
    counted = P.online_counts(stream, "ts", "0 seconds", law, delays, 7)
    counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    parts = spark.read.schema(P.COUNTED).parquet(str(tmp_path / "out"))
    assert parts.count() == 14
    want = {(r.sequence, r.issue_us): tuple(r)[2:] for r in P.in_batch(df, law, delays).filter("sequence = 's'").collect()}
    assert {(r.sequence, r.issue_us): tuple(r)[2:] for r in P.issued(P.summed(parts), law).collect()} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_cascades_start_in_several_tasks(spark):
    """also from a table of one file; counts are those of inversion by every term."""
    parents = spark.range(200).coalesce(1).select(F.col("id").alias("event_id"), F.lit(0.0).alias("t_days"), F.lit(5.0).alias("mag"))
    born = T.cascade(spark, parents, 3, 0.02, 1.0, 0.01, 1.2, 1.0, 4.0, 30.0, 1, 9).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in born}) > 1
    rows = spark.range(2000).select(T.uniform(1, "id").alias("u"), (F.col("id") % 40 / 2.0).alias("rate")).withColumn("n", T.piece_count(F.col("rate"), F.col("u"))).collect()
    for r in rows:
        n, p, cdf = 0, math.exp(-r.rate), math.exp(-r.rate)
        while r.u > cdf and n < T.MOST:
            n += 1
            p *= r.rate / n
            cdf += p
        assert r.n == n


def test_inverse_coverage_is_one_expression(spark):
    """F16: no halving by row."""
    p = F.col("id") / 1000.0
    df = spark.range(1001).select(p.alias("p"), D.landslide_probability_of(D.landslide_coverage_of(p)).alias("back"))
    assert all(r.back == pytest.approx(r.p, abs=1e-12) for r in df.collect() if 0 < r.p < 1)
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.range(1).select(D.landslide_probability_of(F.lit(0.9))).first()[0] is None


def test_effects_of_very_many_events(spark):
    """no points are listed, so a simulation of thousands of millions is one of a few numbers."""
    f = W.Forecast(np.arange(4), np.zeros(4), np.full(4, 1e7))
    got = W.minimum_detectable_effect(spark, f, "N", f.multiplied, 1.0, 100.0, simulations=200, seed=3, tolerance=1e-5)
    assert got == pytest.approx(1 + 2.8 / math.sqrt(4e7), abs=1e-4)
