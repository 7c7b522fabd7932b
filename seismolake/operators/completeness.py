"""Completeness by goodness of fit at every cut-off, and as a field over a lattice. Both work on tables of counts by magnitude bin, whatever the number of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalogue as C

#: Magnitude bins are tenths.
WIDTH = 0.1
#: A cut-off passes from this probability on, among so many simulations.
P_PASS, SAMPLES = 0.1, 2000
#: Candidates reach up to this quantile of magnitudes.
HIGHEST = 0.9


def cut_offs(events: DataFrame) -> DataFrame:
    """cut_bin, n and beta of the magnitudes (mbin) from each candidate cut-off on: the bins from the least magnitude's to that of the 90 % quantile, by nearest rank.

    beta is the maximum likelihood rate of an exponential law that is binned: ln(1 + width / (mean - cut-off)) / width; null where all magnitudes are in one bin.
    """
    counts = C.magnitude_counts(events.filter(F.col("mbin").isNotNull()))
    down, up = Window.orderBy(F.desc("mbin")).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("mbin").rowsBetween(Window.unboundedPreceding, -1)
    tails = counts.select("mbin", F.sum("n").over(down).alias("n"), F.sum(F.col("n") * F.col("mbin")).over(down).alias("s"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all"))
    # every bin up to the quantile is a candidate, with or without events of its own
    low = tails.filter(F.col("below") <= F.ceil(F.col("all") * F.lit(HIGHEST)) - 1)
    previous = F.coalesce(F.lag("mbin").over(Window.orderBy("mbin")) + 1, F.col("mbin"))
    filled = low.withColumn("first", previous).withColumn("cut_bin", F.explode(F.sequence("first", "mbin")))
    above = (F.col("s") / F.col("n") - F.col("cut_bin")) * F.lit(WIDTH)
    return filled.select("cut_bin", "n", F.when(above > 0, F.log1p(F.lit(WIDTH) / above) / F.lit(WIDTH)).alias("beta"))


def ks_distances(events: DataFrame) -> DataFrame:
    """cut_offs with distance, the largest difference of the empirical distribution and the fitted one over bins: what of magnitudes is at or below each bin from the cut-off to the last that has events."""
    counts = C.magnitude_counts(events.filter(F.col("mbin").isNotNull())).select("mbin", F.col("n").alias("own"))
    running = counts.withColumn("upto", F.sum("own").over(Window.orderBy("mbin").rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("upto").over(Window.partitionBy())
    steps = running.select("mbin", (total - F.col("upto")).alias("above"), F.lead("mbin").over(Window.orderBy("mbin")).alias("next"))
    # between two bins that have events the fitted distribution rises and the empirical one stands, so the ends of each stretch are enough; below the first one the empirical one is 0
    ends = steps.select("above", F.explode(F.array("mbin", F.coalesce(F.col("next") - 1, F.col("mbin")))).alias("bin"))
    cuts = cut_offs(events)
    rows = cuts.join(ends, F.col("bin") >= F.col("cut_bin"))
    fitted = lambda b: F.lit(1.0) - F.exp(-F.col("beta") * F.lit(WIDTH) * (b - F.col("cut_bin") + 1))
    apart = F.abs(F.lit(1.0) - F.col("above") / F.col("n") - fitted(F.col("bin")))
    return rows.groupBy("cut_bin", "n", "beta").agg(F.max(apart).alias("distance"))


def simulated_distances(beta: float, n: int, samples: np.ndarray, cut_bin: int, seed: int) -> np.ndarray:
    """Distances of samples of n magnitudes of the fitted law. A sample is one multinomial draw over bins; the last one takes what is beyond a 10^-12th. Draws depend on the seed, the cut-off and the sample's number alone."""
    k = np.arange(max(2, int(np.ceil(27.6 / (beta * WIDTH)))))
    upto = -np.expm1(-beta * WIDTH * (k + 1))
    mass = np.diff(np.r_[0.0, upto[:-1], 1.0])
    out = np.empty(len(samples))
    for i, sample in enumerate(samples.tolist()):
        drawn = np.cumsum(np.random.default_rng([seed, cut_bin + 10_000, sample]).multinomial(n, mass)) / n
        last = int(np.searchsorted(drawn, 1.0 - 0.5 / n)) + 1
        out[i] = np.abs(drawn[:last] - upto[:last]).max()
    return out


def ks_probabilities(events: DataFrame, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """ks_distances with p, the part of simulated catalogues that are at least as far from the fitted law; null without beta. All cut-offs and samples are one job."""
    cuts = ks_distances(events)
    block = 250

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = [
                int((simulated_distances(r.beta, int(r.n), np.arange(r.first, min(samples, r.first + block)), int(r.cut_bin), seed) >= r.distance).sum()) for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame({"cut_bin": batch.cut_bin, "far": far})

    rows = cuts.filter("beta IS NOT NULL").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(block))))
    tasks = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.repartition(tasks, "cut_bin", "first").mapInPandas(run, "cut_bin long, far long").groupBy(F.col("cut_bin").alias("of")).agg((F.sum("far") / F.lit(float(samples))).alias("p"))
    return cuts.join(counted, F.col("cut_bin") == F.col("of"), "left").drop("of")


def ks_completeness(events: DataFrame, samples: int = SAMPLES, seed: int = 0, p_pass: float = P_PASS) -> DataFrame:
    """One row: mc, beta, n, distance and p of the least cut-off that passes; no row if none does."""
    passing = ks_probabilities(events, samples, seed).filter(F.col("p") >= p_pass)
    best = passing.agg(F.min(F.struct("cut_bin", "beta", "n", "distance", "p")).alias("b")).filter("b IS NOT NULL")
    return best.select(F.round(F.col("b.cut_bin") * F.lit(WIDTH), 2).alias("mc"), "b.beta", "b.n", "b.distance", "b.p")


def completeness_field(events: DataFrame, cells: DataFrame, least_events: int = 30, most_rings: int = 3, correction: float = 0.2) -> DataFrame:
    """cells (cell_ix, ix, iy, ...) with n_events, rings, n_used and mc by maximum curvature: from the events (cell_ix, mbin) of a cell and of the fewest rings of cells around it that hold enough together.

    Unknown (null) where even most_rings rings don't. Events are counted by cell and bin first, with partial counts before the shuffle, and cells add up counts, so no cell's events are ever together.
    """
    counts = events.filter(F.col("mbin").isNotNull()).groupBy("cell_ix", "mbin").agg(F.count("*").alias("n"))
    held = cells.select(F.col("cell_ix").alias("of"), F.col("ix").alias("x"), F.col("iy").alias("y")).join(counts, F.col("of") == F.col("cell_ix")).drop("cell_ix", "of")
    offsets = F.sequence(F.lit(-most_rings), F.lit(most_rings))
    around = held.withColumn("dx", F.explode(offsets)).withColumn("dy", F.explode(offsets))
    around = around.select((F.col("x") + F.col("dx")).alias("to_x"), (F.col("y") + F.col("dy")).alias("to_y"), F.greatest(F.abs("dx"), F.abs("dy")).alias("ring"), "mbin", "n")
    placed = cells.select("cell_ix", "ix", "iy").join(around, (F.col("ix") == F.col("to_x")) & (F.col("iy") == F.col("to_y"))).groupBy("cell_ix", "ring", "mbin").agg(F.sum("n").alias("n"))
    sums = placed.groupBy("cell_ix", "ring").agg(F.sum("n").alias("n"))
    within = F.sum("n").over(Window.partitionBy("cell_ix").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0))
    reached = sums.withColumn("within", within)
    enough = reached.filter(F.col("within") >= least_events).groupBy(F.col("cell_ix").alias("of")).agg(F.min(F.struct("ring", "within")).alias("r")).select("of", F.col("r.ring").alias("rings"), F.col("r.within").alias("n_used"))
    bins = placed.join(enough, F.col("cell_ix") == F.col("of")).filter(F.col("ring") <= F.col("rings")).groupBy("cell_ix", "rings", "n_used", "mbin").agg(F.sum("n").alias("n"))
    top = bins.groupBy(F.col("cell_ix").alias("of"), "rings", "n_used").agg(F.max(F.struct("n", (-F.col("mbin")).alias("low"))).alias("top"))
    top = top.select("of", "rings", "n_used", F.round(-F.col("top.low") * F.lit(WIDTH) + F.lit(correction), 2).alias("mc"))
    own = counts.groupBy(F.col("cell_ix").alias("own_cell")).agg(F.sum("n").alias("n_events"))
    out = cells.join(own, F.col("cell_ix") == F.col("own_cell"), "left").join(top, F.col("cell_ix") == F.col("of"), "left")
    return out.select(*cells.columns, F.coalesce("n_events", F.lit(0)).alias("n_events"), "rings", "n_used", "mc")
