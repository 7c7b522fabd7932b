"""What consistency tests can see: the least departure that a test would reject with a wanted power, and the events that it would need.

All candidates of a search share one set of draws. A simulation draws, for each bin, one Poisson process up to the largest of the candidates' rates; a candidate's catalogue are the points below its own
rate, which is a Poisson catalogue of these rates, and the larger the rate the more of the same points it has. Only the counts between neighbouring candidates' rates are drawn, which are independent and Poisson, and no points are listed: a
simulation holds a number for each bin and candidate, however many events there are. So neighbouring candidates differ by their departure and not by luck, and a whole round of candidates is one job, with
the simulations spread over tasks. Draws depend on the seed and the simulation's number alone. A forecast's bins, which a lattice bounds, are the one thing that each task holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TESTS = ("N", "L", "CL", "S", "M")
#: Bins of a forecast at most.
MOST_BINS = 1_000_000
#: Candidates of a round.
CANDIDATES = 8


class Forecast:
    """Rates of bins by cell and magnitude."""

    def __init__(self, cells: np.ndarray, m_bins: np.ndarray, rates: np.ndarray):
        if len(rates) > MOST_BINS:
            raise ValueError("a forecast has too many bins")
        if not (np.isfinite(rates).all() and (rates > 0).all() and len(rates)):
            raise ValueError("a forecast needs positive rates")
        self.cells, self.m_bins, self.rates = np.unique(cells, return_inverse=True)[1], np.unique(m_bins, return_inverse=True)[1], np.asarray(rates, float)

    @classmethod
    def of(cls, bins: DataFrame) -> Forecast:
        """From bins (cell_ix, m_bin, rate)."""
        if bins.count() > MOST_BINS:
            raise ValueError("a forecast has too many bins")
        rows = bins.select("cell_ix", "m_bin", "rate").orderBy("cell_ix", "m_bin").toPandas()
        return cls(rows.cell_ix.to_numpy(), rows.m_bin.to_numpy(), rows.rate.to_numpy(float))

    def multiplied(self, factor: float) -> np.ndarray:
        return self.rates * factor

    def concentrated(self, power: float) -> np.ndarray:
        """Shares of cells raised to a power and normalised; a cell's magnitudes keep their shares."""
        share = np.bincount(self.cells, self.rates) / self.rates.sum()
        raised = share**power / (share**power).sum()
        return self.rates * (raised / share)[self.cells]


def statistic(test: str, forecast: Forecast, rates: np.ndarray, counts: np.ndarray) -> float:
    """N: the number of events. L: the joint Poisson log likelihood under rates; CL, S and M: under rates scaled to the count, S and M of the marginals by cell and by magnitude."""
    n = counts.sum()
    if test == "N":
        return float(n)
    if test == "S":
        rates, counts = np.bincount(forecast.cells, rates), np.bincount(forecast.cells, counts)
    elif test == "M":
        rates, counts = np.bincount(forecast.m_bins, rates), np.bincount(forecast.m_bins, counts)
    if test != "L":
        rates = rates * (n / rates.sum())
    counts = counts.astype(np.int64)
    held = counts > 0
    counts, rates, total = counts[held], rates[held], rates.sum()
    values, at = np.unique(counts, return_inverse=True)
    logs = np.array([math.lgamma(c + 1.0) for c in values.tolist()])
    return float((counts * np.log(rates) - logs[at]).sum() - total)


def simulated(spark: SparkSession, forecast: Forecast, test: str, drawn: list[np.ndarray], judged: list[np.ndarray], simulations: int, seed: int) -> DataFrame:
    """candidate, simulation and statistic: catalogues of the rates drawn[candidate], all from the same draws, judged under judged[candidate]."""
    order = np.argsort(drawn, axis=0, kind="stable")
    between = np.diff(np.take_along_axis(np.asarray(drawn), order, axis=0), axis=0, prepend=0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s in batch.id.tolist():
                rng = np.random.default_rng([seed, s])
                counts = np.empty(order.shape, np.int64)
                np.put_along_axis(counts, order, np.cumsum(rng.poisson(between), axis=0), axis=0)
                for k, under in enumerate(judged):
                    out.append((k, s, statistic(test, forecast, under, counts[k])))
            yield pd.DataFrame(out, columns=["candidate", "simulation", "statistic"])

    tasks = max(1, min(simulations, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(simulations).repartition(tasks, "id").mapInPandas(run, "candidate int, simulation long, statistic double")


def powers(rows: DataFrame, test: str, nulls: dict[int, int], simulations: int, alpha: float) -> dict[int, float | None]:
    """Of simulated rows, the share of each candidate's catalogues in the rejection region of its null (nulls: candidate -> null's number); None where the null has no region.

    A region are the statistics at or below the largest null one that at most the tail's share doesn't exceed, and for N, with half of alpha for each side, also those above alike: nothing is interpolated.
    """
    tail = alpha / 2 if test == "N" else alpha
    ranked = rows.filter(F.col("candidate").isin(*set(nulls.values()))).groupBy("candidate", "statistic").agg(F.count("*").alias("n"))
    held = ranked.toPandas().sort_values("statistic")  # at most a value for each simulation and null
    bounds = {}
    for null, part in held.groupby("candidate"):
        values, below = part.statistic.to_numpy(), np.cumsum(part.n.to_numpy())
        low = values[below <= tail * simulations + 1e-9]
        above = values[(simulations - below + part.n.to_numpy()) <= tail * simulations + 1e-9]
        bounds[null] = (low.max() if len(low) else None, above.min() if test == "N" and len(above) else None)
    spark, kinds = rows.sparkSession, "of int, low double, high double"
    table = F.broadcast(spark.createDataFrame([(k, *(None if b is None else float(b) for b in bounds[n])) for k, n in nulls.items()], kinds))
    hit = F.coalesce(F.col("statistic") <= F.col("low"), F.lit(False)) | F.coalesce(F.col("statistic") >= F.col("high"), F.lit(False))
    found = rows.join(table, F.col("candidate") == F.col("of")).groupBy("candidate").agg(F.avg(hit.cast("double")).alias("power")).collect()
    return {r.candidate: r.power if any(b is not None for b in bounds[nulls[r.candidate]]) else None for r in found}


def minimum_detectable_effect(
    spark: SparkSession, forecast: Forecast, test: str, family: Callable[[float], np.ndarray], null: float, extreme: float, alpha: float = 0.05, power: float = 0.8, simulations: int = 2000, seed: int = 0, tolerance: float = 0.02
) -> float | None:
    """The parameter nearest to `null` that the test rejects with the power wanted, to a relative tolerance; None where even the extreme one isn't, or the test has no rejection region.

    Rounds of candidates with equal ratios: the first that reaches the power and the one before it are the next round's ends. Power is taken to grow with the distance from the null. Simulations are the same in every round.
    """
    if test not in TESTS or not alpha < power < 1 or null <= 0 or extreme <= 0:
        raise ValueError("a known test, a power between alpha and 1, and positive parameters are needed")
    low, high, known = float(null), float(extreme), False
    while True:
        n = CANDIDATES
        tried = [low * (high / low) ** (k / n) for k in range(1, n + 1)]
        drawn = [forecast.rates, *(np.asarray(family(p), float) for p in tried)]
        got = powers(simulated(spark, forecast, test, drawn, [forecast.rates] * len(drawn), simulations, seed), test, {k: 0 for k in range(1, n + 1)}, simulations, alpha)
        if got[1] is None or not known and got[n] < power:
            return None
        first = next((k for k in range(1, n + 1) if got[k] >= power), n)
        low, high, known = ([float(low), *tried])[first - 1], tried[first - 1], True
        if abs(np.log(high / low)) <= np.log1p(tolerance):
            return high


def events_needed(
    spark: SparkSession, forecast: Forecast, test: str, family: Callable[[Forecast], np.ndarray], alpha: float = 0.05, power: float = 0.8, simulations: int = 500, seed: int = 0, tolerance: float = 0.1, most: float = 1e5
) -> float | None:
    """The expected events at which the test first rejects the departure with the power wanted, the forecast's shape held; None where `most` don't do. Nulls are simulated anew for each total, from the same draws."""
    shape, low, high = forecast.rates / forecast.rates.sum(), None, min(10.0, most)

    def power_at(totals: list[float]) -> list[float]:
        drawn, judged, nulls = [], [], {}
        for total in totals:
            scaled = Forecast(forecast.cells, forecast.m_bins, shape * total)
            nulls[len(drawn) + 1] = len(drawn)
            drawn += [scaled.rates, np.asarray(family(scaled), float)]
            judged += [scaled.rates] * 2
        got = powers(simulated(spark, forecast, test, drawn, judged, simulations, seed), test, nulls, simulations, alpha)
        return [got[2 * k + 1] or 0.0 for k in range(len(totals))]

    while power_at([high])[0] < power:
        if high >= most:
            return None
        low, high = high, min(most, high * 4)
    low = high / 10 if low is None else low
    while np.log(high / low) > np.log1p(tolerance):
        tried = [low * (high / low) ** (k / CANDIDATES) for k in range(1, CANDIDATES + 1)]
        got = power_at(tried)
        first = next((k for k, p in enumerate(got) if p >= power), CANDIDATES - 1)
        low, high = ([low, *tried])[first], tried[first]
    return high
