"""Inversion of the space-time model of self-exciting seismicity by expectation and maximisation.

The rate at (t, x, y) is mu plus, for every earlier source of magnitude m at a distance r and a delay s,

    k0 exp(a (m - mc)) exp(-s / tau) (s + c)^-(1 + omega) (r^2 + d exp(gamma (m - mc)))^-(1 + rho)

in events a day and square kilometre. Sources act within a reach that grows with the size of their fault.

The inversion keeps blocks of targets with the sources that may reach them (`block_table`), which grow as the events do, and makes their pairs anew, piece by piece, in each expectation.
`pair_table` finds the pairs once, in a distributed join, and compresses them, for catalogues whose pairs can be kept: of a target, sources of one magnitude class in one cell of delay and one of distance (cells of equal ratios) are one entry
with their number and means. A target's entries are one row, so an expectation is a narrow pass over the table that hands on sums: by cells of delay, and by magnitude and cells of distance. The kernel's logarithm is a sum
of a part of the delay and a part of magnitude and distance, so these sums are all that the maximisation needs, however long the catalogue is. What sources should trigger is likewise summed by
magnitude and by cells of the time they have had. The likelihood of the catalogue can't fall from one iteration to the next, but for what the cells round off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import seismology as S
from ..plans import nearby
from ..plans.shared import written

#: The parameters' names, usual starting values, and bounds.
NAMES = ("log10_mu", "log10_k0", "a", "log10_c", "omega", "log10_tau", "log10_d", "gamma", "rho")
START = {"log10_mu": -6.0, "log10_k0": -2.5, "a": 1.8, "log10_c": -2.5, "omega": -0.02, "log10_tau": 3.5, "log10_d": -0.5, "gamma": 1.2, "rho": 0.6}
BOUNDS = {"log10_mu": (-10, 0), "log10_k0": (-4, 0), "a": (0.01, 5), "log10_c": (-8, 0), "omega": (-0.99, 1), "log10_tau": (0.01, 12.26), "log10_d": (-4, 3), "gamma": (0.01, 5), "rho": (0.01, 5)}
#: Cells to each doubling of a delay and of a squared distance, and where they begin: days and square kilometres below which all is one cell.
FINENESS, LEAST_DAYS, LEAST_KM2 = 16, 1e-5, 1e-3
#: Blocks of targets, km, and how many targets one has at most, about; degrees of a block's spots, whose targets look at the same sources; pairs that are looked at together.
BLOCK_KM, BLOCK_TARGETS, SPOT_DEGREES, PIECE = 64.0, 20_000, 0.15, 500_000
#: Cells of distance are fewer than two to this.
CELL_BITS = 10
#: A source acts within so many lengths of its fault.
FAULT_LENGTHS = 100.0
#: Half a great circle, km.
ALL_KM = math.pi * S.EARTH_KM
TOLERANCE, MOST_ITERATIONS = 1e-3, 200
DAY_US = 8.64e10
NODES, WEIGHTS = np.polynomial.legendre.leggauss(64)


def cell_of(x: Column, least: float) -> Column:
    """Number of the cell of a positive number; 0 below the least."""
    return F.floor(F.greatest(F.lit(0.0), F.log2(x / F.lit(least))) * F.lit(float(FINENESS))).cast("int")


def targets_of(events: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return events.filter(F.col("t_us").between(start_us, end_us - 1)).select("event_id", "t_us", "lon", "lat")


def source_pairs(events: DataFrame, start_us: int, end_us: int, most_km: float, lengths: float) -> DataFrame:
    """event_id of a target, and m, days and km2 of a strictly earlier source that reaches it."""
    sources = events.filter(F.col("t_us") < end_us).select("event_id", "t_us", "lon", "lat", "mag")
    reach = F.least(F.lit(most_km), F.lit(lengths) * kernels.fault_length_km(F.col("mag")))
    met = nearby.pairs_within(targets_of(events, start_us, end_us), sources, reach, most_km, F.col("t_us_r") < F.col("t_us_l"))
    days, km2 = (F.col("t_us_l") - F.col("t_us_r")) / F.lit(DAY_US), F.col("km") * F.col("km")
    return met.select(F.col("event_id_l").alias("event_id"), F.col("mag_r").alias("m"), days.alias("days"), km2.alias("km2"))


def summed_rates(events: DataFrame, theta: dict[str, float], mc: float, start_us: int, end_us: int, most_km: float = 2000.0, lengths: float = FAULT_LENGTHS) -> DataFrame:
    """event_id, rate and background of each target, as `expectation` of all pairs has them. Pairs are summed in pieces where a block's targets meet its sources, so nothing is kept that grows as the pairs do."""
    blocks = written(block_table(events, start_us, end_us, most_km, lengths), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = (batch.column(k).offsets.to_numpy() for k in (0, 1))
            for i in range(batch.num_rows):
                ids, g = triggered(batch.column(0).values.slice(at[i], at[i + 1] - at[i]), batch.column(1).values.slice(ends[i], ends[i + 1] - ends[i]), theta, mc)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(g)], names=["of", "g"])

    held = blocks.mapInArrow(run, "of long, g double").groupBy("of").agg(F.sum("g").alias("g"))
    mu = F.lit(10 ** theta["log10_mu"])
    rate = mu + F.coalesce("g", F.lit(0.0))
    return targets_of(events, start_us, end_us).join(held, F.col("event_id") == F.col("of"), "left").select("event_id", rate.alias("rate"), (mu / rate).alias("background"))


def triggered(targets: pa.StructArray, sources: pa.StructArray, theta: dict[str, float], mc: float) -> tuple[np.ndarray, np.ndarray]:
    """A block's targets and their triggered rates. Distances and what depends on them and the magnitude are found once for a source and a place of targets; a pair adds its delay's part."""
    t, lon, lat, ids = (targets.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    s, x, y, m, reach = (sources.field(k).to_numpy(zero_copy_only=False) for k in range(5))
    order = np.argsort(s, kind="stable")
    s, x, y, m, reach = s[order], np.radians(x[order]), np.radians(y[order]), m[order] - mc, reach[order]
    c, tau, d = (10 ** theta[f"log10_{name}"] for name in ("c", "tau", "d"))
    size, wide, level = math.log(10) * theta["log10_k0"] + theta["a"] * m, d * np.exp(theta["gamma"] * m), np.cos(y)
    out = np.zeros(len(t))

    def aged(times: np.ndarray, began: np.ndarray) -> np.ndarray:
        days = (times[:, None] - began[None, :]) / DAY_US
        logs = np.log(days + c)
        logs *= -(1 + theta["omega"])
        logs -= days / tau
        return np.exp(logs, out=logs)

    by_place = np.lexsort((t, lat, lon))
    for spot in np.split(by_place, np.flatnonzero((np.diff(lon[by_place]) != 0) | (np.diff(lat[by_place]) != 0)) + 1):
        n = int(np.searchsorted(s, t[spot[-1]], "left"))
        u, v = np.radians(lon[spot[0]]), np.radians(lat[spot[0]])
        h = np.sin((y[:n] - v) / 2) ** 2 + np.cos(v) * level[:n] * np.sin((x[:n] - u) / 2) ** 2
        km = 2 * S.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        here = np.flatnonzero(km <= reach[:n])
        part = np.exp(size[here] - (1 + theta["rho"]) * np.log(km[here] ** 2 + wide[here]))
        began, k = s[here], 0
        while k < len(spot):
            # a piece of targets, and of the sources before the first of them; those between its first and last are few
            some = spot[k : k + max(1, PIECE // 4 // max(1, len(here)))]
            k += len(some)
            first, last = (int(np.searchsorted(began, t[e], "left")) for e in (some[0], some[-1]))
            for low in range(0, first, PIECE // 4):
                high = min(first, low + PIECE // 4)
                out[some] += aged(t[some], began[low:high]) @ part[low:high]
            for e in some[np.searchsorted(began, t[some], "left") > first]:
                to = int(np.searchsorted(began[:last], t[e], "left"))
                out[e] += (aged(t[[e]], began[first:to]) @ part[first:to])[0]
    return ids, out


def ratio_cell(x: np.ndarray, least: float) -> np.ndarray:
    """`cell_of` for arrays."""
    return np.floor(np.maximum(0.0, np.log2(np.maximum(x, least) / least)) * FINENESS)


def pair_table(events: DataFrame, start_us: int, end_us: int, most_km: float = 2000.0, compressed: bool = True, lengths: float = FAULT_LENGTHS) -> DataFrame:
    """A row for each target of events (event_id, t_us, lon, lat, mag), those in [start, end): its entries (m, days, km2, n) of strictly earlier sources that reach it. A reach is most_km at most.

    Without compression each source is an entry. The number of entries is bounded by the number of cells, not by the events.
    """
    targets, pairs = targets_of(events, start_us, end_us), source_pairs(events, start_us, end_us, most_km, lengths)
    cells = [F.floor(F.col("m") * 10 + 0.5 + 1e-9).cast("int").alias("m_cell"), cell_of(F.col("days"), LEAST_DAYS).alias("t_cell"), cell_of(F.col("km2"), LEAST_KM2).alias("r_cell")]
    if compressed:
        entries = pairs.groupBy("event_id", *cells).agg(F.avg("m").alias("m"), F.avg("days").alias("days"), F.avg("km2").alias("km2"), F.count("*").cast("double").alias("n"))
    else:
        entries = pairs.withColumn("n", F.lit(1.0))
    held = entries.groupBy("event_id").agg(F.collect_list(F.struct("m", "days", "km2", "n")).alias("entries"))
    return targets.select("event_id").join(held, "event_id", "left").withColumn("entries", F.coalesce("entries", F.expr("array()").cast(held.schema["entries"].dataType)))


def block_table(events: DataFrame, start_us: int, end_us: int, most_km: float = ALL_KM, lengths: float = FAULT_LENGTHS) -> DataFrame:
    """A row for each block of targets: targets (t_us, lon, lat, event_id) and sources (t_us, lon, lat, m, reach), all those before the end that may reach the block. Each target is in one block.
    Sources reach as far as their faults say, unless most_km bounds them; nothing is farther away than ALL_KM.

    Blocks are cells of BLOCK_KM; those with very many targets are dealt by a hash. So the table grows as the events do, not as their pairs, which are made anew by each expectation.
    """
    size = F.lit(BLOCK_KM)
    row = nearby.rows_of(size, F.col("lat"))
    targets = targets_of(events, start_us, end_us).filter("lon IS NOT NULL AND lat IS NOT NULL").withColumn("row", row).withColumn("column", nearby.column_of(F.col("lon"), nearby.columns_around(size, F.col("row"))))
    parts = targets.groupBy("row", "column").agg(F.ceil(F.count("*") / BLOCK_TARGETS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int")
    held = targets.join(parts, ["row", "column"]).withColumn("part", part).groupBy("row", "column", "part").agg(F.collect_list(F.struct("t_us", "lon", "lat", "event_id")).alias("targets"))
    reach = F.least(F.lit(most_km), F.lit(lengths) * kernels.fault_length_km(F.col("mag")))
    sources = events.filter(F.col("t_us") < end_us).filter("lon IS NOT NULL AND lat IS NOT NULL AND mag IS NOT NULL").select("t_us", "lon", "lat", F.col("mag").alias("m"), reach.alias("reach"))
    # the rows and columns of cells that a cap around the source touches
    wide = (F.col("reach") + 0.1) / F.lit(nearby.DEGREE_KM)
    rows = F.sequence(nearby.rows_of(size, F.col("lat") - wide), nearby.rows_of(size, F.col("lat") + wide))
    laid = sources.withColumn("row", F.explode(rows)).withColumn("around", nearby.columns_around(size, F.col("row")))
    ratio = F.sin(F.radians(wide)) / F.cos(F.radians("lat"))
    whole = (F.abs("lat") + wide >= 90) | (ratio >= 1)
    turn = F.when(whole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))))
    column = lambda lon: F.floor((lon + 180) * F.col("around") / 360).cast("long")
    columns = F.array_distinct(F.transform(F.sequence(column(F.col("lon") - turn), column(F.col("lon") + turn)), lambda c: F.pmod(c, F.col("around"))))
    laid = laid.withColumn("column", F.explode(columns)).join(parts, ["row", "column"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    reaching = laid.groupBy("row", "column", "part").agg(F.collect_list(F.struct("t_us", "lon", "lat", "m", "reach")).alias("sources"))
    blocks = held.join(reaching, ["row", "column", "part"], "left").select("targets", F.coalesce("sources", F.expr("array()").cast(reaching.schema["sources"].dataType)).alias("sources"))
    return blocks.repartition(8 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def neighbours(targets: pa.StructArray, sources: pa.StructArray) -> Iterator[tuple]:
    """Pairs of a block, in pieces that hold all sources of their targets: number of targets, of each pair the target's number, the source's m, days and km2."""
    t, lon, lat = (targets.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    s, x, y, m, reach = (sources.field(k).to_numpy(zero_copy_only=False) for k in range(5))
    order = np.argsort(s, kind="stable")
    s, m, reach, v = s[order], m[order], reach[order], unit_vectors(x[order], y[order])
    u = unit_vectors(lon, lat)
    chord = 2 * np.sin(np.minimum(math.pi / 2, reach / (2 * S.EARTH_KM)))
    near = np.floor(lat / SPOT_DEGREES).astype(np.int64) << 32 | np.floor(lon / SPOT_DEGREES).astype(np.int64) & 0xFFFFFFFF
    by_spot = np.lexsort((t, near))
    for spot in np.split(by_spot, np.flatnonzero(np.diff(near[by_spot])) + 1):
        # chords obey the triangle inequality, so nothing else reaches the spot's targets
        middle = u[:, spot].mean(axis=1, keepdims=True)
        span = np.sqrt(((u[:, spot] - middle) ** 2).sum(axis=0)).max()
        here = np.flatnonzero(np.sqrt(((v - middle) ** 2).sum(axis=0)) <= chord + span + 1e-9)
        sh, vh, mh, ch = s[here], v[:, here], m[here], chord[here] ** 2
        step = max(1, PIECE // max(1, len(here)))
        for k in range(0, len(spot), step):
            some = spot[k : k + step]
            n = int(np.searchsorted(sh, t[some[-1]], "left"))
            c2 = sum((u[i, some][:, None] - vh[i, :n][None, :]) ** 2 for i in range(3))
            of, source = np.nonzero((c2 <= ch[:n] * (1 + 1e-12)) & (sh[None, :n] < t[some][:, None]))
            km = 2 * S.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(c2[of, source]) / 2))
            yield len(some), of, mh[source], (t[some[of]] - sh[source]) / DAY_US, km * km


def summed_blocks(blocks: DataFrame, theta: dict[str, float], mc: float) -> DataFrame:
    """The sums of `expected_sums`, of all pairs of a block table. Tasks hold pieces of a block's pairs and sums by cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu = 10 ** theta["log10_mu"]
        for batch in batches:
            at, ends = (batch.column(k).offsets.to_numpy() for k in (0, 1))
            for i in range(batch.num_rows):
                of_target, of_source = batch.column(0).values.slice(at[i], at[i + 1] - at[i]), batch.column(1).values.slice(ends[i], ends[i + 1] - ends[i])
                sums: dict[int, dict[int, np.ndarray]] = {0: {0: np.zeros(3)}, 1: {}, 2: {}}
                for n, of, m, days, km2 in neighbours(of_target, of_source):
                    g = kernel(theta, mc, m, days, km2)
                    rate = mu + np.bincount(of, g, n)
                    p = g / rate[of]
                    sums[0][0] += (n, np.log(rate).sum(), (mu / rate).sum())
                    delay = ratio_cell(days, LEAST_DAYS).astype(np.int64)
                    place = np.floor(m * 10 + 0.5 + 1e-9).astype(np.int64) << CELL_BITS | ratio_cell(km2, LEAST_KM2).astype(np.int64)
                    for kind, cell, values in ((1, delay, (p, p * days, None)), (2, place, (p, p * m, p * km2))):
                        low = cell.min(initial=1 << 40)
                        keys = np.flatnonzero(np.bincount(cell - low))
                        columns = [np.zeros(len(keys)) if w is None else np.bincount(cell - low, w)[keys] for w in values]
                        for key, *three in zip((keys + low).tolist(), *columns, strict=True):
                            sums[kind][key] = sums[kind].get(key, 0) + np.array(three)
                rows = [(kind, key >> CELL_BITS if kind == 2 else key, key & (1 << CELL_BITS) - 1 if kind == 2 else 0, *x.tolist()) for kind, cells in sums.items() for key, x in cells.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 3 + [pa.float64()] * 3, strict=True)], names=["kind", "i", "j", "p", "x", "y"])

    rows = blocks.mapInArrow(run, "kind int, i int, j int, p double, x double, y double")
    return rows.groupBy("kind", "i", "j").agg(*(F.sum(c).alias(c) for c in "pxy"))


def source_table(events: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """m, since, left and n of sources by classes of magnitude and cells of time: the mean time from a source to the start (0 for those after it) and to the end, days."""
    since, left = F.greatest(F.lit(0.0), F.lit(start_us) - F.col("t_us")) / F.lit(DAY_US), (F.lit(end_us) - F.col("t_us")) / F.lit(DAY_US)
    rows = events.filter(F.col("t_us") < end_us).select("mag", since.alias("since"), left.alias("left"))
    cells = [F.floor(F.col("mag") * 10 + 0.5 + 1e-9).alias("m_cell"), cell_of(F.col("since"), LEAST_DAYS).alias("s_cell"), cell_of(F.col("left"), LEAST_DAYS).alias("l_cell")]
    return rows.groupBy(*cells).agg(F.avg("mag").alias("m"), F.avg("since").alias("since"), F.avg("left").alias("left"), F.count("*").alias("n")).drop("m_cell", "s_cell", "l_cell")


def time_mass(since: np.ndarray, left: np.ndarray, c: float, omega: float, tau: float) -> np.ndarray:
    """Integral of exp(-s / tau) (s + c)^-(1 + omega) from since to left, by quadrature in log(s + c)."""
    low, high = np.log(since + c), np.log(left + c)
    half = (high - low)[:, None] / 2
    u = low[:, None] + half * (1 + NODES)
    return (half * WEIGHTS * np.exp(-omega * u - (np.exp(u) - c) / tau)).sum(axis=1)


def kernel(theta: dict[str, float], mc: float, m: np.ndarray, days: np.ndarray, km2: np.ndarray) -> np.ndarray:
    c, tau, d = (10 ** theta[f"log10_{x}"] for x in ("c", "tau", "d"))
    logs = math.log(10) * theta["log10_k0"] + theta["a"] * (m - mc) - days / tau - (1 + theta["omega"]) * np.log(days + c)
    return np.exp(logs - (1 + theta["rho"]) * np.log(km2 + d * np.exp(theta["gamma"] * (m - mc))))


def expectation(pairs: DataFrame, theta: dict[str, float], mc: float) -> DataFrame:
    """event_id, rate (a day and square kilometre) and background, the probability of being triggered by no source, of each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rate, *_ = weighed(batch.column(1), theta, mc)
            mu = 10 ** theta["log10_mu"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rate), pa.array(mu / rate)], names=["event_id", "rate", "background"])

    return pairs.select("event_id", "entries").mapInArrow(run, "event_id long, rate double, background double")


def weighed(entries: pa.ListArray, theta: dict[str, float], mc: float):
    """Targets of entries, the targets' rates, and the entries' m, days, km2 and probabilities (summed over their sources)."""
    sizes = np.diff(entries.offsets.to_numpy())
    of, flat = np.repeat(np.arange(len(sizes)), sizes), entries.flatten()
    m, days, km2, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    g = n * kernel(theta, mc, m, days, km2)
    rate = 10 ** theta["log10_mu"] + np.bincount(of, g, len(sizes))
    return of, rate, m, days, km2, g / rate[of]


def expected_sums(pairs: DataFrame, theta: dict[str, float], mc: float) -> DataFrame:
    """kind, i, j and sums p, x, y. Kind 0: p targets, x their log rates, y their probabilities of being background. Kind 1, by cells i of delay: probabilities p, and x, y of days and nothing.
    Kind 2, by magnitude class i and cells j of distance: p, and x, y of magnitude and squared distance."""

    def cells(kind: int, i: np.ndarray, j: np.ndarray, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        keys, at = np.unique(i.astype(np.int64) << 32 | j.astype(np.int64), return_inverse=True)
        sums = [np.bincount(at, v, len(keys)) for v in (p, p * x, p * y)]
        columns = [np.full(len(keys), kind, np.int32), (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), *sums]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "i", "j", "p", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rate, m, days, km2, p = weighed(batch.column(0), theta, mc)
            nothing, one = np.zeros(len(rate)), np.ones(len(rate))
            yield cells(0, nothing, nothing, one, np.log(rate), 10 ** theta["log10_mu"] / rate)
            yield cells(1, ratio_cell(days, LEAST_DAYS), np.zeros(len(p)), p, days, np.zeros(len(p)))
            yield cells(2, np.floor(m * 10 + 0.5 + 1e-9), ratio_cell(km2, LEAST_KM2), p, m, km2)

    rows = pairs.select("entries").mapInArrow(run, "kind int, i int, j int, p double, x double, y double")
    return rows.groupBy("kind", "i", "j").agg(*(F.sum(c).alias(c) for c in "pxy"))


class Objective:
    """What the maximisation sees: sums of an expectation, and of sources. All arrays have as many entries as there are cells."""

    def __init__(self, sums, sources, mc: float):
        first = sums[sums.kind == 0]
        self.targets, self.log_rates, self.background = float(first.p.sum()), float(first.x.sum()), float(first.y.sum())
        delay, place = sums[(sums.kind == 1) & (sums.p > 0)], sums[(sums.kind == 2) & (sums.p > 0)]
        self.t_p, self.days = delay.p.to_numpy(), (delay.x / delay.p).to_numpy()
        self.r_p, self.r_m, self.km2 = place.p.to_numpy(), (place.x / place.p).to_numpy() - mc, (place.y / place.p).to_numpy()
        self.triggered = float(self.t_p.sum())
        self.n, self.m = sources.n.to_numpy(float), sources.m.to_numpy(float) - mc
        spans = np.stack([sources.since.to_numpy(float), sources.left.to_numpy(float)])
        self.spans, self.span_of = np.unique(spans, axis=1, return_inverse=True)
        self.span_of = self.span_of.reshape(-1)

    def expected(self, theta: dict[str, float]) -> float:
        """Events that all sources should trigger in the window."""
        c, tau, d = (10 ** theta[f"log10_{x}"] for x in ("c", "tau", "d"))
        in_time = time_mass(*self.spans, c, theta["omega"], tau)[self.span_of]
        in_place = math.pi / theta["rho"] * (d * np.exp(theta["gamma"] * self.m)) ** -theta["rho"]
        return float((self.n * 10 ** theta["log10_k0"] * np.exp(theta["a"] * self.m) * in_time * in_place).sum())

    def value(self, theta: dict[str, float]) -> float:
        """The expected log likelihood of who triggered whom, without the background."""
        c, tau, d = (10 ** theta[f"log10_{x}"] for x in ("c", "tau", "d"))
        delays = self.t_p @ (-self.days / tau - (1 + theta["omega"]) * np.log(self.days + c))
        places = self.r_p @ (theta["a"] * self.r_m - (1 + theta["rho"]) * np.log(self.km2 + d * np.exp(theta["gamma"] * self.r_m)))
        return float(self.triggered * math.log(10) * theta["log10_k0"] + delays + places - self.expected(theta))


def maximised(objective: Objective, theta: dict[str, float], rounds: int = 30) -> dict[str, float]:
    """Parameters of the kernel, within their bounds, that raise the objective: damped Newton steps with differences, taken only if they do. The productivity is the best one for the others."""
    names = [n for n in NAMES[1:] if n != "log10_k0"]
    low, high = (np.array([BOUNDS[n][k] for n in names], float) for k in (0, 1))

    def whole(x: np.ndarray) -> dict[str, float]:
        out = theta | dict(zip(names, x.tolist(), strict=True)) | {"log10_k0": 0.0}
        out["log10_k0"] = float(np.clip(math.log10(max(objective.triggered, 1e-300) / objective.expected(out)), *BOUNDS["log10_k0"]))
        return out

    value = lambda x: objective.value(whole(x))
    x = np.clip([theta[n] for n in names], low, high)
    best, damping, step = value(x), 1e-3, 1e-4
    for _ in range(rounds):
        free = lambda k, x=x: np.clip(x + k, low, high)
        unit = np.eye(len(x)) * step
        plus, minus = np.array([value(free(u)) for u in unit]), np.array([value(free(-u)) for u in unit])
        slope = (plus - minus) / np.maximum(1e-12, np.array([(free(u) - free(-u)).sum() for u in unit]))
        bend = np.diag((plus + minus - 2 * best) / step**2)
        for i in range(len(x)):
            for j in range(i):
                bend[i, j] = bend[j, i] = (value(free(unit[i] + unit[j])) - plus[i] - plus[j] + best) / step**2
        # coordinates that would leave their bounds stand still
        held = (x <= low) & (slope < 0) | (x >= high) & (slope > 0)
        moved = False
        for _ in range(12):
            curve, own = np.linalg.eigh(-bend[np.ix_(~held, ~held)])
            move = np.zeros(len(x))
            move[~held] = own @ ((own.T @ slope[~held]) / np.maximum(np.abs(curve), damping * max(1.0, np.abs(curve).max())))
            tried = np.clip(x + np.clip(move, -0.5, 0.5), low, high)
            got = value(tried)
            if got > best:
                moved, gain = True, got - best
                x, best, damping = tried, got, max(1e-9, damping / 8)
                break
            damping = min(damping * 8, 1e6)
        if not moved or gain < 1e-9 * abs(best):
            break
    return whole(x)


def branching_ratio(theta: dict[str, float], beta: float) -> float:
    """Events that one triggers in the mean over all time and space; infinite where it has no mean."""
    slope = theta["a"] - theta["rho"] * theta["gamma"]
    if slope >= beta:
        return math.inf
    c, tau, d = (10 ** theta[f"log10_{x}"] for x in ("c", "tau", "d"))
    in_time = float(time_mass(np.zeros(1), np.array([50 * tau]), c, theta["omega"], tau)[0])
    return 10 ** theta["log10_k0"] * math.pi / theta["rho"] * d ** -theta["rho"] * in_time * beta / (beta - slope)


def aki_beta(events: DataFrame, mc: float, width: float = 0.1) -> float:
    """Exponential rate of magnitudes binned at `width` from mc on."""
    mean = events.filter(F.col("mag") >= mc - width / 2).agg(F.avg("mag")).first()[0]
    return 1 / (mean - (mc - width / 2))


def invert(events: DataFrame, area_km2: float, start_us: int, end_us: int, mc: float, beta: float, theta: dict[str, float] | None = None, tolerance: float = TOLERANCE, iterations: int = MOST_ITERATIONS, most_km: float = ALL_KM) -> DataFrame:
    """A row for each iteration: the parameters that it began with, their log likelihood (targets in [start, end), given the sources before), n_background, branching_ratio, and change, the summed absolute change that followed.

    The fit is the last row; it has converged if its change is below the tolerance. Refused: an empty window, a start from outside the bounds.
    """
    theta = dict(START if theta is None else theta)
    if any(not BOUNDS[n][0] <= theta[n] <= BOUNDS[n][1] for n in NAMES):
        raise ValueError("a starting value is out of its bounds")
    events = events.filter(F.col("mag") >= mc).select("event_id", "t_us", "lon", "lat", "mag")
    blocks = written(block_table(events, start_us, end_us, most_km), "blocks")
    sources = source_table(events, start_us, end_us).toPandas()
    days, rows = (end_us - start_us) / DAY_US, []
    for i in range(iterations + 1):
        objective = Objective(summed_blocks(blocks, theta, mc).toPandas(), sources, mc)
        if not objective.targets:
            raise ValueError("no events in the window")
        ll = objective.log_rates - 10 ** theta["log10_mu"] * area_km2 * days - objective.expected(theta)
        new = maximised(objective, theta) if objective.triggered else dict(theta)
        new["log10_mu"] = float(np.clip(math.log10(max(objective.background, 1e-300) / (area_km2 * days)), *BOUNDS["log10_mu"]))
        change = sum(abs(new[n] - theta[n]) for n in NAMES)
        rows.append((i, *(float(theta[n]) for n in NAMES), ll, int(objective.targets), objective.background, branching_ratio(theta, beta), change))
        if change < tolerance:
            break
        theta = new
    return events.sparkSession.createDataFrame(rows, "iteration int, " + ", ".join(f"{n} double" for n in NAMES) + ", ll double, n_targets long, n_background double, branching_ratio double, change double")
