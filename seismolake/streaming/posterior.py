"""Productivity of aftershock sequences, updated online: keyed state with timers, and the same figures by one batch query.

A sequence is a main event and what follows it. At issue times, fixed delays after the main event, the posterior of its productivity is the prior times the Poisson likelihood of the events strictly before the issue. Online, a
sequence's state are the rows of its events, of which an issue takes the latest versions, so neither the order of rows, repeats, revisions nor the cut of the stream into batches matter; an issue's timer fires once the watermark has passed
the issue, when rows before it can't come any more, and the last one drops the state. Rows later than the watermark's delay are left out, by Spark itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import seismology as S
from ..operators import models as M

DAY_US = 86_400_000_000
COUNTED = "sequence string, main_mag double, delay double, issue_us long, n long"
ISSUED = "sequence string, issue_us long, n long, mean_a double, expected double, probability double"


class Law:
    """The generic law of a region: rate 10^(a + b (main - least)) (t + c)^-p, a being Gaussian; from `start` days after the main event on. `ahead` is what an issue looks at, days."""

    def __init__(self, mean: float = -1.67, sigma: float = 0.5, b: float = 0.91, c: float = 0.05, p: float = 1.08, least: float = 3.5, start: float = 0.01, ahead: float = 3.0):
        self.mean, self.sigma, self.b, self.c, self.p, self.least, self.start, self.ahead = mean, sigma, b, c, p, least, start, ahead

    def omori(self, low: float, high: float) -> float:
        if self.p == 1:
            return math.log((high + self.c) / (low + self.c))
        return ((high + self.c) ** (1 - self.p) - (low + self.c) ** (1 - self.p)) / (1 - self.p)

    def exposure(self, main_mag: float, low: float, high: float) -> float:
        return 10 ** (self.b * (main_mag - self.least)) * self.omori(low, high)

    def counts(self, t_us, mag, main_us: int, issue_us: int):
        """Which events an issue counts."""
        return (mag >= self.least) & (t_us > main_us + self.start * DAY_US) & (t_us < issue_us)

    def issued(self, main_mag: float, delay: float, n: int) -> tuple[float, float, float]:
        """Mean productivity, expected events and probability of one at least in the time ahead of an issue."""
        a = self.mean - 4 * self.sigma + np.arange(101) * (8 * self.sigma / 100)
        rate = 10**a * self.exposure(main_mag, self.start, delay)
        logs = -(((a - self.mean) / self.sigma) ** 2) / 2 + n * np.log(rate) - rate
        weight = np.exp(logs - logs.max())
        weight /= weight.sum()
        ahead = 10**a * self.exposure(main_mag, delay, delay + self.ahead)
        return float(weight @ a), float(weight @ ahead), float(weight @ -np.expm1(-ahead))


HELD = pa.schema([("event_id", pa.string()), ("t_us", pa.int64()), ("mag", pa.float64()), ("version", pa.int64())])


class Sequences(StatefulProcessor):
    """Rows of a sequence, or of a part of its events (main_us, main_mag, event_id, t_us, mag, version), in any order and number: COUNTED rows. A batch of rows is one entry of the state."""

    def __init__(self, law: Law, delays: list[float]):
        self.law, self.delays = law, sorted(delays)

    def issue_us(self, main_us: int, delay: float) -> int:
        return main_us + int(delay * DAY_US)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.main = handle.getValueState("main", "main_us long, main_mag double")
        self.events = handle.getListState("events", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            if not self.main.exists():
                main_us, main_mag = int(batch.main_us.iloc[0]), float(batch.main_mag.iloc[0])
                left = [d for d in self.delays if -(-self.issue_us(main_us, d) // 1000) > watermark]
                if not left:
                    continue
                self.main.update((main_us, main_mag))
                for delay in left:
                    self.handle.registerTimer(-(-self.issue_us(main_us, delay) // 1000))
            held = pa.RecordBatch.from_pandas(batch[["event_id", "t_us", "mag", "version"]], HELD, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, HELD) as writer:
                writer.write_batch(held)
            self.events.appendValue((sink.getvalue().to_pybytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        main_us, main_mag = self.main.get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        held = pa.concat_tables([pa.ipc.open_stream(bytes(rows)).read_all() for (rows,) in self.events.get()]).to_pandas()
        held = held.sort_values("version", kind="stable").drop_duplicates("event_id", keep="last")
        t_us, mag = held.t_us.to_numpy(np.int64), held.mag.to_numpy(float)
        for delay in self.delays:
            issue = self.issue_us(main_us, delay)
            if -(-issue // 1000) == fired:
                n = int(self.law.counts(t_us, mag, main_us, issue).sum())
                yield pd.DataFrame([(key[0], main_mag, delay, issue, n)], columns=[x.split()[0] for x in COUNTED.split(", ")])
        if fired >= -(-self.issue_us(main_us, self.delays[-1]) // 1000):
            self.main.clear()
            self.events.clear()

    def close(self) -> None:
        pass


def online_counts(rows: DataFrame, time: str, late: str, law: Law, delays: list[float], parts: int = 1) -> DataFrame:
    """COUNTED rows of a stream (sequence, main_us, main_mag, event_id, t_us, mag, version and a timestamp column), one for each part of a sequence's events by their ids; an issue's come out once the watermark is past it."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows.withWatermark(time, late).withColumn("event_id", F.col("event_id").cast("string"))
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(parts))).groupBy("sequence", "part")
    return keyed.transformWithStateInPandas(Sequences(law, delays), COUNTED, "Append", "EventTime")


def issued(counted: DataFrame, law: Law) -> DataFrame:
    """ISSUED rows of COUNTED ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.sequence, r.issue_us, r.n, *law.issued(r.main_mag, r.delay, r.n)) for r in batch.itertuples()]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ISSUED.split(", ")])

    return counted.mapInPandas(run, ISSUED)


def summed(counted: DataFrame) -> DataFrame:
    """COUNTED rows of whole sequences, of a table of those of their parts."""
    return counted.groupBy("sequence", "main_mag", "delay", "issue_us").agg(F.sum("n").alias("n"))


def online(rows: DataFrame, time: str, late: str, law: Law, delays: list[float]) -> DataFrame:
    """ISSUED rows of such a stream whose sequences are one part each."""
    return issued(online_counts(rows, time, late, law, delays), law)


def in_batch(rows: DataFrame, law: Law, delays: list[float]) -> DataFrame:
    """The same rows from a table. Counts are summed before they meet the grid of productivities, so a long sequence is no large group."""
    latest = rows.groupBy("sequence", "main_us", "main_mag", "event_id").agg(F.max_by(F.struct("t_us", "mag"), "version").alias("e")).select("sequence", "main_us", "main_mag", "e.*")
    issue = F.explode(F.array(*(F.struct(F.lit(float(d)).alias("delay"), (F.col("main_us") + F.lit(int(d * DAY_US))).alias("issue_us")) for d in delays)))
    mains = latest.select("sequence", "main_us", "main_mag").distinct().select("*", issue.alias("i")).select("sequence", "main_us", "main_mag", "i.*")
    counted = law.counts(F.col("t_us"), F.col("mag"), F.col("main_us"), F.col("issue_us"))
    met = latest.select("sequence", "main_us", "t_us", "mag", issue.alias("i")).select("sequence", "main_us", "t_us", "mag", "i.*").groupBy("sequence", "issue_us").agg(F.sum(counted.cast("long")).alias("n"))
    found = mains.join(met, ["sequence", "issue_us"])
    prior = M.productivity_prior(rows.sparkSession, law.mean, law.sigma)
    exposure = lambda low, high: F.pow(F.lit(10.0), F.lit(law.b) * (F.col("main_mag") - F.lit(law.least))) * S.omori_integral(law.c, law.p, low, high)
    found = found.withColumns({"past": exposure(F.lit(law.start), F.col("delay")), "ahead": exposure(F.col("delay"), F.col("delay") + F.lit(law.ahead))})
    # a grid of 101 rows
    rows = found.crossJoin(F.broadcast(prior)).withColumn("rate", F.pow(F.lit(10.0), "a") * F.col("past"))
    rows = rows.withColumn("l", F.log("p") + F.col("n") * F.log("rate") - F.col("rate"))
    top = rows.groupBy("sequence", "issue_us").agg(F.max("l").alias("top"))
    rows = rows.join(top, ["sequence", "issue_us"]).withColumn("w", F.exp(F.col("l") - F.col("top"))).withColumn("coming", F.pow(F.lit(10.0), "a") * F.col("ahead"))
    mean = lambda x: F.sum(F.col("w") * x) / F.sum("w")
    return rows.groupBy("sequence", "issue_us", "n").agg(mean(F.col("a")).alias("mean_a"), mean(F.col("coming")).alias("expected"), mean(F.lit(1.0) - F.exp(-F.col("coming"))).alias("probability"))
