"""Pseudo-prospective schedules: issue windows, refits, checks of what a fit may have seen, promotion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seismology as S
from ..functions import tails
from ..functions.texts import snapshot_hash
from ..plans.shared import written
from .vintages import last_cutoff


def issue_windows(spark: SparkSession, start: int, end: int, step: int, horizon: int) -> DataFrame:
    """issue_us and end_us of the windows from start that close at or before end."""
    if step <= 0 or horizon <= 0:
        raise ValueError("step and horizon must be positive")
    n = max(0, (end - horizon - start) // step + 1)
    return spark.range(n).select((F.lit(start) + F.col("id") * F.lit(step)).alias("issue_us"), (F.lit(start + horizon) + F.col("id") * F.lit(step)).alias("end_us"))


def refit_boundaries(spark: SparkSession, start_us: int, last_us: int, policy: str = "annual") -> DataFrame:
    """boundary_us: the first of January of the years after start, up to the last issue; none without a policy."""
    at = lambda us: F.timestamp_micros(F.lit(us))
    years = spark.range(1).select(F.explode(F.sequence(F.year(at(start_us)) + 1, F.greatest(F.year(at(last_us)), F.year(at(start_us)) + 1))).alias("y"))
    found = years.select(F.unix_micros(F.make_timestamp("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))).alias("boundary_us"))
    return found.filter((F.col("boundary_us") > start_us) & (F.col("boundary_us") <= last_us) & F.lit(policy != "none"))


def snapshot_breaks(windows: DataFrame, refits: DataFrame) -> DataFrame:
    """Windows (issue_us, snapshot) whose snapshot differs from the one before without a refit (boundary_us, snapshot) between: a sound run has none."""
    w = Window.orderBy("issue_us")
    rows = windows.withColumn("previous", F.lag("snapshot").over(w)).withColumn("previous_us", F.lag("issue_us").over(w)).filter("previous IS NOT NULL AND previous <> snapshot")
    held = refits.select(F.col("boundary_us").alias("b"), F.col("snapshot").alias("s"))
    covered = (F.col("b") > F.col("previous_us")) & (F.col("b") <= F.col("issue_us")) & (F.col("s") == F.col("snapshot"))
    return rows.join(F.broadcast(held), covered, "left_anti")


def late_training(fits: DataFrame) -> DataFrame:
    """Fits (fit_id, cutoff_us, training_max_us) that lack the time of their last training event, or whose last one isn't before the cut-off."""
    return fits.filter("training_max_us IS NULL OR training_max_us >= cutoff_us")


def student_quantile(nu, z: float):
    """Student's t quantile from the normal one, by Fisher and Cornish's expansion to the third order; error below 1e-4 from nu = 10 on."""
    z3, z5, z7 = z**3, z**5, z**7
    return F.lit(z) + F.lit((z3 + z) / 4) / nu + F.lit((5 * z5 + 16 * z3 + 3 * z) / 96) / (nu * nu) + F.lit((3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / 384) / (nu * nu * nu)


def paired_interval(diffs: DataFrame, totals: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """diffs (d: log rate of A less that of B at each event) and totals (one row: n_a, n_b): gain per event, its t interval, and whether the test is decided."""
    s = diffs.agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"), F.count_if(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf"))).alias("bad"))
    n = F.col("n").cast("double")
    variance = F.col("ss") / (n - 1) - F.col("s") * F.col("s") / (n * n - n)
    rows = s.crossJoin(totals).withColumn("variance", F.when((F.col("n") > 1) & (F.col("bad") == 0), variance))
    gain = (F.col("s") - (F.col("n_a") - F.col("n_b"))) / n
    half = student_quantile(n - 1, z) * F.sqrt(F.col("variance") / n)
    decided = F.coalesce(F.col("variance") > 0, F.lit(False))
    reason = F.when(F.col("n") < 2, "fewer than two events").when(F.col("bad") > 0, "a rate of zero").when(~decided, "no variance")
    keep = lambda c: F.when(decided, c)
    return rows.select("n", decided.alias("decided"), reason.alias("reason"), keep(gain).alias("gain"), keep(gain - half).alias("low"), keep(gain + half).alias("high"), keep(gain / F.sqrt(F.col("variance") / n)).alias("t"), keep(gain - half > 0).alias("beats"))


def wilcoxon(diffs: DataFrame, shift: float) -> DataFrame:
    """Signed-rank test of d - shift: n without zeros, rank sum of the positive ones, z with ties, two-sided p of the normal approximation.

    Ranks come from counts of equal sizes, so a running sum goes over distinct absolute differences only.
    """
    d = F.round(F.col("d") - F.lit(shift), 12)
    by = diffs.select(d.alias("d")).filter("d <> 0").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("rank", before + (F.col("c") + 1) / 2)
    s = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("n", "w_plus", z.alias("z"), (F.lit(2.0) * (F.lit(1.0) - S.normal_cdf(F.abs(z)))).alias("p_value"))


def pass_rate_condition(rates: DataFrame, windows: int, least_windows: int = 12) -> DataFrame:
    """rates (region_id, test, challenger, baseline): met where every test's rate is at least the baseline's over enough consecutive windows; a missing rate is never enough."""
    ok = F.coalesce(F.col("challenger") >= F.col("baseline"), F.lit(False))
    return rates.groupBy("region_id").agg((F.min(ok.cast("int")) == 1).alias("rates_ok")).select("region_id", (F.col("rates_ok") & F.lit(windows >= least_windows)).alias("met"))


def overall_verdict(regions: DataFrame, expected: list[str], least: int = 2) -> DataFrame:
    """regions (region_id, promotable): promoted if enough regions pass; robust if the regions nobody ran couldn't change that."""
    wanted = regions.sparkSession.createDataFrame([(r,) for r in expected], "region string")
    rows = wanted.join(regions, F.col("region") == F.col("region_id"), "left")
    s = rows.agg(F.count_if(F.coalesce("promotable", F.lit(False))).alias("passing"), F.count("region_id").alias("evaluated"), F.count("*").alias("expected"))
    reachable = F.col("passing") + F.col("expected") - F.col("evaluated")
    return s.select("passing", "evaluated", (F.col("passing") >= least).alias("promoted"), (reachable < least).alias("robust"))


DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Smoothed:
    """A gridded model: the training's rate spread by its counts and `floor` events a cell, and a part `recent` of each cell's events of late, fading with `fade_days`. Magnitudes from mc on."""

    mc: float
    floor: float = 0.5
    recent: float = 0.3
    fade_days: float = 5.0

    def expected(self, n_cell: Column, n_train: Column, n_cells: int, train_days: Column, faded: Column, horizon_days: float) -> Column:
        share = (n_cell + F.lit(self.floor)) / (n_train + F.lit(self.floor * n_cells))
        lasting = F.lit(1 - self.recent) * n_train / train_days * share
        return F.lit(horizon_days) * (lasting + F.lit(self.recent / self.fade_days) * faded)


def refits(events: DataFrame, cutoffs: DataFrame, model: Smoothed, start_us: int) -> DataFrame:
    """A fit for each cut-off (cutoff_us): n_train, train_days, training_max_us and snapshot, the hash of its parameters. Each event is counted once, by the cut-off that first sees it, and counts run on from cut-off to cut-off."""
    # a policy's cut-offs are few
    first = F.broadcast(cutoffs.select(F.col("cutoff_us").alias("c"), F.lag("cutoff_us").over(Window.orderBy("cutoff_us")).alias("before")))
    used = events.filter((F.col("t_us") >= start_us) & (F.col("mag") >= model.mc) & (F.col("cell_ix") >= 0) & (F.col("etype") == "earthquake"))
    seen = used.join(first, (F.col("t_us") < F.col("c")) & (F.col("before").isNull() | (F.col("t_us") >= F.col("before")))).groupBy("c").agg(F.count("*").alias("n"), F.max("t_us").alias("top"))
    run = Window.orderBy("cutoff_us").rowsBetween(Window.unboundedPreceding, 0)
    rows = cutoffs.join(seen, F.col("cutoff_us") == F.col("c"), "left")
    rows = rows.select("cutoff_us", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("n_train"), F.max("top").over(run).alias("training_max_us"), ((F.col("cutoff_us") - F.lit(start_us)) / F.lit(float(DAY_US))).alias("train_days"))
    hashed = snapshot_hash({"n_train": F.col("n_train"), "train_days": F.col("train_days"), "mc": F.lit(model.mc), "recent": F.lit(model.recent), "fade_days": F.lit(model.fade_days), "floor": F.lit(model.floor)})
    return rows.withColumn("snapshot", hashed)


def fading(events: DataFrame, issues: list[int], model: Smoothed, start_us: int) -> DataFrame:
    """cell_ix, issue_us and faded, the sum of exp(-age / fade_days) over a cell's events before the issue. An issue reads only what came since the one before; what was there fades by the time between, cell by cell, over the
    issues of a cell that have something new (as many as there are issues, at most, whatever the number of events)."""
    edges = F.array(*(F.lit(i) for i in issues))
    used = events.filter((F.col("t_us") >= start_us) & (F.col("t_us") < issues[-1]) & (F.col("mag") >= model.mc) & (F.col("cell_ix") >= 0) & (F.col("etype") == "earthquake"))
    due = F.array_min(F.filter(edges, lambda i: i > F.col("t_us")))
    age = lambda a, b: F.exp(-(a - b) / F.lit(model.fade_days * DAY_US))
    frames = used.withColumn("issue_us", due).groupBy("cell_ix", "issue_us").agg(F.sum(age(F.col("issue_us"), F.col("t_us"))).alias("fresh"))
    held = frames.groupBy("cell_ix").agg(F.sort_array(F.collect_list(F.struct("issue_us", "fresh"))).alias("fresh"))
    of = lambda i: F.filter("fresh", lambda x: x["issue_us"] == i)
    step = lambda a, i: F.struct(i.alias("issue_us"), (a["faded"] * age(i, a["issue_us"]) + F.coalesce(F.get(of(i), 0)["fresh"], F.lit(0.0))).alias("faded"))
    begin = F.array(F.struct(F.lit(issues[0]).alias("issue_us"), F.lit(0.0).alias("faded")))
    walked = F.aggregate(edges, begin, lambda a, i: F.concat(a, F.array(step(F.element_at(a, -1), i))))
    return held.select("cell_ix", F.explode(F.slice(walked, 2, len(issues))).alias("x")).select("cell_ix", "x.*")


def run_schedule(events: DataFrame, cells: DataFrame, model: Smoothed, start_us: int, end_us: int, step_us: int, horizon_us: int, cutoffs: DataFrame, catalogue_end_us: int, alpha: float = 0.05) -> DataFrame:
    """A row for each issue from start_us on whose window closes by end_us: the fit in use, what is expected, and the window's targets with their tests.

    events (t_us, mag, etype, cell_ix; null mag is unknown), cells (cell_ix), cutoffs (cutoff_us, with one at or before the first issue). Targets are located earthquakes from mc on; what is left out is counted by reason. A window that
    closes after the catalogue's end is issued and not scored. Raised: no window; a fit that has seen its cut-off or later; a snapshot that changes without a refit.
    """
    spark, n_cells, horizon_days = events.sparkSession, cells.count(), horizon_us / DAY_US
    windows = issue_windows(spark, start_us, end_us, step_us, horizon_us)
    issues = [r.issue_us for r in windows.orderBy("issue_us").collect()]  # a schedule is small
    if not issues:
        raise ValueError("no window closes at or before the schedule's end")
    first_us = events.agg(F.min("t_us")).first()[0]
    fits = written(refits(events, cutoffs, model, first_us), "fits")
    if not late_training(fits.withColumn("fit_id", F.col("cutoff_us"))).filter("n_train > 0").isEmpty():
        raise ValueError("a fit has seen its cut-off")
    plan = last_cutoff(windows.select("issue_us"), cutoffs).withColumnRenamed("cutoff_us", "fit_cutoff_us").join(windows, "issue_us")
    plan = plan.join(fits, F.col("fit_cutoff_us") == F.col("cutoff_us")).drop("cutoff_us")
    breaks = snapshot_breaks(plan.select("issue_us", "snapshot"), fits.select(F.col("cutoff_us").alias("boundary_us"), "snapshot"))
    if not breaks.isEmpty():
        raise ValueError("a snapshot changed without a refit")

    # training counts of cells, by the cut-off that first sees them
    marks = F.broadcast(cutoffs.select(F.col("cutoff_us").alias("c"), F.lag("cutoff_us").over(Window.orderBy("cutoff_us")).alias("before")))
    sound = (F.col("mag") >= model.mc) & (F.col("cell_ix") >= 0) & (F.col("etype") == "earthquake")
    own = events.filter(sound).join(marks, (F.col("t_us") < F.col("c")) & (F.col("before").isNull() | (F.col("t_us") >= F.col("before")))).groupBy("cell_ix", "c").agg(F.count("*").alias("n"))
    own = cells.select("cell_ix").join(F.broadcast(cutoffs.select(F.col("cutoff_us").alias("c")))).join(own, ["cell_ix", "c"], "left")
    trained = own.select(F.col("cell_ix").alias("t_cell"), F.col("c").alias("t_cutoff"), F.coalesce(F.sum("n").over(Window.partitionBy("cell_ix").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("n_cell"))
    faded = fading(events, issues, model, first_us).select(F.col("cell_ix").alias("f_cell"), F.col("issue_us").alias("f_issue"), "faded")
    grid = cells.select("cell_ix").join(F.broadcast(plan)).join(trained, (F.col("cell_ix") == F.col("t_cell")) & (F.col("fit_cutoff_us") == F.col("t_cutoff")))
    grid = grid.join(faded, (F.col("cell_ix") == F.col("f_cell")) & (F.col("issue_us") == F.col("f_issue")), "left")
    rate = model.expected(F.col("n_cell"), F.col("n_train"), n_cells, F.col("train_days"), F.coalesce("faded", F.lit(0.0)), horizon_days)
    grid = grid.select("cell_ix", "issue_us", rate.alias("rate"))

    # events meet the windows that hold them: horizon / step at most
    last = F.floor((F.col("t_us") - F.lit(start_us)) / F.lit(step_us))
    earliest = F.greatest(F.lit(0), F.floor((F.col("t_us") - F.lit(start_us + horizon_us)) / F.lit(step_us)) + 1)
    latest = F.least(last, F.lit(len(issues) - 1))
    inside = events.filter(F.col("t_us") >= start_us).filter(earliest <= latest).withColumn("k", F.explode(F.sequence(earliest, latest))).withColumn("issue_us", F.lit(start_us) + F.col("k") * F.lit(step_us))
    inside = inside.filter((F.col("cell_ix") >= 0) & (F.col("issue_us") + F.lit(horizon_us) <= catalogue_end_us))
    why = F.when(F.col("etype") != "earthquake", "type").when(F.col("mag").isNull(), "magnitude").when(F.col("mag") >= model.mc, "target")
    counts = inside.withColumn("why", why).groupBy("issue_us", "cell_ix").agg(*(F.count_if(F.col("why") == w).alias(n) for w, n in (("target", "n"), ("type", "n_type"), ("magnitude", "n_magnitude"))))
    seen = counts.select(F.col("issue_us").alias("s_issue"), F.col("cell_ix").alias("s_cell"), "n", "n_type", "n_magnitude")
    scored = grid.join(seen, (F.col("issue_us") == F.col("s_issue")) & (F.col("cell_ix") == F.col("s_cell")), "left").fillna(0, ["n", "n_type", "n_magnitude"])
    term = F.when(F.col("n") > 0, F.col("n") * F.log("rate") - S.log_factorial(F.col("n"))).otherwise(F.lit(0.0)) - F.col("rate")
    sums = scored.groupBy("issue_us").agg(F.sum("rate").alias("total_expected"), F.sum("n").alias("n_targets"), F.sum("n_type").alias("n_excluded_type"), F.sum("n_magnitude").alias("n_excluded_magnitude"), F.sum(term).alias("log_likelihood"))
    rows = plan.join(sums, "issue_us")
    ok = F.col("end_us") <= catalogue_end_us
    scored_only = {c: F.when(ok, F.col(c)) for c in ("n_targets", "n_excluded_type", "n_excluded_magnitude", "log_likelihood")}
    n = F.col("n_targets").cast("long")
    deltas = {"delta1": F.when(ok, F.lit(1.0) - tails.poisson_cdf(n - 1, F.col("total_expected"))), "delta2": F.when(ok, tails.poisson_cdf(n, F.col("total_expected")))}
    rows = rows.withColumns(deltas).withColumns(scored_only).withColumn("passed", F.least("delta1", "delta2") >= alpha / 2)
    reason = F.when(~ok, "closes after the catalogue's end")
    return rows.select("issue_us", "end_us", "fit_cutoff_us", "snapshot", "n_train", "total_expected", *scored_only, "delta1", "delta2", "passed", reason.alias("not_scored"))
