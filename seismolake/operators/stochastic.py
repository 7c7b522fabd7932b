"""Seeded draws. Every number is a hash of (seed, what it is for), so results don't depend on partitions, retries or order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared_draws import uniform as shared_uniform
from ..plans.shared import written


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), from a hash."""
    h = F.xxhash64(F.lit(seed), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


#: The largest rate that one draw is made for. A Poisson count of this rate is above MOST with a chance below 1e-30, far below what a uniform number of 53 bits tells.
PIECE, MOST = 20.0, 100


def pieces(rate: Column) -> Column:
    """Numbers 1 .. n of the pieces of at most PIECE that a rate is cut into; the sum of the pieces' counts is the rate's count."""
    return F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.ceil(rate / F.lit(PIECE))).cast("long"))


def piece_count(rate: Column, u: Column) -> Column:
    """Poisson count of a rate of at most PIECE by inversion."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        more = u > a["cdf"]
        return F.struct(F.when(more, p).otherwise(a["p"]).alias("p"), F.when(more, a["cdf"] + p).otherwise(a["cdf"]).alias("cdf"), F.when(more, k).otherwise(a["n"]).alias("n"))

    # most draws of small rates are 0, which the first term tells
    return F.when(u > F.exp(-rate), F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda a: a["n"])).otherwise(F.lit(0))


def piece_draw(rate: Column, u: Column, piece: Column) -> Column:
    """Count of one of a rate's pieces; the first draws by u, the others by hashes of it."""
    n = F.size(pieces(rate))
    return piece_count(rate / n, F.when(piece == 1, u).otherwise(uniform(0, u, piece)))


def poisson(rate: Column, u: Column) -> Column:
    """Poisson counts of any rate."""
    return F.aggregate(F.transform(pieces(rate), lambda i: piece_draw(rate, u, i).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n).cast("int")


def drawn(rows: DataFrame, rate: Column, u: Column, number: str) -> DataFrame:
    """rows once for every event of their Poisson count, with number 1, 2, ... (with gaps from one piece of the rate to the next). Pieces are rows, so no row holds a large count."""
    cut = rows.withColumns({"_rate": rate, "_u": u})
    # a rate of one piece without an event has no rows; that is told before anything is made for it
    cut = cut.filter((F.col("_rate") > PIECE) | (F.col("_u") > F.exp(-F.col("_rate")))).withColumn("_piece", F.explode(pieces(F.col("_rate"))))
    cut = cut.withColumn("_n", piece_draw(F.col("_rate"), F.col("_u"), F.col("_piece"))).filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return cut.withColumn(number, (F.col("_piece") - 1) * F.lit(MOST) + F.col("_i")).drop("_rate", "_u", "_piece", "_n", "_i")


def normal(u: Column, v: Column) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def truncated_magnitude(low: Column, high: Column, b: float, u: Column) -> Column:
    """Gutenberg-Richter between low and high by inverse distribution."""
    beta = F.lit(b * math.log(10))
    return low - F.log(F.lit(1.0) - u * (F.lit(1.0) - F.exp(-beta * (high - low)))) / beta


def event_set(grid: DataFrame, catalogues: int, scale: float, b: float, size: float, width: float, seed: int) -> DataFrame:
    """grid (cell_ix, lon0, lat0, m0, rate): synthetic events of `catalogues` catalogues, uniform in their cells, each with rate 1 / (catalogues scale)."""
    spark = grid.sparkSession
    draws = grid.join(F.broadcast(spark.range(catalogues).withColumnRenamed("id", "catalogue")))
    bin_of = F.round(F.col("m0") * 100).cast("long")
    rows = drawn(draws, F.col("rate") * F.lit(scale), shared_uniform(seed, "catalogue", "cell_ix", bin_of), "k")
    u = lambda i: shared_uniform(seed + i, "catalogue", "cell_ix", bin_of, "k")
    return rows.select(
        "catalogue", "cell_ix", "k",
        (F.col("lon0") + F.lit(size) * u(1)).alias("lon"), (F.col("lat0") + F.lit(size) * u(2)).alias("lat"),
        truncated_magnitude(F.col("m0"), F.col("m0") + F.lit(width), b, u(3)).alias("mag"),
        F.lit(1.0 / (catalogues * scale)).alias("rate"),
    )


def ground_motions(events: DataFrame, sites: DataFrame, realisations: int, tau: float, phi: float, level: float, seed: int) -> DataFrame:
    """events and sites with mean_ln: exp(mean + tau z_event + phi z_site), z truncated at level; one z_event for all sites of a realisation. One realisation is the median."""
    rows = events.join(sites, "event_id").withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))))
    cut = lambda z: F.greatest(F.lit(-level), F.least(F.lit(level), z))
    between = cut(normal(uniform(seed, "event_id", "realisation"), uniform(seed + 1, "event_id", "realisation")))
    within = cut(normal(uniform(seed + 2, "event_id", "realisation", "site_id"), uniform(seed + 3, "event_id", "realisation", "site_id")))
    spread = F.lit(0.0) if realisations == 1 else F.lit(tau) * between + F.lit(phi) * within
    return rows.select("event_id", "realisation", "site_id", F.exp(F.col("mean_ln") + spread).alias("im"))


def area_skill_null(groups: DataFrame, targets: int, simulations: int, seed: int) -> DataFrame:
    """Area skills of targets thrown at random by the groups' masses: sim, area. Each target picks its group by the cumulative mass, each area sums over its own targets,
    as a target that falls at cumulative mass x adds what lies behind x: 1 - x, and half its group's mass."""
    w = Window.orderBy(F.desc("alarm")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("mass").over(Window.partitionBy())
    bounds = groups.select((F.sum("mass").over(w) / total).alias("high"), (F.col("mass") / total).alias("own")).withColumn("low", F.col("high") - F.col("own"))
    draws = groups.sparkSession.range(simulations).withColumnRenamed("id", "sim").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(targets)))).withColumn("u", shared_uniform(seed, "sim", "k"))
    hit = draws.join(F.broadcast(bounds), (F.col("u") > F.col("low")) & (F.col("u") <= F.col("high")))
    return hit.groupBy("sim").agg(F.avg(F.lit(1.0) - F.col("high") + F.col("own") / 2).alias("area"))


def cascade(
    spark: SparkSession, parents: DataFrame, simulations: int, k: float, alpha: float, c_days: float, p: float, b: float, mc: float, days: float, generations: int | None, seed: int
) -> DataFrame:
    """Branching simulation, a generation at a time over all simulations: sim, generation, t_days, mag. parents (event_id, t_days, mag) start each simulation; times end at `days`.
    Without a number of generations it goes on until none is born, which needs a branching ratio below 1."""
    whole, beta = k * c_days ** (1 - p) / (p - 1), b * math.log(10)
    if generations is None and (alpha >= beta or whole * beta / (beta - alpha) >= 1):
        raise ValueError("the branching ratio isn't below 1")
    # dealt out anew, as a table of few files would make few tasks for all simulations
    now = parents.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "event_id").join(F.broadcast(spark.range(simulations).withColumnRenamed("id", "sim"))).select("sim", F.col("event_id").alias("id"), "t_days", "mag")
    out, g = None, 0
    while generations is None or g < generations:
        g += 1
        mean = F.lit(k) * F.exp(F.lit(alpha) * (F.col("mag") - F.lit(mc))) * F.lit(c_days ** (1 - p) / (p - 1))
        u = lambda i, g=g: uniform(seed + 10 * g + i, "sim", "id", "child")
        born = drawn(now, mean, uniform(seed + 10 * g, "sim", "id"), "child")
        wait = F.lit(c_days) * (F.pow(F.lit(1.0) - u(1), F.lit(1 / (1 - p))) - F.lit(1.0))
        now = born.select("sim", F.xxhash64("id", "child").alias("id"), (F.col("t_days") + wait).alias("t_days"), (F.lit(mc) - F.log(F.lit(1.0) - u(2)) / F.lit(b * math.log(10))).alias("mag"))
        now = now.filter(F.col("t_days") < days)
        if generations is None:
            now = written(now, "cascade")
        step = now.select("sim", F.lit(g).alias("generation"), "t_days", "mag")
        out = step if out is None else out.unionByName(step)
        if generations is None and now.isEmpty():
            break
    return out
