"""Registered queries of the catalogue engine over the driver's tables, each with the SQL that DuckDB answers alike.

Floats are rounded on both sides, as sums depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import projection as P
from .functions import seismology as S
from .functions import tails
from .functions.shared_draws import uniform_sql
from .operators import catalogue as C
from .operators import grids as G
from .operators import homogenise as H
from .operators import models as M
from .operators import risk as R
from .operators import scoring as K
from .operators import sequences as Q
from .operators import stochastic as T
from .sources.events import DAY_US, catalogue, table

START = 1_704_067_200_000_000
CUT = START + 20 * DAY_US
RING = [(81.0, 26.5), (88.0, 27.0), (86.5, 30.2), (83.0, 29.8)]
STATES = [(0.5, 0.6, 0.05), (1.0, 0.6, 0.2), (2.0, 0.6, 0.6), (4.0, 0.6, 1.0)]

SEIS = f"""seis AS (
  SELECT event_id, event_type AS lane, epoch_us(ts) AS t_us, CAST(2.5 AS DOUBLE) + value / CAST(115.13 AS DOUBLE) AS mag,
    CAST(floor((CAST(2.5 AS DOUBLE) + value / CAST(115.13 AS DOUBLE)) / CAST(0.1 AS DOUBLE) + CAST(0.5 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS mbin,
    CAST(80 AS DOUBLE) + CAST((event_id * 7919) % 900 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
    CAST(26 AS DOUBLE) + CAST((event_id * 104729) % 450 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
    CAST((event_id * 31) % 90 AS DOUBLE) AS depth_km,
    CASE WHEN event_type = 'error' THEN 'landslide' ELSE 'earthquake' END AS etype,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch_us(ts) + (event_id % 40) * {DAY_US} END AS avail_us, props
  FROM events),
cells AS (
  SELECT range AS cell_ix, range % 18 AS ix, range // 18 AS iy, CAST(80 AS DOUBLE) + (range % 18) * CAST(0.5 AS DOUBLE) AS lon0,
         CAST(26 AS DOUBLE) + (range // 18) * CAST(0.5 AS DOUBLE) AS lat0 FROM range(162)),
placed AS (
  SELECT *, CASE WHEN ix BETWEEN 0 AND 17 AND iy BETWEEN 0 AND 8 THEN iy * 18 + ix ELSE -1 END AS cell_ix FROM (
    SELECT *, CAST(floor((lon - 80) / CAST(0.5 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS ix,
              CAST(floor((lat - 26) / CAST(0.5 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS iy FROM seis)),
counts AS (SELECT c.cell_ix, c.ix, c.iy, c.lat0, c.lon0, count(p.event_id) AS n FROM cells c LEFT JOIN placed p ON p.cell_ix = c.cell_ix GROUP BY ALL)"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, helpers: bool = True, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH RECURSIVE {SEIS}" if recursive else f"WITH {SEIS}"
            ORACLE[f.__name__] = f"{head} {sql}" if helpers and not sql.lstrip().startswith(",") else f"{head}{sql}" if helpers else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"SELECT event_id, t_us FROM seis WHERE t_us < {CUT}")
def cat_before(spark: SparkSession, d: str) -> DataFrame:
    return C.before(catalogue(spark, d), CUT).select("event_id", "t_us")


@query(f"SELECT event_id FROM seis WHERE t_us >= {START + 5 * DAY_US} AND t_us < {CUT}")
def cat_between(spark, d):
    return C.between(catalogue(spark, d), START + 5 * DAY_US, CUT).select("event_id")


@query("SELECT event_id FROM seis WHERE mag >= 3.5 AND etype = 'earthquake'")
def cat_at_least(spark, d):
    return C.at_least(C.of_type(catalogue(spark, d), "earthquake"), 3.5).select("event_id")


@query(f"SELECT event_id FROM seis WHERE coalesce(avail_us < {CUT}, false)")
def cat_as_of_exclude(spark, d):
    return C.as_of(catalogue(spark, d), CUT, False).select("event_id")


@query(f"SELECT event_id FROM seis WHERE coalesce(avail_us < {CUT}, true)")
def cat_as_of_include(spark, d):
    return C.as_of(catalogue(spark, d), CUT, True).select("event_id")


@query(f"SELECT event_id, avail_us FROM seis WHERE avail_us >= {CUT}")
def cat_revised_after(spark, d):
    return C.revised_after(catalogue(spark, d), CUT).select("event_id", "avail_us")


@query(f"""
, l AS (SELECT list_sort(list(avail_us - t_us)) AS v FROM seis WHERE avail_us IS NOT NULL)
SELECT (SELECT count(*) FROM seis) AS n_events, (SELECT count(*) FROM seis WHERE avail_us IS NULL) AS n_unknown,
  (SELECT count(*) FROM seis WHERE avail_us >= {CUT}) AS n_revised,
  v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] / 8.64e10 AS median_days,
  v[CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT) + 1] / 8.64e10 AS p90_days, v[len(v)] / 8.64e10 AS max_days FROM l""")
def vintage_summary(spark, d):
    return C.vintage_summary(catalogue(spark, d), CUT)


@query(r"""
, p AS (SELECT event_id // 1000 AS chunk, sha256(string_agg(k, chr(10) ORDER BY k)) AS digest
        FROM (SELECT event_id, event_id || '|' || t_us AS k FROM seis) GROUP BY 1)
, q AS (SELECT chunk // 1000 AS chunk, sha256(string_agg(digest, chr(10) ORDER BY chunk)) AS digest FROM p GROUP BY 1),
r AS (SELECT chunk // 1000 AS chunk, sha256(string_agg(digest, chr(10) ORDER BY chunk)) AS digest FROM q GROUP BY 1)
SELECT sha256(string_agg(digest, chr(10) ORDER BY chunk)) AS event_hash FROM r""")
def cat_event_hash(spark, d):
    return C.event_hash(catalogue(spark, d))


@query("SELECT k.etype, count(s.event_id) AS n FROM (VALUES ('earthquake'), ('landslide'), ('explosion'), ('other')) k(etype) LEFT JOIN seis s USING (etype) GROUP BY 1")
def cat_count_by_type(spark, d):
    return C.count_by_type(catalogue(spark, d))


@query(f"""
SELECT CASE WHEN etype <> 'earthquake' THEN 'not_earthquake' WHEN mag IS NULL THEN 'no_magnitude' WHEN mag < 3 THEN 'below_threshold'
  WHEN NOT (t_us >= {START} AND t_us < {CUT}) THEN 'outside_window' ELSE 'used' END AS reason, count(*) AS n FROM seis GROUP BY 1""")
def exclusion_funnel(spark, d):
    return C.exclusion_funnel(catalogue(spark, d), 3.0, START, CUT)


@query("""
, k AS (SELECT props, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM seis)
SELECT CASE WHEN props IS NULL THEN 'no_props' WHEN k IS NULL THEN 'no_key' WHEN k > 50 THEN 'out_of_range' ELSE 'ok' END AS reason, count(*) AS n FROM k GROUP BY 1""")
def reject_side_table(spark, d):
    return C.parse_rejects(catalogue(spark, d))


@query("SELECT mbin, count(*) AS n FROM seis GROUP BY 1")
def mag_fmd(spark, d):
    return C.magnitude_counts(catalogue(spark, d))


MODE = "m AS (SELECT mbin AS mode_bin, count(*) AS mode_n FROM seis GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"


@query(f", {MODE} SELECT mode_bin, mode_n, round(mode_bin * CAST(0.1 AS DOUBLE) + 0.2, 2) AS mc FROM m")
def mc_maxcurv(spark, d):
    return C.maximum_curvature(catalogue(spark, d))


@query("SELECT count(*) AS n, round(log10(exp(1)) / (avg(mbin * CAST(0.1 AS DOUBLE)) - 2.75), 6) AS b, "
       "round(2.3 * pow(log10(exp(1)) / (avg(mbin * CAST(0.1 AS DOUBLE)) - 2.75), 2) * sqrt(var_samp(mbin * CAST(0.1 AS DOUBLE)) / count(*)), 6) AS sigma FROM seis WHERE mbin >= 28")  # fmt: skip
def b_value_aki(spark, d):
    return rounded(C.b_value(catalogue(spark, d), 28))


@query(f""", {MODE}
SELECT mode_bin, mode_n, round(mode_bin * CAST(0.1 AS DOUBLE) + 0.2, 2) AS mc, CAST(count(*) AS BIGINT) AS n,
  round(log10(exp(1)) / (avg(mbin * CAST(0.1 AS DOUBLE)) - ((mode_bin + 2) * CAST(0.1 AS DOUBLE) - 0.05)), 6) AS b
FROM (SELECT * FROM seis WHERE etype = 'earthquake' AND t_us < {CUT} AND coalesce(avail_us < {CUT}, true)) JOIN mm ON mbin >= mode_bin + 2 GROUP BY mode_bin, mode_n""".replace(
    MODE, f"mm AS (SELECT mbin AS mode_bin, count(*) AS mode_n FROM seis WHERE etype = 'earthquake' AND t_us < {CUT} AND coalesce(avail_us < {CUT}, true) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"))
def mc_b_value(spark, d):
    """The flagship: earthquakes known at the cut-off, their completeness and b value."""
    return C.mc_and_b(C.as_of(C.before(C.of_type(catalogue(spark, d), "earthquake"), CUT), CUT, True))


@query("""
, c AS (SELECT mbin, count(*) AS k FROM seis GROUP BY 1),
s AS (SELECT mbin, sum(k) OVER w AS n, sum(k * (mbin * CAST(0.1 AS DOUBLE))) OVER w AS s1, sum(k * (mbin * CAST(0.1 AS DOUBLE)) * (mbin * CAST(0.1 AS DOUBLE))) OVER w AS s2
      FROM c WINDOW w AS (ORDER BY mbin DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT mbin, CAST(n AS BIGINT) AS n, log10(exp(1)) / (s1 / n - (mbin * CAST(0.1 AS DOUBLE) - 0.05)) AS b, s1, s2 FROM s WHERE n >= 30),
g AS (SELECT mbin, n, b, 2.3 * b * b * sqrt((s2 - s1 * s1 / n) / (n * (n - 1))) AS sigma,
      CASE WHEN count(*) OVER w = 6 AND max(mbin) OVER w = mbin + 5 THEN avg(b) OVER w END AS mean_b FROM b WINDOW w AS (ORDER BY mbin ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT mbin, n, round(b, 5) AS b, round(sigma, 5) AS sigma, round(mean_b, 5) AS mean_b, coalesce(abs(mean_b - b) <= sigma, false) AS stable FROM g""")
def b_value_stability(spark, d):
    return rounded(C.b_value_stability(catalogue(spark, d)), 5)


@query("""
, p AS (SELECT a.event_id, max(least(b.mag, b.mag - 4.5 - 0.75 * log10((a.t_us - b.t_us) / 8.64e10))) AS raised
        FROM seis a JOIN seis b ON b.t_us < a.t_us GROUP BY 1)
SELECT event_id, round(greatest(2.6, raised), 6) AS mc FROM seis LEFT JOIN p USING (event_id)""")
def stai_mc_current(spark, d):
    return rounded(C.stai_current(catalogue(spark, d), 2.6))


@query("""
SELECT event_id, round(CASE WHEN lane = 'click' THEN CASE WHEN mag BETWEEN 3.5 AND 6.2 THEN 0.85 * mag + 1.03 END
  ELSE CASE WHEN mag BETWEEN 3.0 AND 6.1 THEN 0.67 * mag + 2.07 WHEN mag BETWEEN 6.2 AND 8.2 THEN 0.99 * mag + 0.08 END END, 2) AS mw FROM seis""")
def scordilis_piecewise(spark, d):
    kind = F.when(F.col("lane") == "click", "mb").otherwise("ms")
    return catalogue(spark, d).select("event_id", S.scordilis_mw(kind, F.col("mag")).alias("mw"))


@query(f"SELECT event_id, count(*) OVER (ORDER BY t_us RANGE BETWEEN {7 * DAY_US} PRECEDING AND 1 PRECEDING) AS n FROM seis")
def causal_count_7d(spark, d):
    return Q.rolling_count(catalogue(spark, d), 7 * DAY_US)


@query("SELECT event_id, t_us - max(t_us) OVER (ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since_us FROM seis")
def time_since_previous(spark, d):
    return Q.time_since_previous(catalogue(spark, d))


@query(f"""
SELECT event_id, round(ln(1.0 + count(*) OVER (ORDER BY t_us RANGE BETWEEN {DAY_US} PRECEDING AND 1 PRECEDING)), 6) AS n1,
  round(ln(1.0 + count(*) OVER (ORDER BY t_us RANGE BETWEEN {7 * DAY_US} PRECEDING AND 1 PRECEDING)), 6) AS n7,
  round(ln(1.0 + count(*) OVER (ORDER BY t_us RANGE BETWEEN {30 * DAY_US} PRECEDING AND 1 PRECEDING)), 6) AS n30,
  round(coalesce(max(mag) OVER (ORDER BY t_us RANGE BETWEEN {30 * DAY_US} PRECEDING AND 1 PRECEDING), -1), 6) AS max30 FROM seis""")
def causal_feature_matrix(spark, d):
    return rounded(Q.causal_features(catalogue(spark, d)))


SPLITS = Q.blocked_splits(START, START + 30 * DAY_US, 4, DAY_US)


@query(", f AS (SELECT * FROM (VALUES " + ", ".join(map(str, SPLITS)) + ") v(fold, a, b, c, e)) SELECT CAST(fold AS BIGINT) AS fold, "
       "count(*) FILTER (t_us >= a AND t_us < b) AS n_train, count(*) FILTER (t_us >= c AND t_us < e) AS n_val FROM seis JOIN f ON (t_us >= a AND t_us < b) OR (t_us >= c AND t_us < e) GROUP BY 1")  # fmt: skip
def split_membership(spark, d):
    return Q.split_members(catalogue(spark, d), SPLITS)


ISSUED = f", w AS (SELECT range AS k, {START} + range * {DAY_US} AS a FROM range(30)), n AS (SELECT k, count(event_id) AS n FROM w LEFT JOIN (SELECT * FROM seis WHERE mag >= 5.2) ON t_us >= a AND t_us < a + {2 * DAY_US} GROUP BY 1)"


@query(f"{ISSUED} SELECT k, n FROM n")
def window_target_counts(spark, d):
    return Q.window_counts(C.at_least(catalogue(spark, d), 5.2), START, DAY_US, 2 * DAY_US, 30)


@query(f"{ISSUED}, g AS (SELECT k - row_number() OVER (ORDER BY k) AS island FROM n WHERE n > 0) SELECT max(c) AS longest FROM (SELECT count(*) AS c FROM g GROUP BY island)")
def consecutive_runs(spark, d):
    return Q.longest_run(Q.window_counts(C.at_least(catalogue(spark, d), 5.2), START, DAY_US, 2 * DAY_US, 30), 1)


GAP = 600_000_000
#: Pairs of an hour, so that sparse catalogues have pairs too.
PAIR_WINDOW = 6 * GAP


@query(f"""
, o AS (SELECT event_id, t_us, CASE WHEN coalesce(t_us - lag(t_us) OVER (ORDER BY t_us) > {GAP}, true) THEN t_us END AS opens FROM seis)
SELECT event_id, max(opens) OVER (ORDER BY t_us) AS block FROM o""")
def gap_blocks(spark, d):
    return Q.gap_blocks(catalogue(spark, d), GAP).select("event_id", "block")


@query(f"""
SELECT a.event_id AS a, b.event_id AS b, round(2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) AS km
FROM seis a JOIN seis b ON a.event_id < b.event_id AND a.lane <> b.lane AND abs(a.t_us - b.t_us) <= {PAIR_WINDOW}
WHERE 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 100""")
def assoc_pairs(spark, d):
    return rounded(Q.association_pairs(catalogue(spark, d), PAIR_WINDOW, 100.0))


@query()
def assoc_clusters(spark, d):
    return Q.associate(catalogue(spark, d), GAP, 100.0)


@query("SELECT mbin, arg_min(lane, depth_km * 1000000 + event_id) AS lane, list_sort(list(DISTINCT event_id)) AS ids FROM (SELECT * REPLACE (event_id // 4 AS mbin) FROM seis) GROUP BY 1")
def merge_preferred(spark, d):
    """Merged events of four records each."""
    return C.preferred(catalogue(spark, d).withColumn("mbin", F.floor(F.col("event_id") / 4).cast("long")), ["mbin"], ["depth_km", "event_id", "lane"]).select("mbin", "lane", "ids")


@query("SELECT cell_ix, ix, iy, lon0, lat0, n FROM counts")
def lattice_cells(spark, d):
    """The lattice with its events."""
    return G.lattice(spark).join(G.dense_counts(catalogue(spark, d)), "cell_ix").select("cell_ix", "ix", "iy", "lon0", "lat0", "n")


@query("SELECT event_id, cell_ix FROM placed")
def point_to_cell(spark, d):
    return G.located(catalogue(spark, d)).select("event_id", "cell_ix")


@query(f"""
SELECT t_us // {DAY_US} AS t_bin, cell_ix, least(CAST(floor((mag - 2.5) / 1 + CAST(1e-9 AS DOUBLE)) AS BIGINT), 3) AS m_bin, count(*) AS n
FROM placed WHERE cell_ix >= 0 AND mag >= 2.5 - CAST(1e-9 AS DOUBLE) GROUP BY ALL""")
def grid_counts_3d(spark, d):
    return G.counts_3d(catalogue(spark, d), DAY_US)


@query("SELECT cell_ix, n FROM counts")
def grid_counts_dense(spark, d):
    return G.dense_counts(catalogue(spark, d))


EDGES = ", ".join(str((*a, *b)) for a, b in zip(RING, RING[1:] + RING[:1], strict=True))


@query(f"""
, e AS (SELECT * FROM (VALUES {EDGES}) v(x1, y1, x2, y2))
SELECT event_id, count(*) FILTER (((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM seis, e GROUP BY 1""")
def point_in_polygon(spark, d):
    return G.in_polygon(catalogue(spark, d), RING).select("event_id", "inside")


@query("SELECT cell_ix, round(n / sum(n) OVER (), 9) AS mass FROM counts")
def ref_marginal(spark, d):
    return rounded(G.reference_marginal(G.dense_counts(catalogue(spark, d))).select("cell_ix", "mass"), 9)


AREA = "(6371.0 * 6371.0 * radians(0.5) * (sin(radians(lat0 + 0.5)) - sin(radians(lat0))))"


@query(f"SELECT cell_ix, round({AREA}, 4) AS area, round({AREA} / sum({AREA}) OVER (), 9) AS mass, round({AREA} / sum({AREA}) OVER () * sum(n) OVER (), 6) AS expected, n FROM counts")
def ref_uniform_area(spark, d):
    """What each cell would have of the table's events by its area, and what it has."""
    counts = G.dense_counts(catalogue(spark, d))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    rows = G.uniform_area(G.lattice(spark)).join(counts, "cell_ix").crossJoin(total)
    return rows.select("cell_ix", F.round("area", 4).alias("area"), F.round("mass", 9).alias("mass"), F.round(F.col("mass") * F.col("total"), 6).alias("expected"), "n")


SMOOTH = """s AS (
  SELECT a.cell_ix, 0.01 + sum(CASE WHEN abs(a.ix - b.ix) <= 3 AND abs(a.iy - b.iy) <= 3 THEN b.n * exp(-((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy)) / CAST(2 AS DOUBLE)) ELSE 0 END) AS v
  FROM counts a, counts b GROUP BY 1)"""


@query(f", {SMOOTH} SELECT cell_ix, round(v / sum(v) OVER (), 9) AS mass FROM s")
def ref_smoothed(spark, d):
    return rounded(G.smoothed(G.dense_counts(catalogue(spark, d)), G.lattice(spark), 1.0, 3, 0.01), 9)


@query("""
, w AS (SELECT (t_us // 864000000000) AS win, cell_ix, count(*) AS k FROM placed WHERE cell_ix >= 0 GROUP BY ALL),
m AS (SELECT win, cell_ix, k / sum(k) OVER (PARTITION BY win) AS mass, 1.0 + win % 3 AS expected FROM w)
SELECT win AS "window", cell_ix, round(mass * expected / sum(mass * expected) OVER (), 9) AS mass FROM m""")
def ref_pooled(spark, d):
    from pyspark.sql import Window

    w = G.located(catalogue(spark, d)).filter("cell_ix >= 0").groupBy(F.floor(F.col("t_us") / (10 * DAY_US)).cast("long").alias("window"), "cell_ix").agg(F.count("*").alias("k"))
    mass = F.col("k") / F.sum("k").over(Window.partitionBy("window"))
    return rounded(G.pooled_reference(w.withColumn("mass", mass).withColumn("expected", F.lit(1.0) + F.col("window") % 3)), 9)


@query("""
, s AS (SELECT event_id, (lon - 80) / CAST(0.5 AS DOUBLE) AS x, (lat - 26) / CAST(0.5 AS DOUBLE) AS y FROM seis),
p AS (SELECT *, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0 FROM s),
k AS (SELECT event_id, c.n * (CASE WHEN c.ix = x0 THEN 1 - (x - x0) ELSE x - x0 END) * (CASE WHEN c.iy = y0 THEN 1 - (y - y0) ELSE y - y0 END) AS v
      FROM p JOIN counts c ON c.ix IN (x0, x0 + 1) AND c.iy IN (y0, y0 + 1))
SELECT event_id, round(sum(v), 6) AS value FROM k GROUP BY 1 HAVING count(*) = 4""")
def bilinear_sample(spark, d):
    events = catalogue(spark, d)
    field = G.lattice(spark).join(G.dense_counts(events), "cell_ix").select("ix", "iy", F.col("n").cast("double").alias("value"))
    return rounded(G.bilinear(events, field))


@query("""
, t AS (SELECT event_id AS site_id, lon AS s_lon, lat AS s_lat FROM seis WHERE mag >= 5.5),
c AS (SELECT event_id, site_id, round(pow(lon - s_lon, 2) + pow(lat - s_lat, 2), 9) AS d2 FROM seis, t)
SELECT event_id, site_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d2, site_id) AS r FROM c) WHERE r = 1""")
def nearest_site(spark, d):
    events = catalogue(spark, d)
    sites = C.at_least(events, 5.5).select(F.col("event_id").alias("site_id"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    return G.nearest_site(events, sites, 2)


ALARM = """a AS (SELECT cell_ix, coalesce(max(pow(10, 0.5 * (mag - 5)) / (1 + (pow((lon0 + 0.25 - lon) * 111.19 * cos(radians(lat0 + 0.25)), 2) + pow((lat0 + 0.25 - lat) * 111.19, 2)) / 2500.0)), 0) AS alarm
  FROM cells LEFT JOIN (SELECT lon, lat, mag FROM seis WHERE mag >= 5.5) ON true GROUP BY 1)"""


@query(f", {ALARM} SELECT cell_ix, round(alarm, 6) AS alarm FROM a")
def recent_large_alarm(spark, d):
    return rounded(G.recent_large_alarm(C.at_least(catalogue(spark, d), 5.5), G.lattice(spark), 5.0, 0.5, 50.0))


def _alarm_cells(spark, d):
    """Counts before the cut-off as alarm, uniform mass, events of the rest as targets."""
    events = catalogue(spark, d)
    alarm = G.dense_counts(C.before(events, CUT)).withColumnRenamed("n", "alarm")
    hits = G.dense_counts(C.at_least(events.filter(F.col("t_us") >= CUT), 4.0))
    return alarm.join(hits, "cell_ix").withColumn("mass", F.lit(1.0) / F.lit(162.0))


MOLCHAN = f"""
, al AS (SELECT c.cell_ix, count(p.event_id) AS alarm FROM cells c LEFT JOIN placed p ON p.cell_ix = c.cell_ix AND t_us < {CUT} GROUP BY 1),
hi AS (SELECT c.cell_ix, count(p.event_id) AS n FROM cells c LEFT JOIN placed p ON p.cell_ix = c.cell_ix AND t_us >= {CUT} AND mag >= 4 GROUP BY 1),
g AS (SELECT alarm, sum(1.0 / 162.0) AS mass, count(*) AS cells, CAST(sum(n) AS BIGINT) AS hits FROM al JOIN hi USING (cell_ix) GROUP BY 1),
t AS (SELECT alarm, least(1.0, sum(mass) OVER w) AS tau, 1 - sum(hits) OVER w / sum(hits) OVER () AS miss, CAST(sum(cells) OVER w AS BIGINT) AS cells
      FROM g WINDOW w AS (ORDER BY alarm DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"{MOLCHAN} SELECT alarm, round(mass, 6) AS mass, cells, hits FROM g")
def molchan_groups(spark, d):
    return rounded(K.molchan_groups(_alarm_cells(spark, d)))


@query(f"{MOLCHAN} SELECT alarm, round(tau, 6) AS tau, round(miss, 6) AS miss, cells FROM t")
def molchan_trajectory(spark, d):
    return rounded(K.molchan_trajectory(K.molchan_groups(_alarm_cells(spark, d))))


@query(f"""{MOLCHAN},
s AS (SELECT tau, 1 - miss AS hit, coalesce(lag(tau) OVER w, 0) AS tau0, coalesce(lag(1 - miss) OVER w, 0) AS hit0 FROM t WINDOW w AS (ORDER BY tau, miss DESC))
SELECT round(sum((tau - tau0) * (hit + hit0) / 2) + (1 - max(tau)) * max(hit), 6) AS area_skill FROM s""")
def area_skill(spark, d):
    return rounded(K.area_skill(K.molchan_trajectory(K.molchan_groups(_alarm_cells(spark, d)))))


def _terms(spark, d):
    """Daily windows: events, and log-rate and expectation differences of two toy forecasts."""
    day = F.floor((F.col("t_us") - START) / DAY_US).cast("long")
    rate = F.lit(0.1) * (F.col("mag") - 2.5) - F.lit(0.05)
    return C.at_least(catalogue(spark, d), 4.0).groupBy(day.alias("window")).agg(F.count("*").alias("n"), F.sum(rate).alias("rate_diff"), (F.count("*") * F.lit(0.02)).alias("expected_diff"))


TERMS = f", t AS (SELECT (t_us - {START}) // {DAY_US} AS win, count(*) AS n, sum(0.1 * (mag - 2.5) - 0.05) AS r, count(*) * 0.02 AS e FROM seis WHERE mag >= 4 GROUP BY 1)"


@query(f"{TERMS} SELECT round((sum(r) - sum(e)) / sum(n), 6) AS gain, round(CAST(sum(n) AS DOUBLE) * sum(n) / sum(n * n), 6) AS effective_blocks, CAST(sum(n) AS BIGINT) AS n_events FROM t")
def pooled_information_gain(spark, d):
    return rounded(K.information_gain(_terms(spark, d)))


@query(f'{TERMS} SELECT win AS "window", round((sum(r) OVER () - r - sum(e) OVER () + e) / (sum(n) OVER () - n), 6) AS gain FROM t')
def leave_one_window_out(spark, d):
    return rounded(K.leave_one_out(_terms(spark, d)))


def _bootstrap(length: int, resamples: int, seed: int) -> str:
    return f"""
w AS (SELECT win - (SELECT min(win) FROM t) AS k, n, r - e AS g FROM t), nw AS (SELECT max(k) + 1 AS nw FROM w),
d{length} AS MATERIALIZED (SELECT i.range AS resample, b.range AS b, least(nw - 1, CAST(floor({uniform_sql(seed, "i.range", "b.range")} * nw) AS BIGINT)) AS start, nw FROM nw, range({resamples}) i, range(100000) b WHERE b.range < ceil(nw / {length}.0)),
s{length} AS (SELECT resample, sum(coalesce(n, 0)) AS n, sum(coalesce(g, 0)) AS g FROM (SELECT resample, (start + o.range) % nw AS k FROM d{length}, range({length}) o WHERE b * {length} + o.range < nw) LEFT JOIN w USING (k) GROUP BY 1),
q{length} AS (SELECT {length} AS length, round(quantile_cont(g / n, 0.05), 6) AS low, round(quantile_cont(g / n, 0.5), 6) AS median, round(quantile_cont(g / n, 0.95), 6) AS high FROM s{length} WHERE n > 0)"""


@query(f"{TERMS},{_bootstrap(5, 500, 7)} SELECT low, median, high FROM q5")
def bootstrap_ci(spark, d):
    return rounded(K.block_bootstrap(_terms(spark, d), 5, 500, 7))


@query(f"{TERMS},{_bootstrap(2, 200, 7)},{_bootstrap(3, 200, 7).replace('w AS (', 'w2 AS (', 1).replace('nw AS (', 'nw2 AS (', 1)} SELECT * FROM q2 UNION ALL SELECT * FROM q3")
def block_length_sensitivity(spark, d):
    return rounded(K.block_length_sensitivity(_terms(spark, d), [2, 3], 200, 7))


@query("SELECT count(*) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance, round(avg(v) / sqrt(var_samp(v) / count(*)), 4) AS t FROM (SELECT 0.1 * (mag - 2.5) - 0.05 AS v FROM seis WHERE mag >= 4)")
def paired_t(spark, d):
    s = K.paired_test(C.at_least(catalogue(spark, d), 4.0).select((F.lit(0.1) * (F.col("mag") - 2.5) - F.lit(0.05)).alias("d")))
    return s.select("n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("t", 4).alias("t"))


@query("""
, v AS (SELECT lane AS test, CASE WHEN event_id % 10 = 0 THEN NULL ELSE mag >= 3 END AS passed FROM seis)
SELECT test, count(*) FILTER (passed) AS n_passed, count(passed) AS n_scored FROM v GROUP BY 1""")
def pass_rates(spark, d):
    passed = F.when(F.col("event_id") % 10 != 0, F.col("mag") >= 3)
    return K.pass_rates(catalogue(spark, d).select(F.col("lane").alias("test"), passed.alias("passed")))


@query("SELECT round(sum(n * ln(n + 0.5) - (n + 0.5) - lgamma(n + 1)), 4) AS ll, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n + 0.5) AS DOUBLE), 4) AS expected FROM counts")
def poisson_ll(spark, d):
    return rounded(K.poisson_log_likelihood(G.dense_counts(catalogue(spark, d)).withColumn("rate", F.col("n") + F.lit(0.5))), 4)


@query("""
, r AS (SELECT n, (1.0 + cell_ix % 5) * sum(n) OVER () / sum(1.0 + cell_ix % 5) OVER () AS rate FROM counts)
SELECT round(sum(n * ln(rate) - rate - lgamma(n + 1)), 3) AS statistic, CAST(sum(n) AS BIGINT) AS n FROM r""")
def conditional_ll(spark, d):
    return rounded(K.conditional_statistics(G.dense_counts(catalogue(spark, d)).withColumn("rate", F.lit(1.0) + F.col("cell_ix") % 5)), 3)


@query("""
, f AS (SELECT cell_ix, 'a' AS model, 0.3 AS weight, n + 0.5 AS rate FROM counts UNION ALL SELECT cell_ix, 'b', 0.7, 1.0 + cell_ix % 5 FROM counts),
l AS (SELECT cell_ix, weight, ln(greatest(rate, 0.01 * avg(rate) OVER w)) AS lr, sum(rate) OVER w AS total FROM f WINDOW w AS (PARTITION BY model)),
c AS (SELECT cell_ix, exp(sum(weight * lr)) AS rate, exp(sum(weight * ln(total))) AS target FROM l GROUP BY 1)
SELECT cell_ix, round(rate * target / sum(rate) OVER (), 6) AS rate FROM c""")
def geometric_pool(spark, d):
    counts = G.dense_counts(catalogue(spark, d))
    a = counts.select(F.lit("a").alias("model"), F.lit(0.3).alias("weight"), "cell_ix", (F.col("n") + F.lit(0.5)).alias("rate"))
    b = counts.select(F.lit("b"), F.lit(0.7), "cell_ix", (F.lit(1.0) + F.col("cell_ix") % 5).alias("rate"))
    return rounded(K.geometric_pool(a.union(b), 0.01))


@query("SELECT event_id, round(pow(10, -1.67 + 0.91 * (mag - 2.5)) * (pow(30.05, -0.08) - pow(0.06, -0.08)) / (-0.08), 6) AS expected FROM seis")
def rj_expected_count(spark, d):
    count = S.reasenberg_jones_count(-1.67, 0.91, 0.05, 1.08, F.col("mag"), F.lit(2.5), F.lit(0.01), F.lit(30.0))
    return rounded(catalogue(spark, d).select("event_id", count.alias("expected")))


@query("SELECT mbin, round(pow(10, -0.9 * (mbin * CAST(0.1 AS DOUBLE) - 0.05)) - pow(10, -0.9 * (mbin * CAST(0.1 AS DOUBLE) + 0.05)), 9) AS mass FROM (SELECT DISTINCT mbin FROM seis)")
def gr_bin_pmf(spark, d):
    low = F.col("mbin") * F.lit(0.1) - F.lit(0.05)
    return rounded(catalogue(spark, d).select("mbin").distinct().select("mbin", S.gutenberg_richter_mass(low, 0.9, 0.1).alias("mass")), 9)


@query("""
, q AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS v FROM lineitem)
SELECT flag, status, round(avg(v), 4) AS mean, round(greatest(0, least(quantile_cont(v, 0.05), avg(v))), 4) AS low, round(greatest(quantile_cont(v, 0.95), avg(v)), 4) AS high FROM q GROUP BY ALL""")
def money_range(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("v"))
    return rounded(R.money_range(rows, ["flag", "status"], "v"), 4)


YEARS = ", y AS (SELECT c.range AS catalogue, coalesce(sum(o_totalprice), 0) / 2.0 AS loss FROM range(1000) c LEFT JOIN orders ON o_orderkey % 1000 = c.range GROUP BY 1)"


def _years(spark, d):
    events = table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("catalogue"), F.col("o_totalprice").alias("loss"))
    return R.annual_losses(events, spark.range(1000).withColumnRenamed("id", "catalogue"), 2.0)


@query(f"{YEARS} SELECT p AS period, round(quantile_cont(loss, 1 - 2.0 / p), 2) AS loss FROM y, (VALUES (CAST(10 AS DOUBLE)), (100), (1000)) v(p) GROUP BY p".replace("quantile_cont(loss, 1 - 2.0 / p)", "CASE p WHEN 10 THEN quantile_cont(loss, 0.8) WHEN 100 THEN quantile_cont(loss, 0.98) ELSE quantile_cont(loss, 0.998) END"))
def aep_curve(spark, d):
    return rounded(R.aggregate_exceedance(_years(spark, d), 2.0, 1000, [10.0, 100.0, 1000.0, 5000.0]), 2)


@query("""
, o AS (SELECT o_totalprice AS loss, sum(0.0005) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM orders)
SELECT p AS period, max(loss) FILTER (upto >= 1 / p - 1e-12) AS loss FROM o, (VALUES (CAST(3.3 AS DOUBLE)), (33.3), (333.3)) v(p) GROUP BY p HAVING max(loss) FILTER (upto >= 1 / p - 1e-12) IS NOT NULL""")
def oep_curve(spark, d):
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("loss"), F.lit(0.0005).alias("rate"))
    return R.occurrence_exceedance(events, [3.3, 33.3, 333.3])


@query(f"{YEARS} SELECT catalogue, round(least(greatest(loss - 1000000.0, 0.0), 500000.0), 4) AS ceded FROM y")
def insurance_layer(spark, d):
    return rounded(_years(spark, d).select("catalogue", R.insurance_layer(F.col("loss"), 1e6, 5e5).alias("ceded")), 4)


@query(f"{YEARS} SELECT round(avg(loss - (loss * 0.9 + 1000)), 4) AS mean, avg(CAST(loss - (loss * 0.9 + 1000) < 0 AS INT)) AS negative_share FROM y")
def branch_difference(spark, d):
    base = _years(spark, d)
    return R.branch_difference(base, base.select("catalogue", (F.col("loss") * F.lit(0.9) + F.lit(1000.0)).alias("loss"))).select(F.round("mean", 4).alias("mean"), "negative_share")


@query("""
, s AS (SELECT lane, 1001.0 * sum(mag) / sum(sum(mag)) OVER () AS share FROM seis GROUP BY 1),
f AS (SELECT lane, CAST(floor(share) AS BIGINT) AS whole, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lane) AS r, 1001 - CAST(sum(floor(share)) OVER () AS BIGINT) AS rest FROM s)
SELECT lane, whole + CAST(r <= rest AS BIGINT) AS n FROM f""")
def largest_remainder(spark, d):
    return R.largest_remainder(catalogue(spark, d).groupBy("lane").agg(F.sum("mag").alias("w")), "lane", "w", 1001)


def _phi(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(0.3989422804014327 * exp(-({x}) * ({x}) / 2) * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def _ratio(im: str) -> str:
    above = [_phi(f"(ln({im} / {m:.1f}) / {b})") for m, b, _ in STATES] + ["0"]
    return " + ".join(f"greatest(0, {p} - {q}) * {r}" for p, q, (_, _, r) in zip(above, above[1:], STATES, strict=False))


@query(f"""
, f AS (SELECT event_id % 20 AS realisation, cell_ix, 0.05 + mag - 2.5 AS im FROM placed WHERE mag >= 4.5),
a AS (SELECT cell_ix, 1000.0 + cell_ix AS value FROM cells)
SELECT realisation, round(sum(value * ({_ratio("im")})), 3) AS loss FROM f JOIN a USING (cell_ix) GROUP BY 1""")
def damage_losses(spark, d):
    fields = G.located(C.at_least(catalogue(spark, d), 4.5)).select((F.col("event_id") % 20).alias("realisation"), F.col("cell_ix").alias("site_id"), (F.lit(0.05) + F.col("mag") - F.lit(2.5)).alias("im"))
    assets = G.lattice(spark).select(F.col("cell_ix").alias("site_id"), (F.lit(1000.0) + F.col("cell_ix")).alias("value"))
    return rounded(R.portfolio_losses(assets, fields, STATES), 3)


@query("""
SELECT k AS event_type, CAST(l AS DOUBLE) AS level, CAST(poe AS DOUBLE) AS poe FROM (
  SELECT event_type AS k, unnest([3.0, 4.0, 5.0]) AS l, unnest([count(*) FILTER (value >= 57.565) / count(*), count(*) FILTER (value >= 172.695) / count(*), count(*) FILTER (value >= 287.825) / count(*)]) AS poe FROM events GROUP BY 1)""")
def hazard_unpivot(spark, d):
    share = lambda v: F.count_if(F.col("value") >= F.lit(v)) / F.count("*")
    wide = table(spark, d, "events").groupBy("event_type").agg(*(share(115.13 * (m - 2.5)).alias(f"poe-{m}") for m in (3.0, 4.0, 5.0)))
    return R.unpivot_curves(wide, ["event_type"])


@query("""
, t AS (SELECT unnest([0.1, 0.3, 1.0, 3.0]) AS p, unnest([1.0, 2.0, 2.5, 0.5]) AS c), s AS (SELECT p AS p0, c AS c0, lead(p) OVER (ORDER BY p) AS p1, lead(c) OVER (ORDER BY p) AS c1 FROM t),
w AS (SELECT round(mag - 2.4, 3) AS period, count(*) AS n FROM seis GROUP BY 1)
SELECT round(period, 3) AS period, round(max(c0 + ln(period / p0) / ln(p1 / p0) * (c1 - c0)), 6) AS coefficient FROM w JOIN s ON period BETWEEN p0 AND p1 GROUP BY 1""")
def coeff_log_interp(spark, d):
    """At periods that grow with the events' magnitudes."""
    held = spark.createDataFrame([(0.1, 1.0), (0.3, 2.0), (1.0, 2.5), (3.0, 0.5)], "period double, coefficient double")
    wanted = catalogue(spark, d).select(F.round(F.col("mag") - F.lit(2.4), 3).alias("period")).distinct()
    return R.log_interpolated(wanted, held).select(F.round("period", 3).alias("period"), F.round("coefficient", 6).alias("coefficient"))


@query("""
, o AS (SELECT count(*) AS n FROM seis WHERE mag >= 4),
g AS (SELECT CAST(-3.67 AS DOUBLE) + range * 0.04 AS a, exp(-pow((-3.67 + range * 0.04 + 1.67) / 0.5, 2) / 2) AS w FROM range(101)),
p AS (SELECT a, w / sum(w) OVER () AS p FROM g),
l AS (SELECT a, ln(p) + n * ln(pow(10, a) * 60.0 * n) - pow(10, a) * 60.0 * n AS l FROM p, o), e AS (SELECT a, exp(l - max(l) OVER ()) AS w FROM l)
SELECT round(a, 6) AS a, round(w / sum(w) OVER (), 9) AS p FROM e""")
def bayes_grid_update(spark, d):
    """The table's events of 4 and more, at an exposure of sixty each."""
    n = C.at_least(catalogue(spark, d), 4.0).count()
    posterior = M.productivity_posterior(M.productivity_prior(spark, -1.67, 0.5), n, 60.0 * n)
    return posterior.select(F.round("a", 6).alias("a"), F.round("p", 9).alias("p"))


@query("""
, x AS (SELECT max(mag) AS top FROM seis),
g AS (SELECT CAST(-3.67 AS DOUBLE) + range * 0.04 AS a, exp(-pow((-3.67 + range * 0.04 + 1.67) / 0.5, 2) / 2) AS w FROM range(101)),
p AS (SELECT a, w / sum(w) OVER () AS p FROM g),
r AS (SELECT t AS threshold, p, pow(10, a + 0.91 * (top - t)) * (pow(30.05, -0.08) - pow(0.06, -0.08)) / (-0.08) AS rate FROM p, x, (VALUES (CAST(4.0 AS DOUBLE)), (5.0), (6.0)) v(t))
SELECT threshold, round(sum(p * rate), 6) AS expected, round(sum(p * (1 - exp(-rate))), 6) AS probability FROM r GROUP BY 1""")
def ladder_probabilities(spark, d):
    """After the table's largest event."""
    top = catalogue(spark, d).agg(F.max("mag")).first()[0]
    return rounded(M.ladder(M.productivity_prior(spark, -1.67, 0.5), top, 0.91, [4.0, 5.0, 6.0], 0.05, 1.08, 0.01, 30.0))


ETAS = {"mu": 20.0, "k": 0.02, "alpha": 1.2, "c_days": 0.01, "p": 1.1, "mc": 4.0}


@query(f"""
, e AS (SELECT * FROM seis WHERE mag >= 4),
r AS (SELECT a.event_id, 20 + coalesce(sum(0.02 * exp(1.2 * (b.mag - 4)) * pow((a.t_us - b.t_us) / 8.64e10 + 0.01, -1.1)), 0) AS rate
      FROM e a LEFT JOIN e b ON b.t_us < a.t_us GROUP BY 1),
m AS (SELECT sum(0.02 * exp(1.2 * (mag - 4)) * (pow(({START + 30 * DAY_US} - t_us) / 8.64e10 + 0.01, -0.1) - pow(0.01, -0.1)) / (-0.1)) AS mass FROM e)
SELECT count(*) AS n, round(sum(ln(rate)), 4) AS log_rates, round(600 + (SELECT mass FROM m), 4) AS integral, round(sum(ln(rate)) - 600 - (SELECT mass FROM m), 4) AS ll FROM r""")
def etas_log_likelihood(spark, d):
    return rounded(M.etas_log_likelihood(C.at_least(catalogue(spark, d), 4.0), START + 30 * DAY_US, 30.0, **ETAS), 4)


@query("""
, c AS (SELECT n, n + 0.5 AS a, 1.0 + cell_ix % 5 AS b FROM counts), w AS (SELECT range / 20.0 AS wa, 1 - range / 20.0 AS wb FROM range(21)),
s AS (SELECT wa, wb, round(sum(n * (wa * ln(a) + wb * ln(b)) - exp(wa * ln(a) + wb * ln(b))), 6) AS ll FROM c, w GROUP BY ALL)
SELECT ll, CAST(round(wa, 2) AS DOUBLE) AS w_a, CAST(round(wb, 2) AS DOUBLE) AS w_b FROM s ORDER BY ll DESC, wa DESC LIMIT 1""")
def ensemble_weights(spark, d):
    cells = G.dense_counts(catalogue(spark, d)).select("n", (F.col("n") + F.lit(0.5)).alias("a"), (F.lit(1.0) + F.col("cell_ix") % 5).alias("b"))
    best = M.fit_pool_weights(cells, ["a", "b"], 20)
    return best.select("ll", F.round("w_a", 2).alias("w_a"), F.round("w_b", 2).alias("w_b"))


@query(f"""
, s AS (SELECT avg(mag) AS m, stddev_pop(mag) AS sd FROM seis WHERE t_us < {CUT})
SELECT event_id, round((mag - m) / sd, 6) AS mag FROM seis, s""")
def standardised_magnitudes(spark, d):
    return rounded(M.standardised(catalogue(spark, d).select("event_id", "t_us", "mag"), ["mag"], CUT).select("event_id", "mag"))


@query("""
, c AS (SELECT event_id, acos(least(1, greatest(-1, sin(radians(28.0)) * sin(radians(lat)) + cos(radians(28.0)) * cos(radians(lat)) * cos(radians(lon - 84.0))))) AS c, lon, lat FROM seis)
SELECT event_id, round(6371.0 * (CASE WHEN c < 1e-12 THEN 1 ELSE c / sin(c) END) * cos(radians(lat)) * sin(radians(lon - 84.0)), 4) AS x,
  round(6371.0 * (CASE WHEN c < 1e-12 THEN 1 ELSE c / sin(c) END) * (cos(radians(28.0)) * sin(radians(lat)) - sin(radians(28.0)) * cos(radians(lat)) * cos(radians(lon - 84.0))), 4) AS y FROM c""")
def projection_forward(spark, d):
    x, y = P.forward(F.col("lon"), F.col("lat"), 84.0, 28.0)
    return rounded(catalogue(spark, d).select("event_id", x.alias("x"), y.alias("y")), 4)


MAGS = """m AS (SELECT event_id // 3 AS event_id, CASE event_id % 4 WHEN 0 THEN 'gcmt' WHEN 1 THEN 'isc' WHEN 2 THEN 'usgs-comcat' ELSE 'other' END AS source,
  CASE event_id % 7 WHEN 0 THEN 'mww' WHEN 1 THEN 'mb' WHEN 2 THEN 'ms' WHEN 3 THEN 'ml' WHEN 4 THEN 'ml' ELSE 'xx' END AS kind, mag + 1 AS mag, event_id % 3 = 1 AS preferred FROM seis)"""


@query(f""", {MAGS},
k AS (SELECT event_id, coalesce(nullif(list_position(['gcmt', 'isc-gem', 'isc', 'usgs-comcat'], source), 0), 99) AS a, list_position(['mww', 'mwc', 'mwb', 'mwr', 'mw'], kind) AS b, kind, mag, preferred,
  round(CASE WHEN kind = 'mb' AND mag BETWEEN 3.5 AND 6.2 THEN 0.85 * mag + 1.03 WHEN kind = 'ms' AND mag BETWEEN 3.0 AND 6.1 THEN 0.67 * mag + 2.07 WHEN kind = 'ms' AND mag BETWEEN 6.2 AND 8.2 THEN 0.99 * mag + 0.08 END, 2) AS v FROM m),
r AS (SELECT event_id, CASE WHEN b > 0 THEN 1 WHEN v IS NOT NULL THEN 2 WHEN kind = 'ml' AND preferred THEN 3 END AS step, kind, a, CASE WHEN b > 0 THEN b WHEN kind = 'ms' THEN 1 ELSE 2 END AS b, CASE WHEN b > 0 OR v IS NULL THEN mag ELSE v END AS mw FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY step NULLS LAST, a, b, mw) AS n FROM r)
SELECT event_id, round(CASE WHEN step IS NOT NULL THEN mw END, 6) AS mw, CASE step WHEN 1 THEN 'moment' WHEN 2 THEN 'converted' WHEN 3 THEN 'assumed' ELSE 'none' END AS how, CASE WHEN step IS NOT NULL THEN kind END AS kind FROM o WHERE n = 1""")
def preferred_mw(spark, d):
    i = F.col("event_id")
    source = F.element_at(F.array(*map(F.lit, ("gcmt", "isc", "usgs-comcat", "other"))), (i % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("mww", "mb", "ms", "ml", "ml", "xx", "xx"))), (i % 7 + 1).cast("int"))
    rows = catalogue(spark, d).select(F.floor(i / 3).cast("long").alias("event_id"), source.alias("source"), kind.alias("kind"), (F.col("mag") + 1).alias("mag"), (i % 3 == 1).alias("preferred"))
    return rounded(H.preferred_mw(rows, True))


@query()
def merged_catalogue(spark, d):
    events = catalogue(spark, d)
    clusters = Q.associate(events, GAP, 100.0)
    return H.merge_clusters(events.join(clusters, "event_id"), ["depth_km", "event_id"])


@query("""
, g AS (SELECT *, event_id // 3 AS cluster, row_number() OVER (PARTITION BY event_id // 3 ORDER BY depth_km, event_id) AS r FROM seis),
f AS (SELECT * FROM g WHERE r = 1)
SELECT 'merged-' || substr(sha1(f.lane || ':' || f.event_id), 1, 12) AS id, f.t_us, f.lat, f.lon, f.depth_km, f.mag,
  coalesce(first(g.etype ORDER BY g.r) FILTER (g.etype <> 'earthquake'), 'earthquake') AS etype, CASE WHEN count(g.avail_us) = count(*) THEN max(g.avail_us) END AS avail_us,
  list(g.event_id ORDER BY g.r) AS ids, count(DISTINCT g.lane) AS n_lanes, count(DISTINCT g.mag) FILTER (g.mag <> f.mag) AS n_other
FROM f JOIN g USING (cluster) GROUP BY f.lane, f.event_id, f.t_us, f.lat, f.lon, f.depth_km, f.mag""")
def merged_members(spark, d):
    members = catalogue(spark, d).withColumn("cluster", F.floor(F.col("event_id") / 3).cast("long"))
    merged = H.merge_clusters(members, ["depth_km", "event_id"])
    return merged.withColumns({"n_lanes": F.size("lanes").cast("long"), "n_other": F.size("other_mags").cast("long")}).drop("lanes", "other_mags")


@query(f"""
, g AS (SELECT c.cell_ix, c.lon0, c.lat0, count(p.event_id) / 30.0 AS rate FROM cells c LEFT JOIN placed p ON p.cell_ix = c.cell_ix AND mag >= 4.5 GROUP BY ALL),
u AS MATERIALIZED (SELECT g.*, range AS catalogue, {uniform_sql(11, 'range', 'cell_ix', '450')} AS u FROM g, range(100)),
k AS (SELECT rate, range AS k, sum(exp(-rate + CASE WHEN rate > 0 THEN range * ln(rate) WHEN range = 0 THEN 0 ELSE -1e9 END - lgamma(range + 1))) OVER (PARTITION BY rate ORDER BY range) AS upto FROM (SELECT DISTINCT rate FROM g), range(100)),
n AS (SELECT u.catalogue, u.cell_ix, lon0, lat0, count(k.k) AS n FROM u LEFT JOIN k ON k.rate = u.rate AND k.upto < u.u GROUP BY ALL),
e AS MATERIALIZED (SELECT catalogue, cell_ix, lon0, lat0, unnest(range(1, n + 1)) AS k FROM n),
d AS (SELECT *, {", ".join(f"{uniform_sql(11 + i, 'catalogue', 'cell_ix', '450', 'k')} AS u{i}" for i in (1, 2, 3))} FROM e)
SELECT catalogue, cell_ix, k, round(lon0 + 0.5 * u1, 6) AS lon, round(lat0 + 0.5 * u2, 6) AS lat, round(4.5 - ln(1 - u3 * (1 - exp(-0.9 * ln(10) * 3.0))) / (0.9 * ln(10)), 6) AS mag, CAST(0.01 AS DOUBLE) AS rate FROM d""")
def stochastic_event_set(spark, d):
    rates = G.lattice(spark).join(G.dense_counts(C.at_least(catalogue(spark, d), 4.5)), "cell_ix").select("cell_ix", "lon0", "lat0", F.lit(4.5).alias("m0"), (F.col("n") / F.lit(30.0)).alias("rate"))
    return rounded(T.event_set(rates, 100, 1.0, 0.9, 0.5, 3.0, 11))


@query(f"""{MOLCHAN}, b AS (SELECT sum(mass) OVER (ORDER BY alarm DESC ROWS UNBOUNDED PRECEDING) / sum(mass) OVER () AS high, mass / sum(mass) OVER () AS own FROM g),
u AS MATERIALIZED (SELECT s.range AS sim, {uniform_sql(5, 's.range', 'k.range')} AS u FROM range(200) s, range(1, 51) k)
SELECT sim, round(avg(1.0 - high + own / 2), 6) AS area FROM u JOIN b ON u > high - own AND u <= high GROUP BY 1""")
def area_skill_null(spark, d):
    return rounded(T.area_skill_null(K.molchan_groups(_alarm_cells(spark, d)), 50, 200, 5))


@query()
def aftershock_cascades(spark, d):
    parents = C.at_least(catalogue(spark, d), 4.0).select("event_id", F.lit(0.0).alias("t_days"), "mag")
    return T.cascade(spark, parents, 50, 0.02, 1.0, 0.01, 1.2, 1.0, 4.0, 30.0, None, 9)


@query(f"""{MOLCHAN}, h AS (SELECT alarm, tau, CAST(round((1 - miss) * (SELECT sum(hits) FROM g), 0) AS BIGINT) AS k, (SELECT CAST(sum(hits) AS BIGINT) FROM g) AS n FROM t),
b AS (SELECT alarm, tau, k, CASE WHEN k <= 0 OR tau >= 1 THEN 1 ELSE least(1, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(tau) + (n - j) * ln(1 - tau))) FILTER (j >= k)) END AS p
  FROM (SELECT *, unnest(range(0, n + 1)) AS j FROM (SELECT * REPLACE (CASE WHEN tau >= 1 THEN 1 ELSE tau END AS tau) FROM h) WHERE tau < 1) GROUP BY alarm, tau, k)
SELECT alarm, round(tau, 6) AS tau, round(p, 6) AS p FROM b UNION ALL SELECT alarm, round(tau, 6), 1.0 FROM h WHERE tau >= 1""")
def trajectory_p_values(spark, d):
    t = K.molchan_trajectory(K.molchan_groups(_alarm_cells(spark, d)))
    n = _alarm_cells(spark, d).agg(F.sum("n").alias("total"))
    hits = F.round((F.lit(1.0) - F.col("miss")) * F.col("total")).cast("long")
    return rounded(t.crossJoin(F.broadcast(n)).select("alarm", "tau", tails.binomial_sf(hits, F.col("total"), F.col("tau")).alias("p")))


@query("""
SELECT l_suppkey AS key, count(*) AS n, round(max(l_extendedprice), 2) AS largest, round(sum(l_quantity), 2) AS quantity
FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1""", helpers=False)
def grouped_lineitems(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return rows.groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("largest"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
