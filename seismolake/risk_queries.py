"""Registered queries of losses, kernels, vintages and texts, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue_queries import CUT, RING, START, STATES, YEARS, _ratio, _years, query, rounded
from .functions import kernels as E
from .functions import texts as T
from .functions.shared_draws import uniform_sql
from .operators import catalogue as C
from .operators import event_based as B
from .operators import risk as R
from .operators import vintages as V
from .sources.events import DAY_US, catalogue, table


@query("""
SELECT event_id, round(0.1 / 0.01 * pow(1 + greatest(mag, 1e-6) / 0.01, -1.1), 9) AS density, round(1 - pow(1 + mag / 0.01, -0.1), 9) AS mass, round(0.01 * (pow(1 - (event_id % 97) / 100.0 * (1 - pow(1 + 30 / 0.01, -0.1)), -10) - 1), 6) AS delay,
  round(0.5 / (pi() * 4) * pow(1 + depth_km * depth_km / 4, -1.5), 9) AS area_density, round(1 - pow(1 + depth_km * depth_km / 4, -0.5), 9) AS area_mass, round(2 * sqrt(pow(1 - (event_id % 97) / 100.0, -2) - 1), 6) AS radius,
  round(ln(2.3) - 2.3 * (mag - 2.5), 9) AS log_density FROM seis""")
def kernel_values(spark, d):
    u = (F.col("event_id") % 97) / F.lit(100.0)
    return catalogue(spark, d).select(
        "event_id", F.round(E.omori_density(F.col("mag"), 0.01, 1.1), 9).alias("density"), F.round(E.omori_mass(F.lit(0.0), F.col("mag"), 0.01, 1.1), 9).alias("mass"),
        F.round(E.sample_omori(u, 0.01, 1.1, F.lit(30.0)), 6).alias("delay"), F.round(E.powerlaw_density(F.col("depth_km"), 2.0, 1.5), 9).alias("area_density"),
        F.round(E.powerlaw_mass_within(F.col("depth_km"), 2.0, 1.5), 9).alias("area_mass"), F.round(E.sample_powerlaw_radius(u, 2.0, 1.5), 6).alias("radius"), F.round(E.gr_log_density(F.col("mag"), 2.5, 2.3), 9).alias("log_density"),
    )


@query("SELECT range AS k, round(low * pow(high / low, range / 7.0), 9) AS scale FROM (SELECT min(mag) AS low, max(mag) AS high FROM seis), range(8)")
def geometric_scales(spark, d):
    """From the table's least magnitude to its largest."""
    low, high = catalogue(spark, d).agg(F.min("mag"), F.max("mag")).first()
    return rounded(spark.range(1).select(F.posexplode(E.geometric_scales(low, high, 8)).alias("k", "scale")).select(F.col("k").cast("long").alias("k"), "scale"), 9)


@query("SELECT event_id, round(pow(10, (mag - 4.5 - 2.6) / 0.75), 9) AS days, round(pow(10, -2.44 + 0.59 * mag), 6) AS length_km FROM seis")
def influence_and_length(spark, d):
    return catalogue(spark, d).select("event_id", F.round(E.influence_days(F.col("mag"), 2.6), 9).alias("days"), F.round(E.fault_length_km(F.col("mag")), 6).alias("length_km"))


@query("""
SELECT event_id, CASE WHEN s % 86400 = 0 THEN s // 86400 || 'd' WHEN s % 3600 = 0 THEN s // 3600 || 'h' ELSE s || 's' END AS horizon,
  'etas_' || lane || '_' || strftime(make_timestamp(t_us), '%Y%m%dT%H%M%SZ') || '_' || CASE WHEN s % 86400 = 0 THEN s // 86400 || 'd' WHEN s % 3600 = 0 THEN s // 3600 || 'h' ELSE s || 's' END AS id,
  sha256('lane=''' || lane || '''' || chr(10) || 'm=' || round(mag, 2) || chr(10) || 's=' || s) AS snapshot FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 86400 * (1 + event_id % 30) WHEN 1 THEN 3600 * (1 + event_id % 23) ELSE 61 END AS s FROM seis)""")
def forecast_ids(spark, d):
    i = F.col("event_id")
    s = F.when(i % 3 == 0, 86400 * (1 + i % 30)).when(i % 3 == 1, 3600 * (1 + i % 23)).otherwise(61)
    rows = catalogue(spark, d).withColumn("s", s)
    ids = T.grid_id(F.lit("etas"), F.col("lane"), F.col("t_us"), F.col("s"))
    return rows.select("event_id", T.format_horizon(F.col("s")).alias("horizon"), ids.alias("id"), T.snapshot_hash({"s": F.col("s"), "lane": F.col("lane"), "m": F.round("mag", 2)}).alias("snapshot"))


@query("""
, t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'pga' WHEN 1 THEN ' PGV ' WHEN 2 THEN 'SA(0.' || event_id % 40 || ')' WHEN 3 THEN 'sa(' || event_id % 9 || ')' WHEN 4 THEN 'SA(-1)' WHEN 5 THEN 'MMI' ELSE '0.' || event_id % 10 END AS token FROM seis)
SELECT event_id, token, CASE WHEN upper(trim(token)) IN ('PGA', 'PGV') THEN upper(trim(token)) WHEN try_cast(regexp_extract(upper(trim(token)), '^SA\\(([0-9]*\\.?[0-9]+)\\)$', 1) AS DOUBLE) > 0 THEN 'SA' END AS kind,
  CASE WHEN try_cast(regexp_extract(upper(trim(token)), '^SA\\(([0-9]*\\.?[0-9]+)\\)$', 1) AS DOUBLE) > 0 THEN try_cast(regexp_extract(upper(trim(token)), '^SA\\(([0-9]*\\.?[0-9]+)\\)$', 1) AS DOUBLE) END AS period FROM t""")
def imt_tokens(spark, d):
    """Tokens of seven forms, by event."""
    i = F.col("event_id")
    text = lambda low, k, high="": F.concat(F.lit(low), (i % k).cast("string"), F.lit(high))
    forms = [F.lit("pga"), F.lit(" PGV "), text("SA(0.", 40, ")"), text("sa(", 9, ")"), F.lit("SA(-1)"), F.lit("MMI"), text("0.", 10)]
    rows = catalogue(spark, d).select("event_id", F.get(F.array(*forms), (i % 7).cast("int")).alias("token"))
    return rows.withColumn("i", T.parse_imt(F.col("token"))).select("event_id", "token", "i.kind", "i.period")


@query(f"SELECT event_id, len(generate_series(date_trunc('month', make_timestamp(t_us - {40 * DAY_US})), date_trunc('month', make_timestamp(t_us + event_id % 90 * {DAY_US} - 1)), INTERVAL 1 MONTH)) AS months FROM seis")
def months_touched(spark, d):
    months = T.months_touched(F.col("t_us") - 40 * DAY_US, F.col("t_us") + F.col("event_id") % 90 * DAY_US)
    return catalogue(spark, d).select("event_id", F.size(months).cast("long").alias("months"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(mag, 6) END AS mw, CASE WHEN event_id % 3 = 0 THEN 'identity:mww' END AS route, lon BETWEEN 81 AND 86 AND lat BETWEEN 27 AND 29 AS inside FROM seis")
def identity_and_bbox(spark, d):
    rows = catalogue(spark, d).withColumn("m", T.identity_mw(F.when(F.col("event_id") % 3 == 0, "Mww").otherwise("mb"), F.col("mag")))
    return rows.select("event_id", F.round("m.mw", 6).alias("mw"), "m.route", T.in_bbox(F.col("lon"), F.col("lat"), (81.0, 27.0, 86.0, 29.0)).alias("inside"))




@query("""
, b AS (SELECT lane, round(min(lon), 2) AS west, round(min(lat), 2) AS south, round(max(lon), 2) AS east, round(max(lat), 2) AS north FROM seis GROUP BY 1)
SELECT lane, 'POLYGON((' || west || ' ' || south || ', ' || east || ' ' || south || ', ' || east || ' ' || north || ', ' || west || ' ' || north || ', ' || west || ' ' || south || '))' AS wkt, west, south, east, north FROM b""")
def region_outline(spark, d):
    """The outline of each lane's events to text and back."""
    b = catalogue(spark, d).groupBy("lane").agg(*(F.round(f(c), 2).alias(n) for f, c, n in ((F.min, "lon", "w"), (F.min, "lat", "s"), (F.max, "lon", "e"), (F.max, "lat", "n"))))
    ring = T.wkt_ring(T.region_wkt(F.array(*(F.array(F.col(x), F.col(y)) for x, y in ("ws", "es", "en", "wn")))))
    box = T.bbox(F.col("ring"))
    return b.withColumn("ring", ring).select("lane", T.region_wkt(F.col("ring")).alias("wkt"), *(F.get(box, k).alias(n) for k, n in enumerate(("west", "south", "east", "north"))))


OBSERVED = f"""o AS (SELECT event_id, event_id // 5 AS site, t_us AS valid_us, CASE event_id % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'rapid' ELSE 'ultra' END AS product, CASE WHEN event_id % 7 = 0 THEN t_us + {3 * DAY_US} END AS published_us FROM seis),
a AS (SELECT *, coalesce(published_us, valid_us + CASE product WHEN 'final' THEN 14 WHEN 'rapid' THEN 1 END * {DAY_US}) AS available_us FROM o)"""


def _observed(spark, d) -> DataFrame:
    i = F.col("event_id")
    product = F.when(i % 3 == 0, "final").when(i % 3 == 1, "rapid").otherwise("ultra")
    rows = catalogue(spark, d).select("event_id", F.floor(i / 5).cast("long").alias("site"), F.col("t_us").alias("valid_us"), product.alias("product"), F.when(i % 7 == 0, F.col("t_us") + 3 * DAY_US).alias("published_us"))
    return V.stamped(rows)


@query(f", {OBSERVED} SELECT event_id, available_us FROM a")
def observation_stamps(spark, d):
    return _observed(spark, d).select("event_id", "available_us")


@query(f", {OBSERVED} SELECT site, event_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY available_us DESC, product DESC) AS r FROM a WHERE available_us < {CUT}) WHERE r = 1")
def latest_observations(spark, d):
    return V.latest_as_of(_observed(spark, d), ["site"], CUT).select("site", "event_id")


@query(f""", {OBSERVED}, l AS (SELECT list_sort(list(available_us - valid_us)) AS v FROM a WHERE available_us IS NOT NULL)
SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM a WHERE available_us < {CUT}) AS n_available, (SELECT count(*) FROM a WHERE available_us >= {CUT}) AS n_later,
  v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] / 8.64e10 AS median_days, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT) + 1] / 8.64e10 AS p90_days, v[len(v)] / 8.64e10 AS max_days FROM l""")
def observation_vintage(spark, d):
    return V.summary(_observed(spark, d), CUT)


@query(f"""
, c AS (SELECT DISTINCT t_us // {3 * DAY_US} * {3 * DAY_US} AS cutoff_us FROM seis)
SELECT cutoff_us, CASE WHEN cutoff_us // {3 * DAY_US} % 5 = 0 THEN 'already-fitted' WHEN cutoff_us > {START + 24 * DAY_US} THEN 'not-yet-due' WHEN cutoff_us > {START + 12 * DAY_US} THEN 'beyond-coverage' ELSE 'planned' END AS outcome FROM c""")
def refit_plan(spark, d):
    """Cut-offs every three days that have events; each fifth is fitted."""
    cutoffs = catalogue(spark, d).select((F.floor(F.col("t_us") / (3 * DAY_US)) * F.lit(3 * DAY_US)).alias("cutoff_us")).distinct()
    return V.refit_plan(cutoffs, cutoffs.filter(F.floor(F.col("cutoff_us") / (3 * DAY_US)) % 5 == 0), START + 24 * DAY_US, START + 12 * DAY_US)


@query(f"""
, i AS (SELECT DISTINCT t_us // {DAY_US} * {DAY_US} AS issue_us FROM seis), c AS (SELECT DISTINCT t_us // {3 * DAY_US} * {3 * DAY_US} AS cutoff_us FROM seis)
SELECT issue_us, max(cutoff_us) AS cutoff_us FROM i LEFT JOIN c ON cutoff_us <= issue_us GROUP BY 1""")
def scheduled_cutoffs(spark, d):
    """Issues on the days that have events, cut-offs every three days that do."""
    days = lambda n, name: catalogue(spark, d).select((F.floor(F.col("t_us") / (n * DAY_US)) * F.lit(n * DAY_US)).alias(name)).distinct()
    return V.last_cutoff(days(1, "issue_us"), days(3, "cutoff_us"))


@query(f"{YEARS} SELECT round(avg(loss), 4) AS aal FROM y")
def average_annual_loss(spark, d):
    return rounded(R.average_annual_loss(_years(spark, d)), 4)


@query(f"""{YEARS}, r AS (SELECT i.range AS replicate, avg(loss) AS m FROM range(100) i, range(1000) k JOIN y ON y.catalogue = least(999, CAST(floor({uniform_sql(3, 'i.range', 'k.range')} * 1000) AS BIGINT)) GROUP BY 1)
SELECT round((SELECT avg(loss) FROM y), 4) AS mean, round(quantile_cont(m, 0.05), 4) AS low, round(quantile_cont(m, 0.95), 4) AS high FROM r""")
def bootstrap_money(spark, d):
    return rounded(R.bootstrap_money(_years(spark, d), 100, 3), 4)


@query("""
, t AS (SELECT o_orderkey, l_linenumber, l_extendedprice AS loss, sum(l_extendedprice) OVER (PARTITION BY o_orderkey) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey AS event_id, l_linenumber AS asset_id, round(loss * (total - least(greatest(total - 50000, 0), 100000)) / total, 4) AS loss FROM t""")
def layered_asset_losses(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(R.scaled_by_layer(rows.select(F.col("o_orderkey").alias("event_id"), F.col("l_linenumber").alias("asset_id"), F.col("l_extendedprice").alias("loss")), 5e4, 1e5), 4)


COMPONENTS = [("masonry", "walls", 0.6), ("masonry", "roof", 0.4), ("steel", "frame", 0.7), ("steel", "cladding", 0.2)]


@query("""
, k AS (SELECT lane || event_id % 3 AS lane, etype, count(*) AS n FROM seis GROUP BY ALL),
c AS (SELECT lane, etype, CASE WHEN etype = 'landslide' THEN CAST(0.9 AS DOUBLE) ELSE 1.0 END * n / sum(n) OVER (PARTITION BY lane) AS share FROM k)
SELECT lane AS taxonomy, round(sum(share), 6) AS total FROM c GROUP BY 1 HAVING abs(sum(share) - 1) > 1e-9""")
def component_share_problems(spark, d):
    """Types of events as components of lanes; landslides' shares are a tenth short."""
    rows = catalogue(spark, d).select(F.concat("lane", (F.col("event_id") % 3).cast("string")).alias("taxonomy"), F.col("etype").alias("component"))
    counts = rows.groupBy("taxonomy", "component").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("taxonomy").alias("of")).agg(F.sum("n").alias("total"))
    share = F.when(F.col("component") == "landslide", 0.9).otherwise(1.0) * F.col("n") / F.col("total")
    return rounded(R.bad_shares(counts.join(totals, F.col("taxonomy") == F.col("of")).select("taxonomy", "component", share.alias("share"))))


@query(f"""
, f AS (SELECT event_id % 20 AS realisation, cell_ix AS site_id, 0.05 + mag - 2.5 AS im FROM placed WHERE mag >= 4.5 AND cell_ix >= 0),
a AS (SELECT cell_ix AS site_id, CASE WHEN cell_ix % 2 = 0 THEN 'masonry' ELSE 'steel' END AS taxonomy, 1000.0 + cell_ix AS value FROM cells),
c AS (SELECT * FROM (VALUES {", ".join(map(str, COMPONENTS))}) v(taxonomy, component, share))
SELECT realisation, component, round(sum(value * share * ({_ratio("im")})), 3) AS loss FROM f JOIN a USING (site_id) JOIN c USING (taxonomy) GROUP BY ALL""")
def component_losses(spark, d):
    from .operators import grids as G

    shaken = G.located(C.at_least(catalogue(spark, d), 4.5)).filter("cell_ix >= 0").select((F.col("event_id") % 20).alias("realisation"), F.col("cell_ix").alias("site_id"), (F.lit(0.05) + F.col("mag") - F.lit(2.5)).alias("im"))
    kind = F.when(F.col("cell_ix") % 2 == 0, "masonry").otherwise("steel")
    assets = G.lattice(spark).select(F.col("cell_ix").alias("asset_id"), F.col("cell_ix").alias("site_id"), kind.alias("taxonomy"), (F.lit(1000.0) + F.col("cell_ix")).alias("value"))
    states = F.array(*(F.struct(F.lit(m).alias("median"), F.lit(b).alias("beta"), F.lit(r).alias("ratio")) for m, b, r in STATES))
    components = spark.createDataFrame(COMPONENTS, "taxonomy string, component string, share double").withColumn("states", states)
    return rounded(R.component_losses(assets, components, shaken), 3)


@query("SELECT s_suppkey AS asset_id, round(abs(s_acctbal) * 1000 * 2500 * 0.7, 2) AS low, round(abs(s_acctbal) * 1000 * 2500, 2) AS best, round(abs(s_acctbal) * 1000 * 2500 * 1.4, 2) AS high FROM supplier", helpers=False)
def capacity_values(spark, d):
    plants = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.abs("s_acctbal").cast("double").alias("capacity_mw"))
    return rounded(R.capacity_value(plants, 2500.0, 0.7, 1.4), 2)


@query("""
, r AS (SELECT CASE WHEN event_id % 11 = 0 THEN 1 ELSE event_id END AS asset_id, CASE WHEN event_id % 5 > 0 THEN lon + (event_id % 13) * 12 END AS lon, lat, mag - 3 AS value FROM seis),
c AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS k FROM r),
p AS (SELECT asset_id, list_filter([CASE WHEN lon IS NULL THEN 'no lon' END, CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'off the globe' END, CASE WHEN value < 0 THEN 'value below 0' END, CASE WHEN k > 1 THEN 'id comes twice' END], lambda x: x IS NOT NULL) AS x FROM c)
SELECT asset_id, array_to_string(x, '; ') AS problems FROM p WHERE len(x) > 0""")
def exposure_problems(spark, d):
    i = F.col("event_id")
    rows = catalogue(spark, d).select(F.when(i % 11 == 0, F.lit(1)).otherwise(i).alias("asset_id"), F.when(i % 5 > 0, F.col("lon") + (i % 13) * 12).alias("lon"), "lat", (F.col("mag") - 3).alias("value"))
    return R.import_problems(rows, ["asset_id", "lon", "lat", "value"])


SITES = [(0, 84.0, 27.5), (1, 86.2, 28.8), (2, 81.5, 29.9), (3, 88.0, 26.3)]
KM = "sqrt(pow(2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(s_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(s_lat)) * pow(sin(radians(s_lon - lon) / 2), 2)))), 2) + pow(depth_km, 2))"


def _clip(a: str, b: str) -> str:
    return f"greatest(-3, least(3, sqrt(-2 * ln({a})) * cos(6.283185307179586 * {b})))"


SHAKEN = f"""
, e AS (SELECT event_id, lon, lat, depth_km, mag, event_id % 50 AS catalogue FROM seis WHERE mag >= 4),
s AS (SELECT * FROM (VALUES {", ".join(map(str, SITES))}) v(site_id, s_lon, s_lat)),
k AS (SELECT *, {KM} AS km FROM e, s),
f AS (SELECT *, exp(-3.5 + 0.9 * mag - 1.2 * ln(km + 10) + 0.3 * {_clip(uniform_sql(5, 'event_id'), uniform_sql(6, 'event_id'))} + 0.5 * {_clip(uniform_sql(7, 'event_id', 'site_id'), uniform_sql(8, 'event_id', 'site_id'))}) AS im FROM k WHERE km <= 300),
l AS (SELECT event_id, catalogue, site_id, km, im, (1000.0 + site_id) * ({_ratio("im")}) AS loss FROM f)"""


def _shaken(spark, d) -> DataFrame:
    events = C.at_least(catalogue(spark, d), 4.0).select("event_id", "lon", "lat", "depth_km", "mag")
    sites = spark.createDataFrame(SITES, "site_id long, s_lon double, s_lat double")
    mean = lambda mag, km: F.lit(-3.5) + F.lit(0.9) * mag - F.lit(1.2) * F.log(km + F.lit(10.0))
    shaken = B.fields(events, sites, mean, 0.3, 0.5, 3.0, 5, 300.0)
    return B.asset_losses(shaken, sites.select(F.col("site_id").alias("asset_id"), "site_id", (F.lit(1000.0) + F.col("site_id")).alias("value")), STATES)


@query(f"{SHAKEN} SELECT event_id, site_id AS asset_id, round(km, 4) AS hypocentral_km, round(im, 6) AS im, round(loss, 4) AS loss FROM l")
def ground_motion_losses(spark, d):
    rows = _shaken(spark, d)
    return rows.select("event_id", "asset_id", F.round("hypocentral_km", 4).alias("hypocentral_km"), F.round("im", 6).alias("im"), F.round("loss", 4).alias("loss"))


def _annual_sql(loss: str) -> str:
    return f"SELECT c.range AS catalogue, coalesce(sum({loss}), 0) / 2.0 AS loss FROM range(50) c LEFT JOIN l ON l.catalogue = c.range GROUP BY 1"


def _of_event():
    return (F.col("event_id") % 50).alias("catalogue")


def _fifty(spark) -> DataFrame:
    return spark.range(50).withColumnRenamed("id", "catalogue")


def _annual(spark, losses: DataFrame) -> DataFrame:
    return B.annual(losses, losses.select("event_id", _of_event()).distinct(), _fifty(spark), 2.0)


@query(f"{SHAKEN}, y AS ({_annual_sql('loss')}) SELECT catalogue, round(loss, 4) AS loss FROM y")
def event_based_losses(spark, d):
    return rounded(_annual(spark, _shaken(spark, d)), 4)


@query(f"""{SHAKEN}, y AS ({_annual_sql('loss')}), w AS ({_annual_sql('loss * CASE WHEN im >= 0.05 AND km / 3.5 - 8 > 0 THEN 0.6 ELSE 1 END')})
SELECT round(avg(y.loss - w.loss), 4) AS mean, avg(CAST(y.loss - w.loss < 0 AS INT)) AS negative_share FROM y JOIN w USING (catalogue)""")
def avoided_loss(spark, d):
    """What a shutdown on warning saves, catalogue by catalogue with the same draws."""
    losses = B.with_shutdown(_shaken(spark, d).withColumn("full", F.col("loss")), 0.05, 3.5, 8.0, 0.6).select("event_id", F.col("full").alias("loss"), F.col("loss").alias("other"))
    both = B.annual_branches(losses, losses.select("event_id", _of_event()).distinct(), _fifty(spark), 2.0)
    return R.differences(both).select(F.round("mean", 4).alias("mean"), "negative_share")
