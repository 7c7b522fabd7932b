"""Every catalogue query against its SQL in DuckDB, and identities that SQL doesn't show."""

import datetime
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from seismolake import catalogue_queries as cq
from seismolake import model_queries, risk_queries, scoring_queries  # noqa: F401 - they add to the first one's tables
from seismolake.operators import catalogue as C
from seismolake.operators import grids as G
from seismolake.operators import risk as R
from seismolake.operators import scoring as K
from seismolake.operators import sequences as Q
from seismolake.plans import skew
from seismolake.sources import events as E
from seismolake.streaming import feed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(cq.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = cq.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    if name not in cq.ORACLE:
        assert got
        return
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({cq.ORACLE[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ties_at_one_instant_do_not_see_each_other(spark):
    rows = [(i, t, 3.0 + i) for i, t in enumerate([0, 1, 1, 1, 2])]
    df = spark.createDataFrame(rows, "event_id long, t_us long, mag double")
    assert {r.event_id: r.n for r in Q.rolling_count(df, 10).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.event_id: r.since_us for r in Q.time_since_previous(df).collect()} == {0: None, 1: 1, 2: 1, 3: 1, 4: 1}


def test_features_do_not_change_with_later_rows(spark, sf_dir):
    whole = E.catalogue(spark, sf_dir)
    a = {r.event_id: r for r in Q.causal_features(C.before(whole, cq.CUT)).collect()}
    b = {r.event_id: r for r in Q.causal_features(whole).collect()}
    assert a and all(b[i] == r for i, r in a.items())


def test_leaks_are_refused(spark, sf_dir):
    events = E.catalogue(spark, sf_dir)
    assert C.refuse_after(C.before(events, cq.CUT), cq.CUT, "history").count() == C.before(events, cq.CUT).count()
    with pytest.raises(Exception, match="not before the cutoff"):
        C.refuse_after(events, cq.CUT, "history").agg(F.sum("t_us")).collect()
    with pytest.raises(ValueError, match="must end"):
        C.between(events, 5, 5)


def test_area_skill_of_the_reference_itself_is_a_half(spark):
    cells = spark.range(1000).select(F.lit(0.001).alias("mass"), (F.col("id") % 7).alias("n"), F.col("id").alias("alarm"))
    flat = cells.withColumn("alarm", F.lit(1.0))
    assert abs(K.area_skill(K.molchan_trajectory(K.molchan_groups(flat))).first()[0] - 0.5) < 1e-9
    hot = spark.range(1000).select(F.lit(0.001).alias("mass"), (F.col("id") < 10).cast("long").alias("n"), (F.col("id") < 10).cast("double").alias("alarm"))
    assert abs(K.area_skill(K.molchan_trajectory(K.molchan_groups(hot))).first()[0] - 0.995) < 1e-9


def test_association_never_puts_a_lane_twice_into_a_cluster(spark):
    rows = [(1, 0, "a", 0.0, 0.0), (2, 5, "b", 0.0, 0.1), (3, 6, "b", 0.0, 0.1), (4, 7, "c", 50.0, 0.0), (5, 100, "a", 0.0, 0.0), (6, 12, "c", 0.0, 0.0)]
    got = {r.event_id: r.cluster for r in Q.associate(spark.createDataFrame(rows, "event_id long, t_us long, lane string, lat double, lon double"), 16, 100.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3}


def test_damage_states_and_money(spark):
    df = spark.range(1, 60).select((F.col("id") / 10).alias("im"))
    ratios = [r[0] for r in df.select(R.expected_ratio(F.col("im"), cq.STATES)).collect()]
    assert ratios == sorted(ratios) and 0 <= ratios[0] and ratios[-1] <= 1
    assert {r.k: r.n for r in R.largest_remainder(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double"), "k", "w", 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_pool_keeps_the_geometric_mean_of_totals(spark):
    rows = [(m, w, c, r) for m, w, k in (("x", 0.25, 1), ("y", 0.75, 3)) for c, r in enumerate([1.0 * k, 2.0, 3.0 * k])]
    pool = K.geometric_pool(spark.createDataFrame(rows, "model string, weight double, cell_ix int, rate double"), 1e-6)
    assert abs(pool.agg(F.sum("rate")).first()[0] - 6.0**0.25 * 14.0**0.75) < 1e-9


def test_lattice_and_polygon(spark):
    assert G.lattice(spark).count() == 162
    points = spark.createDataFrame([(1, 84.0, 28.0), (2, 80.0, 26.0)], "event_id long, lon double, lat double")
    assert {r.event_id: r.inside for r in G.in_polygon(points, cq.RING).collect()} == {1: True, 2: False}


def test_readers_and_writer(spark, tmp_path):
    feature = {"id": "us1", "properties": {"mag": 5.1, "magType": "Mww", "time": 1000, "updated": 2000, "net": "us", "type": None}, "geometry": {"coordinates": [80.5, 27.1, 10.0]}}
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {"id": "x", "properties": {"time": None}, "geometry": None}]}))
    got = E.read_comcat(spark, str(tmp_path / "c.json")).collect()
    assert [(r.event_id, r.t_us, r.mag_type, r.etype, r.lat) for r in got] == [("us1", 1_000_000, "mww", "earthquake", 27.1)]
    (tmp_path / "i.txt").write_text("#EventID|Time|Latitude|Longitude|Depth\n1|2020-01-01T00:00:01|27.5|85.1|10|A|B|C|D|Mb|4.5|X|Y\n2|bad|1|1|1|A|B|C|D|mb|4|X|Y\n")
    assert [(r.event_id, r.mag, r.mag_type) for r in E.read_fdsn_text(spark, str(tmp_path / "i.txt")).collect()] == [("1", 4.5, "mb")]
    line = "P595 19JUN01 2019.4127 58635 2056 6 -117.6 -2000 0.5 3000 0.25 900 0.75 0.1 0.001 0.002 0.003 0 0 0 35 -117 900"
    (tmp_path / "t.tenv3").write_text(line + "\n")
    r = E.read_tenv3(spark, str(tmp_path / "t.tenv3")).first()
    assert r.site == "P595" and r.day == datetime.date(2019, 6, 1) and r.east_m == -1999.5 and r.up_m == 900.75
    E.write_catalogue(spark.createDataFrame([(1, 5), (2, 400 * E.DAY_US)], "event_id long, t_us long"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("period = 1").count() == 1


def test_streaming_feed(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [("a", base, 1.0, "x"), ("a", base, 1.0, "x"), ("b", base + datetime.timedelta(minutes=3), 2.0, "x"), ("c", base + datetime.timedelta(minutes=12), 5.0, "y")]
    schema = "id string, ts timestamp, value double, lane string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feed.read_feed(spark, str(tmp_path / "in"), schema)
    q = feed.first_versions(stream, "id", "ts", "10 minutes").writeStream.format("memory").queryName("first_versions").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM first_versions").first()[0] == 3
    q = feed.windowed_counts(stream, "ts", "0 seconds", "5 minutes", "lane").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.lane, r.n, r.largest) for r in spark.sql("SELECT * FROM counts").collect()} == {("x", 3, 2.0), ("y", 1, 5.0)}


def km_between(lat1, lon1, lat2, lon2):
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def greedy_association(records, window, km):
    """records (id, lane, keys of (t, lat, lon)), one after the other."""
    clusters, out = [], {}
    for i, lane, keys in sorted(records, key=lambda r: (min(k[0] for k in r[2]), r[1], r[0])):
        first, near = min(k[0] for k in keys), []
        for n, c in enumerate(clusters):
            if c["first"] >= first - window and lane not in c["lanes"]:
                near += [(abs(t - s), n) for held in c["keys"] for t, la, lo in keys for s, y, x in held if abs(t - s) <= window and None not in (la, lo, y, x) and km_between(la, lo, y, x) <= km]
        if not near:
            clusters.append({"first": first, "lanes": set(), "keys": [], "id": i})
        c = clusters[min(near)[1] if near else -1]
        c["lanes"].add(lane)
        c["keys"].append(keys)
        out[i] = c["id"]
    return out


def test_association_without_gaps_runs_in_blocks(spark, monkeypatch):
    rows = [(i, (i * 37 % 4000) * 20, "abcd"[i * 7 % 4], (i * 13 % 29) / 10, (i * 17 % 31) / 10) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, lane string, lat double, lon double")
    want = greedy_association([(i, lane, [(t, lat, lon)]) for i, t, lane, lat, lon in rows], 600, 100)
    sizes, held = [], Q.written

    def seen(d, name):
        out = held(d, name)
        if "cluster" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("block").count().collect())
        return out

    monkeypatch.setattr(Q, "written", seen)
    monkeypatch.setattr(Q, "MOST_PARTS", 1)
    for windows in (1, 12):
        sizes.clear()
        assert {r.event_id: r.cluster for r in Q.associate(df, 600, 100.0, windows).collect()} == want
        assert max(sizes) <= 30 * windows and len(set(want.values())) < 1500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_association_by_either_key_is_brute_force(spark, seed):
    """Records with a reference time and place beside their own: earlier or later, near or far, missing in part; many equal times."""
    rng, rows = random.Random(seed), []
    for i in range(400):
        t, lat, lon = rng.randrange(6000) // 5 * 5, rng.choice([0.0, 0.5, 1.5, 3.0]), rng.random()
        ref = (t + rng.randrange(-90, 91), rng.choice([lat, 0.2, 3.0]), lon) if rng.random() < 0.4 else (None, None, None)
        rows.append((i, t, rng.choice("abcd"), lat if rng.random() < 0.97 else None, lon, *(ref if rng.random() < 0.9 else (ref[0], None, ref[2]))))
    df = spark.createDataFrame(rows, "event_id long, t_us long, lane string, lat double, lon double, ref_t_us long, ref_lat double, ref_lon double")
    both = [(i, lane, [(t, lat, lon)] + ([(u, y, x)] if None not in (u, y, x) else [])) for i, t, lane, lat, lon, u, y, x in rows]
    want = greedy_association(both, 60, 100)
    for windows in (1, 3, 50):
        assert {r.event_id: r.cluster for r in Q.associate(df.repartition(3), 60, 100.0, windows).collect()} == want
    assert len(set(want.values())) < 380


def test_clusters_of_the_whole_table_are_brute_force(spark, sf_dir):
    got = {r.event_id: r.cluster for r in cq.QUERIES["assoc_clusters"](spark, sf_dir).collect()}
    rows = E.catalogue(spark, sf_dir).select("event_id", "lane", "t_us", "lat", "lon").collect()
    assert got == greedy_association([(r.event_id, r.lane, [(r.t_us, r.lat, r.lon)]) for r in rows], cq.GAP, 100)


@pytest.mark.parametrize("hot", [20_000, 5])
def test_completeness_takes_each_triggers_own_time(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "HOT_PART", 10**6)
    rows = [(1, 0, 8.0), (2, 3 * E.DAY_US, 3.0), (3, 40 * E.DAY_US, 4.4), (4, 40 * E.DAY_US + 10_000_000, 3.0), (5, 40 * E.DAY_US + 60_000_000, 2.5)]
    rows += [(10 + i, 60 * E.DAY_US + i * i * 977_777, 2.3 + i * 37 % 61 / 10) for i in range(300)]
    got = {r.event_id: r.mc for r in C.stai_current(spark.createDataFrame(rows, "event_id long, t_us long, mag double"), 2.6).collect()}
    for i, t, _ in rows:
        want = max([2.6, *(min(m, m - 4.5 - 0.75 * math.log10((t - s) / 8.64e10)) for _, s, m in rows if s < t)])
        assert abs(got[i] - want) < 1e-9, i
    assert got[2] > 3.1 and got[4] > 2.8 and got[5] == 2.6


def test_every_point_has_its_nearest_site(spark):
    sites = [(1, 80.1, 26.1), (2, 88.7, 30.3), (3, 84.0, 29.0), (4, 84.0, 29.0), (5, 200.0, -70.0)]
    points = [(i, 80 + i * 37 % 90 / 10, 26 + i * 53 % 45 / 10) for i in range(200)] + [(900, -170.0, 80.0), (901, 81.4, 27.4)]
    got = G.nearest_site(spark.createDataFrame(points, "event_id long, lon double, lat double"), spark.createDataFrame(sites, "site_id long, s_lon double, s_lat double"), 2)
    want = {i: min((round((x - a) ** 2 + (y - b) ** 2, 9), s) for s, a, b in sites)[1] for i, x, y in points}
    assert {r.event_id: r.site_id for r in got.collect()} == want


@pytest.mark.parametrize("spread", [9.0, 0.02])
def test_nearest_sites_are_found_without_a_sort_of_all_candidates(spark, spread):
    """Very many sites and points in few cells, many of them at the same places; the aggregation has no struct, for which Spark would sort every candidate."""
    rng = random.Random(3)
    at = lambda: (80 + rng.randrange(60) / 60 * spread, 26 + rng.randrange(40) / 40 * spread)
    sites, points = [(i, *at()) for i in rng.sample(range(10_000), 300)], [(i, *at()) for i in range(300)] + [(900, -170.0, 80.0), (901, None, 1.0)]
    spark_points, spark_sites = spark.createDataFrame(points, "event_id long, lon double, lat double"), spark.createDataFrame(sites, "site_id long, s_lon double, s_lat double")
    tables, write = [], G.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(G, "written", lambda df, name: (tables.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
        got = {r.event_id: r.site_id for r in G.nearest_site(spark_points, spark_sites, 2).collect()}
    want = {i: min((round((x - a) ** 2 + (y - b) ** 2, 9), s) for s, a, b in sites)[1] for i, x, y in points if x is not None}
    assert got == want and not any("SortAggregate" in plan for plan in tables)


def test_association_pairs_are_brute_force_and_meet_few_candidates(spark):
    """Equal times, windows' edges, both sides of 180 degrees; the join's keys hold place and time."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(60) * 50, rng.choice("abc"), rng.choice([0.0, 0.4, 2.0, 89.5]), rng.choice([179.9, -179.9, -178.0, 10.0]), i // 3) for i in range(240)] + [(999, 10, "a", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, lane string, lat double, lon double, cluster long")
    km = lambda a, b: 2 * 6371.0 * math.asin(min(1, math.sqrt(math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2)))
    want = {(a[0], b[0]): pytest.approx(km(a, b), abs=1e-6) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and a[2] != b[2] and abs(a[1] - b[1]) <= 500 and km(a, b) <= 100}
    pairs = Q.association_pairs(df, 500, 100.0)
    assert {(r.a, r.b): r.km for r in pairs.collect()} == want and pairs.count() == len(want) > 500
    apart = Q.association_pairs(df, 500, 100.0, apart="cluster")
    assert {(r.a, r.b) for r in apart.collect()} == {(a, b) for a, b in want if a // 3 != b // 3}
    join = next(line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "slot_l" in line and "HashJoin" in line)
    assert "row_l" in join and "column_l" in join


@pytest.mark.parametrize("several", [False, True])
def test_a_dense_association_runs_each_block_a_few_times(spark, monkeypatch, several):
    """What blocks hand on never settles here; rounds of all blocks would be as many as there are blocks. Long looks back, many equal times."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(6000) // 4 * 4, rng.choice("abcde"), rng.random() * 9, rng.random() * 9) for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, lane string, lat double, lon double")
    if several:
        df = df.withColumns({"ref_t_us": F.col("t_us"), "ref_lat": F.col("lat"), "ref_lon": F.col("lon")})
    for name, value in (("STRETCH", 16), ("MOST_BACK", 40), ("STEP_ROWS", 1000), ("MOST_PARTS", 2)):
        monkeypatch.setattr(Q, name, value)
    ran, held = [], Q.written

    def seen(d, name):
        out = held(d, name)
        ran.extend([out.count()] if "cluster" in out.columns else [])
        return out

    monkeypatch.setattr(Q, "written", seen)
    want = greedy_association([(i, lane, [(t, lat, lon)]) for i, t, lane, lat, lon in rows], 60, 100)
    assert {r.event_id: r.cluster for r in Q.associate(df, 60, 100.0, 3).collect()} == want
    assert len(ran) < 16 and len(set(want.values())) < 3000
