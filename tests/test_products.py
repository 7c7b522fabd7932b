"""Readers of products against small files."""

import json

import pytest
from pyspark.sql import functions as F

from seismolake.sources import products as R


def test_shaking_grid(spark, tmp_path):
    (tmp_path / "grid.xml").write_text("""<?xml version="1.0"?>
<shakemap_grid event_id="us1" code_version="4"><event event_id="us1" magnitude="7.8" lat="28"/>
<grid_field index="1" name="LON" units="dd"/><grid_field index="2" name="LAT" units="dd"/><grid_field index="3" name="PGV" units="cm/s"/>
<grid_data>
84.0 28.0 10.5
84.1 28.0 11.5
84.2 28.0
</grid_data></shakemap_grid>""")
    rows = R.read_shaking_grid(spark, str(tmp_path / "grid.xml")).orderBy("lon").collect()
    assert [(r.event, r.magnitude, r.lon, r.values["pgv"]) for r in rows] == [("us1", 7.8, 84.0, 10.5), ("us1", 7.8, 84.1, 11.5)]


def test_slices_are_complete_grids(spark, tmp_path):
    (tmp_path / "s.csv").write_text("lon,lat,pga,pgv\n1,1,0.1,2\n2,1,x,3\n1,2,0.3,4\n2,2,0.4,5\n")
    rows = R.read_slice(spark, str(tmp_path / "s.csv"), ["pga", "pgv"])
    assert R.incomplete(rows).count() == 0 and R.incomplete(rows.filter("pgv < 5")).count() == 1 and rows.filter("pga IS NULL").count() == 1
    with pytest.raises(ValueError):
        R.read_slice(spark, str(tmp_path / "s.csv"), ["vs30"])


def test_exposure_tables(spark, tmp_path):
    rows = spark.createDataFrame([("np", 5.0, 2), ("np", 7.0, 1), ("cl", 1.0, 9)], "ID_0 string, Total_Repl double, pop int")
    got = R.portfolio(R.resolved(rows, {"country": ["id_0"], "value": ["total_repl"], "people": ["pop"]}), ["country"])
    assert {(r.country, r.assets, r.value, r.people) for r in got.collect()} == {("np", 2, 12.0, 3.0), ("cl", 1, 1.0, 9.0)}
    with pytest.raises(ValueError):
        R.resolved(rows, {"lon": ["x"]})
    feature = lambda i, c: {"type": "Feature", "properties": {"id": i, "kind": "dam", "capacity_mw": c}, "geometry": {"type": "Point", "coordinates": [84.0, 28.0]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("a", {"best": 5.0}), feature("b", {"low": 2.0, "high": 4.0}), feature("c", None)]}))
    assert {r.asset_id: r.capacity_mw for r in R.read_assets(spark, str(tmp_path / "a.json")).collect()} == {"a": 5.0, "b": 3.0, "c": None}


def test_coefficients_and_verification(spark, tmp_path):
    (tmp_path / "c.txt").write_text("IMT c1 c2\nPGA 1.5 -2\n0.3  0.1 x\n")
    got = {(r.imt, r.coefficient): r.value for r in R.read_coefficients(spark, str(tmp_path / "c.txt")).collect()}
    assert got == {("PGA", "c1"): 1.5, ("PGA", "c2"): -2.0, ("0.3", "c1"): 0.1, ("0.3", "c2"): None}
    (tmp_path / "v.csv").write_text("rup_mag,dist_rjb,result_type,damping,pga,0.2\n6,10,MEAN,5,0.1,0.2\n7,10,MEAN,5,0.3,0.4\n")
    table = R.read_verification(spark, str(tmp_path / "v.csv"))
    assert {(r.kind, r.period, r.expected, r.inputs["rup_mag"]) for r in table.collect()} == {("PGA", None, 0.1, 6.0), ("SA", 0.2, 0.2, 6.0), ("PGA", None, 0.3, 7.0), ("SA", 0.2, 0.4, 7.0)}
    computed = table.select("case", "kind", "period", F.when(F.col("expected") == 0.3, 0.31).otherwise(F.col("expected")).alias("value"))
    assert [r.expected for r in R.off_table(computed, table).collect()] == [0.3]


def test_assessments(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"event_id": "1", "source_type": "landslide", "assessed_us": 5}\n{"event_id": "1", "source_type": "earthquake", "assessed_us": 9}\nnot json\n{"event_id": "2"}\n')
    good, bad = R.read_assessments(spark, str(tmp_path / "x.json"))
    assert good.count() == 2 and bad.count() == 2
    events = spark.createDataFrame([(1, "earthquake"), (3, "explosion")], "event_id long, etype string")
    assert sorted(map(tuple, R.with_assessments(events, good, 8).collect())) == [(1, "landslide"), (3, "explosion")]


def test_faults_are_clipped_and_measured(spark):
    lines = spark.createDataFrame([(1, [[-1.0, 0.5], [2.0, 0.5]]), (2, [[5.0, 5.0], [6.0, 6.0]]), (3, [[0.2, 0.0], [0.2, 0.4], [0.9, 0.4]])], "line_id long, points array<array<double>>")
    parts = R.clipped_lines(lines, (0.0, 0.0, 1.0, 1.0))
    assert sorted(tuple(round(x, 9) for x in r) for r in parts.select("line_id", "x0", "y0", "x1", "y1").collect()) == [(1, 0.0, 0.5, 1.0, 0.5), (3, 0.2, 0.0, 0.2, 0.4), (3, 0.2, 0.4, 0.9, 0.4)]
    km = {(r.ix, r.iy): r.km for r in R.fault_density(parts.filter("line_id = 1"), 0.5, 0.0, 0.0).collect()}
    assert set(km) == {(0, 1), (1, 1)} and sum(km.values()) == pytest.approx(111.19, rel=1e-3)
