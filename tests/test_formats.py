"""Readers and stores on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from seismolake.sources import formats as X


def test_ndk(spark, tmp_path):
    lines = [
        "PDE  2005/01/01 01:20:05.4  13.78  -88.78 193.1 5.0 0.0 EL SALVADOR             ",
        "C200501010120A   B:  4    4  40 S: 27   33  50 M:  0    0   0 CMT: 1 TRIHD:  0.6",
        "CENTROID:     -0.3 0.9  13.76 0.06  -89.08 0.09 162.8 12.5 FREE S-20050322125201",
        "23  0.838 0.201 -0.005 0.231 -0.833 0.270  1.050 0.121 -0.369 0.161  0.044 0.240",
        "V10   1.581 56  12  -0.537 23 140  -1.044 24 241   1.312   9 29  142 133 72   66",
    ]
    (tmp_path / "a.ndk").write_text("\n".join(lines * 2) + "\n")
    rows = X.read_ndk(spark, str(tmp_path / "a.ndk")).collect()
    assert len(rows) == 2
    r = rows[0]
    assert r.event_id == "C200501010120A" and (r.lat, r.lon, r.depth_km) == (13.76, -89.08, 162.8) and r.reference_t_us - r.t_us == 300_000
    assert abs(r.moment - 1.312e23) < 1e18 and r.mw == 4.68


def test_isc_gem_curves_fields_and_faults(spark, tmp_path):
    (tmp_path / "g.csv").write_text("# date, lat, lon\n1990-01-02 03:04:05.60, 28.5, 84.1, 1, 2, 3, A, 15, 1, B, 6.61, 0.1, C, x, 123\nbad, 1, 2\n")
    assert [(r.event_id, r.mw, r.q_mw) for r in X.read_isc_gem(spark, str(tmp_path / "g.csv")).collect()] == [("123", 6.61, "C")]
    (tmp_path / "h.csv").write_text("#,generated\nlon,lat,depth,poe-0.005,poe-0.01\n84.0,28.0,0.0,0.5,0.25\n")
    assert sorted((r.level, r.poe) for r in X.read_hazard_curves(spark, str(tmp_path / "h.csv")).collect()) == [(0.005, 0.5), (0.01, 0.25)]
    (tmp_path / "m.csv").write_text("event_id,gmv_PGA,custom_site_id\n3,0.25,s1\n")
    assert tuple(X.read_ground_motions(spark, str(tmp_path / "m.csv")).first()) == (3, "s1", 0.25)
    (tmp_path / "f.fsp").write_text("% header : 1\n  28.0 84.0 1.0 2.0 3.0 0.5 90\n")
    assert X.read_subfaults(spark, str(tmp_path / "f.fsp")).first().slip == 0.5
    line = {"type": "LineString", "coordinates": [[80.0, 27.0], [81.0, 27.0], [81.0, 28.0]]}
    (tmp_path / "t.json").write_text(json.dumps({"features": [{"properties": {"a": "b"}, "geometry": line}]}))
    segments = X.read_fault_traces(spark, str(tmp_path / "t.json"))
    assert segments.count() == 2
    assert abs(X.fault_density(segments, 80.0, 26.0, 0.5).agg(F.sum("km")).first()[0] - (99.08 + 111.19)) < 0.2


def test_names(spark):
    df = spark.createDataFrame([("Mww", "quarry blast"), ("MSZ", "Earthquake"), ("??", None)], "m string, k string")
    assert [tuple(r) for r in df.select(X.magnitude_type(F.col("m")), X.event_kind(F.col("k"))).collect()] == [("mww", "explosion"), ("ms", "earthquake"), ("other", "other")]


def test_stores(spark, tmp_path):
    grid = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.25)], "cell_ix long, bin_ix long, rate double")
    X.save_grid(grid, str(tmp_path / "grids"), "r", "m", "f1")
    assert X.load_grid(spark, str(tmp_path / "grids"), "f1").agg(F.sum("rate")).first()[0] == 0.75
    with pytest.raises(LookupError):
        X.load_grid(spark, str(tmp_path / "grids"), "f2")
    X.log_run(spark, str(tmp_path / "runs"), "fit", "r", {"mc": "3.5"})
    assert spark.read.json(str(tmp_path / "runs")).first().kind == "fit"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"abc")
    (tmp_path / "d" / "b.bin").write_bytes(b"abc")
    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "0"), ("c.bin", "1")], "name string, sha256 string")
    assert {tuple(r) for r in X.verify_files(spark, str(tmp_path / "d"), manifest).collect()} == {("b.bin", "changed"), ("c.bin", "missing")}
