"""F12 of the fourth review: no bound but the sources' own reach takes pairs from the inversion, and no number of rounds ends it early."""

from seismolake import catalogue_queries as Q
from seismolake import model_queries
from seismolake.operators import inversion as I
from seismolake.sources.events import DAY_US


def test_sources_reach_as_far_as_their_faults_say(spark):
    rows = [(1, 0, 0.0, 0.0, 9.5), (2, 0, 0.0, 0.0, 4.0), (3, DAY_US, 30.0, 10.0, 4.0), (4, DAY_US, -179.0, -1.0, 4.0), (5, DAY_US, 0.0, 90.0, 4.0)]
    blocks = I.block_table(spark.createDataFrame(rows, "event_id long, t_us long, lon double, lat double, mag double"), DAY_US, 2 * DAY_US).collect()
    assert sum(len(b.targets) for b in blocks) == 3 and all([s.m for s in b.sources if s.t_us == 0] == [9.5] for b in blocks)


def test_the_query_cuts_nothing(spark, sf_dir, monkeypatch):
    kept, held = [], I.block_table
    monkeypatch.setattr(I, "block_table", lambda *a: kept.append(a[3:]) or held(*a))
    steps = sorted(Q.QUERIES["etas_inversion"](spark, sf_dir).collect())
    assert kept == [(I.ALL_KM,)] and steps[-1].change < I.TOLERANCE
    monkeypatch.setattr(model_queries.I, "invert", lambda *a, **more: (a, more))
    monkeypatch.setattr(model_queries, "rounded", lambda df, digits: df)
    assert Q.QUERIES["etas_inversion"](spark, sf_dir)[1] == {}
