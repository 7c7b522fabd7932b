"""The online posterior equals the batch one after any cut of the stream, with late, repeated and revised rows, and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from seismolake.streaming import posterior as P

DAY = P.DAY_US
SCHEMA = "sequence string, main_us long, main_mag double, event_id string, t_us long, mag double, version long, ts timestamp"


def rows_of(seed: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for s in range(3):
        main_us, main_mag = (10 + s) * DAY + rng.randrange(DAY), 5.5 + s / 2
        for k in range(rng.choice([3, 40])):
            t = main_us + int(6 * DAY * rng.random() ** 3)
            for version in range(rng.choice([1, 1, 2, 3])):
                out.append((f"s{s}", main_us, main_mag, f"{s}-{k}", t, rng.choice([3.0, 3.5, 4.2]), version))
    return out + [r for r in out if rng.random() < 0.1]


@pytest.mark.parametrize("seed", [1, 2])
def test_online_posterior_is_the_batch_posterior(spark, tmp_path, seed):
    rows, rng = rows_of(seed), random.Random(seed)
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[4] + rng.randrange(2 * DAY))  # up to two days late
    timed = lambda part: spark.createDataFrame(part, SCHEMA.rsplit(",", 1)[0]).withColumn("ts", F.timestamp_micros("t_us"))
    law, delays = P.Law(), [0.25, 1.0, 2.0, 5.0]
    cuts = sorted(rng.randrange(len(rows)) for _ in range(5))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)] + [[("end", 60 * DAY, 5.0, "x", 60 * DAY, 3.0, 0)]]

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = P.online(stream, "ts", "3 days", law, delays)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive

    for part in parts:  # each file is a batch, and the query starts anew from its state
        if part:
            timed(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()
    got = {(r.sequence, r.issue_us): tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.sequence, r.issue_us): tuple(r)[2:] for r in P.in_batch(timed(rows), law, delays).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) == 12
    assert {k: v[1:] for k, v in got.items()} == {k: pytest.approx(v[1:], rel=1e-9) for k, v in want.items()}


def test_more_events_raise_the_productivity():
    law = P.Law()
    means = [law.issued(6.0, 1.0, n) for n in (0, 5, 50)]
    assert means[0] < means[1] < means[2] and means[0][0] < law.mean < means[2][0] and all(0 <= m[2] <= 1 for m in means)
