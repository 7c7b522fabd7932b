"""Streaming forms: a live feed deduplicated by record version, and windowed counts with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def first_versions(feed: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each record once, while its copies arrive within `late` of each other."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(feed: DataFrame, time: str, late: str, width: str, key: str) -> DataFrame:
    """Half-open tumbling windows by key: counts and the largest value; rows later than `late` are left out."""
    w = F.window(time, width)
    return feed.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.max("value").alias("largest")).select(F.col("window.start").alias("start"), key, "n", "largest")


def late_rows(feed: DataFrame, time: str, arrived: str, late_seconds: int) -> DataFrame:
    """Rows that arrived too long after their time: the side table of late and revised records."""
    return feed.filter(F.col(arrived).cast("double") - F.col(time).cast("double") > late_seconds)


def upsert_latest(key: str, version: str, path: str):
    """For foreachBatch: keeps the latest version of each key in a Parquet table, batch by batch into a new snapshot, so a repeated batch changes nothing.

    A batch builds on the last whole snapshot before it, wherever that is, so gaps in epochs after a restart lose nothing.
    """

    def last_before(spark: SparkSession, epoch: int) -> str | None:
        fs = spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return None
        whole = [int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit() and system.exists(fs.Path(f.getPath(), "_SUCCESS"))]
        earlier = [e for e in whole if e < epoch]
        return f"{path}/{max(earlier)}" if earlier else None

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = last_before(spark, epoch)
        rows = spark.read.parquet(before).unionByName(batch) if before else batch
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/{epoch}")

    return run


def session_blocks(feed: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Blocks of rows of a key with gaps of at most `gap`: start, end and count."""
    s = F.session_window(time, gap)
    return feed.withWatermark(time, late).groupBy(s, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
