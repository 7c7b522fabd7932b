"""Shared pieces of the training-data operators: tables, shared folders, byte and word arithmetic."""

from __future__ import annotations

import ctypes
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is one step of its own.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is made if the driver runs the tasks itself (tests); on a cluster that is refused."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="seismolake-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Folders made by this driver, in order.
_made: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(out)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are made inside, which what comes after doesn't read."""
    first = len(_made)
    try:
        yield
    finally:
        for folder in _made[first:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _made[first:]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder: computed once, compressed, and its small files are read together."""
    out = fresh_dir(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def checkpoint(df: DataFrame) -> DataFrame:
    return written(df, "step")


#: A key of more rows than this (and than a ten-thousandth of all) is split over several tasks by split_join.
HOT_ROWS = 1000


def split_join(rows: DataFrame, table: DataFrame, left: str, right: str, size: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with table on left = right, with keys of very many rows split by a hash of the column `by`. table has one row a key, which says in `size` how many rows have the key.

    At most ten thousand keys have more than a ten-thousandth of the rows, so the list of hot keys that is broadcast is small at any size.
    """
    most = max(HOT_ROWS, (table.agg(F.sum(size)).first()[0] or 0) // 10_000)
    hot = F.broadcast(table.filter(F.col(size) > most).select(F.col(right).alias("hot_key_"), F.ceil(F.col(size) / most).cast("int").alias("salts_")))
    rows = rows.join(hot, F.col(left) == F.col("hot_key_"), "left").withColumn("salt_", F.pmod(F.xxhash64(by), F.coalesce("salts_", F.lit(1))).cast("int")).drop("hot_key_", "salts_")
    table = table.withColumn("salt_of_", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.when(F.col(size) > most, F.ceil(F.col(size) / most)).otherwise(1)).cast("int") - 1)))
    return rows.join(table, (F.col(left) == F.col(right)) & (F.col("salt_") == F.col("salt_of_")), how).drop("salt_", "salt_of_")


#: The columns of documents that stages know; others are carried through.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs) with the columns of docs. Further columns go through under names that clash with nothing, and come back as they were."""
    names = {c: f"carried_{k}_" for k, c in enumerate(docs.columns) if c not in KNOWN}
    out = step(docs.withColumnsRenamed(names))
    return out.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def steps(ends: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, at least a row each."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def give_back() -> None:
    """Returns freed memory to the system, as workers outlive their tasks and stand idle beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A task's function of batches, or of a group's key and rows, that gives back its memory when they are done."""

    def batches(parts):
        try:
            yield from run(parts)
        finally:
            give_back()

    def group(key, rows):
        try:
            return run(key, rows)
        finally:
            give_back()

    return batches if inspect.isgeneratorfunction(run) else group


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to the usual length."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, STEP_BYTES + 1)
        held = np.ones(size, np.uint64)
        held[1:] = np.uint64(base)
        np.multiply.accumulate(held, out=held)
        if size <= 4 * STEP_BYTES:
            _powers[base] = held
    return held[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=total[1:])
    value = (total[end] - total[start]) * powers(len(data) + 1, _BACK)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs of bytes other than ASCII white space)."""
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = solid[first]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = ends[1:][ends[:-1] < ends[1:]] - 1
    stops[last] = solid[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(ends, start, "right") - 1


def window_hashes(values: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` neighbours of one row, and the place of each window's first value."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + values[at + k]
    return mix(total), at
