"""Near-duplicate vectors by a pivot-permutation index.

Pivots are reference vectors: a bounded sample of the vectors, thinned so that no two are close. A vector is described by its NEAREST pivots in order (the head of its
permutation), and enters the inverted lists of the pairs among them. What meets in a list is a candidate if the two descriptions share at least SHARED pivots, which is counted for the whole
list at once, and if their orders are near: the sum of the differences of the pivots' ranks (missing pivots rank last) is at most FAR_ORDER.
Candidates are verified by cosine in double precision; a pair counts in one list only, that of its smallest shared pivots. A list that grows long is refined: it becomes lists of three pivots, where all that share enough
pivots meet still. What is long even then is cut into blocks, and blocks are compared pairwise in tasks of their own. Equal vectors are one vector with a weight.

The fit sees SAMPLE vectors; every vector is indexed. At a cosine of 0.9 and more, recall is measured in the tests, by bands of the cosine.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and are components of their own. Vectors of different lengths
don't link. Repeated rows are vectors of their own that link with each other (if valid). A null id is carried and names no component others can take. An empty table gives an
empty table. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lean, split_join, table, written
from .components import components

COSINE = 0.9
SAMPLE = 16_384
LEAST_PIVOTS, MOST_PIVOTS, VECTORS_PER_PIVOT = 64, 4096, 40
#: Pivots aren't closer than this to each other.
APART = 0.6
NEAREST = 8
#: Pivots that a candidate pair shares at least, and by how much the ranks of all may differ in sum (72 is the most).
SHARED, FAR_ORDER = 3, 56
#: A list of two pivots with more entries becomes lists of three. There are at most 28 / LONG_LIST of these for each vector, eight bytes each.
LONG_LIST = 4096
#: Vectors of a block of a list.
BLOCK = 256
#: Pairs that are looked at, and vectors whose cosines are taken, at once.
PAIRS, VERIFIED = 100_000, 4_000
#: List entries that a task is dealt, about.
TASK_ROWS = 20_000
#: More long lists than this are joined by a shuffle instead of a broadcast.
BROADCAST_LISTS = 100_000


def valid(embedding: str) -> Column:
    return F.expr(
        f"{embedding} IS NOT NULL AND forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({embedding}, x -> x <> 0)"
    )


def pivots_of(vectors: DataFrame) -> np.ndarray:
    """Unit vectors that stand apart, from the SAMPLE vectors with the smallest hashes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, "<f4").tobytes() for x in batch.column(0).to_pylist()], pa.binary())], names=["raw"])

    n = vectors.count()
    few = vectors.select("vector").orderBy(F.xxhash64(F.lit(7), "vector"), "vector").limit(SAMPLE)
    rows = [np.frombuffer(r[0], "<f4") for r in few.mapInArrow(lean(run), "raw binary").collect()]
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // VECTORS_PER_PIVOT))
    size = max(map(len, rows), default=1)
    sample = np.zeros((len(rows), size))
    for row, r in zip(sample, rows, strict=True):
        row[: len(r)] = r
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    out: list[int] = []
    near = np.full(len(sample), -1.0)
    for i in range(len(sample)):
        if near[i] < APART:
            out.append(i)
            near = np.maximum(near, sample @ sample[i])
            if len(out) == wanted:
                break
    return sample[out] if out else np.ones((1, size))


def described(vectors: DataFrame, pivots: np.ndarray, item: str) -> DataFrame:
    """key, weight, vector (bytes, of floats where all are) and near: the numbers of the nearest pivots, nearest first."""
    n_near = min(NEAREST, len(pivots))
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    names = ["key", "weight", "vector", "near"]

    def run(batches):
        pivots = held.value
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                raw = [np.asarray(x, np.float64) for x in part.column(2).to_pylist()]
                x = np.zeros((len(raw), pivots.shape[1]))
                for row, v in zip(x, raw, strict=True):
                    k = min(len(v), len(row))
                    row[:k] = v[:k]
                score = -(x @ pivots.T)
                near = np.argpartition(score, n_near - 1, axis=1)[:, :n_near]
                near = np.sort(near, axis=1)
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1).astype("<u2")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.astype(item).tobytes() for v in raw], pa.binary()), pa.array([v.tobytes() for v in near], pa.binary())], names=names)

    return written(vectors.select("key", "weight", "vector").mapInArrow(lean(run), "key long, weight long, vector binary, near binary"), "permutations")


def list_key(pivots: np.ndarray, n_pivots: int) -> np.ndarray:
    """Keys of lists of two or three rising pivots (columns)."""
    key = pivots[:, 0] * n_pivots + pivots[:, 1]
    return key if pivots.shape[1] == 2 else (key * n_pivots + pivots[:, 2]) + (1 << 40)


def lists(vectors: DataFrame, n_pivots: int, long_lists: np.ndarray, columns: list[str]) -> DataFrame:
    """list, and columns of vectors: a row for each list that a vector is in. Where a pair's list is long, the vector is in those of the pair and each higher pivot."""
    names = ["list", *columns]
    held = vectors.sparkSession.sparkContext.broadcast(long_lists)
    n_near = min(NEAREST, n_pivots)
    pairs = np.stack(np.triu_indices(n_near, 1)) if n_near > 1 else np.zeros((2, 1), int)
    after = [np.arange(j + 1, n_near) for j in range(n_near)]

    def run(batches):
        long_lists = held.value
        for batch in batches:
            near = np.sort(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2").reshape(len(batch), n_near).astype(np.int64), axis=1)
            keys, rows = [], []
            for i, j in pairs.T:
                pair = list_key(near[:, [i, j]], n_pivots)
                deep = np.isin(pair, long_lists)
                keys.append(pair[~deep])
                rows.append(np.flatnonzero(~deep))
                if deep.any():
                    for k in after[j]:
                        keys.append(list_key(near[deep][:, [i, j, k]], n_pivots))
                        rows.append(np.flatnonzero(deep))
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(c.take(row) for c in batch.columns[1:])], names=names)

    schema = ", ".join(["list long", *(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*columns).schema)])
    return vectors.select(F.col("near").alias("head"), *columns).mapInArrow(lean(run), schema)


def order_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over all pivots of the differences of their ranks in two heads of permutations; a pivot that a head lacks ranks behind its last."""
    k = p.shape[1]
    same = p[:, :, None] == q[:, None, :]
    rank = np.arange(k)
    apart = np.abs(rank[:, None] - rank[None, :])
    alone = (~same.any(2)) @ (k - rank) + (~same.any(1)) @ (k - rank)
    return (same * apart).sum((1, 2)) + alone


def candidates(p: np.ndarray, i: np.ndarray, j: np.ndarray, shared: int, key: np.ndarray, n_pivots: int) -> np.ndarray:
    """Which pairs (rows i and j of p, heads of permutations) share pivots enough, order them alike, and count in the list (key) they met in."""
    a, b = p[i], p[j]
    has = (a[:, :, None] == b[:, None, :]).any(2)
    got = np.flatnonzero(has.sum(1) >= shared)
    got = got[order_distance(a[got], b[got]) <= FAR_ORDER]
    both = np.sort(np.where(has[got], a[got], n_pivots), axis=1)
    first = both[:, :2] if both.shape[1] > 1 else both[:, [0, 0]]
    own = list_key(first, n_pivots)
    deep = key[got] >= 1 << 40
    if deep.any():
        own[deep] = list_key(both[deep, :3], n_pivots)
    return got[own == key[got]]


def meetings(edge: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that stand in one group, PAIRS or somewhat more at a time. Groups are [edge[k], edge[k + 1]); those with a cut pair the rows before it with those from it on."""
    size, held, n = np.diff(edge), [], 0
    for x in np.unique(size[(cut < 0) & (size > 1)]).tolist():
        at = edge[:-1][(cut < 0) & (size == x)]
        i, j = np.triu_indices(x, 1)
        per = max(1, PAIRS // len(i))
        for k in range(0, len(at), per):
            held.append(((at[k : k + per, None] + i).ravel(), (at[k : k + per, None] + j).ravel()))
            n += len(held[-1][0])
            if n >= PAIRS:
                yield tuple(np.concatenate(y) for y in zip(*held, strict=True))
                held, n = [], 0
    for k in np.flatnonzero(cut >= 0).tolist():
        left, right = np.arange(edge[k], cut[k]), np.arange(cut[k], edge[k + 1])
        held.append((np.repeat(left, len(right)), np.tile(right, len(left))))
        n += len(held[-1][0])
        if n >= PAIRS:
            yield tuple(np.concatenate(y) for y in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(y) for y in zip(*held, strict=True))


def compare(rows: DataFrame, n_pivots: int, cosine: float, item: str) -> DataFrame:
    """key, links (weight of the linked vectors found here) and root (a key that links reach here, or null)."""

    n_near = min(NEAREST, n_pivots)
    shared = min(SHARED, n_near)

    def run(task, rows):
        data = {c: rows.column(c).to_numpy() for c in ("list", "low", "high", "side", "key", "weight")}
        vectors, near = rows.column("vector").to_pylist(), rows.column("near").to_pylist()
        length = np.fromiter(map(len, vectors), np.int64, len(vectors))
        order = np.lexsort((data["side"], length, data["high"], data["low"], data["list"]))
        data = {c: v[order] for c, v in data.items()}
        length = length[order]
        vectors, near = [vectors[k] for k in order], [near[k] for k in order]
        new = np.r_[True, (length[1:] != length[:-1]) | np.any([data[c][1:] != data[c][:-1] for c in ("list", "low", "high")], axis=0)]
        edge = np.r_[np.flatnonzero(new), len(order)]
        ones = np.r_[0, np.cumsum(data["side"])]
        cut = np.where(data["low"][edge[:-1]] == data["high"][edge[:-1]], -1, edge[1:] - (ones[edge[1:]] - ones[edge[:-1]]))
        p = np.frombuffer(b"".join(near), "<u2").reshape(len(near), n_near).astype(np.int64)
        found = []
        for i, j in meetings(edge, cut):
            got = candidates(p, i, j, shared, data["list"][i], n_pivots)
            i, j = i[got], j[got]
            for c in range(0, len(i), VERIFIED):
                x, y = i[c : c + VERIFIED], j[c : c + VERIFIED]
                for size in np.unique(length[x]).tolist():
                    own = length[x] == size
                    left, right = (np.frombuffer(b"".join(vectors[k] for k in z[own]), item).astype(np.float64).reshape(len(z[own]), -1) for z in (x, y))
                    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
                    held = dot(left, right) / np.sqrt(dot(left, left)) / np.sqrt(dot(right, right)) >= cosine
                    found.append(np.stack([x[own][held], y[own][held]]))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        keys, at = np.unique(np.r_[data["key"][i], data["key"][j]], return_inverse=True)
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, at, np.r_[data["weight"][j], data["weight"][i]])
        root = np.arange(len(keys))
        ends = at.reshape(2, -1)
        while True:  # smallest labels along links, with halving, until nothing changes
            low = np.minimum(root[ends[0]], root[ends[1]])
            before = root.copy()
            np.minimum.at(root, ends[0], low)
            np.minimum.at(root, ends[1], low)
            root = root[root]
            if (root == before).all():
                break
        return pa.table({"key": pa.array(keys.astype(np.int64)), "links": pa.array(links), "root": pa.array(keys[root].astype(np.int64))})

    return rows.groupBy("task").applyInArrow(lean(run), "key long, links long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    key = F.when(valid("vector"), F.xxhash64("vector"))
    classes = rows.filter(valid("vector")).groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    classes = checkpoint(classes.withColumn("key", F.xxhash64("vector")))
    pivots = pivots_of(classes)
    # doubles that came from floats are floats again without loss
    item = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    known = described(classes, pivots, item)
    count = lambda rows: rows.groupBy("list").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = checkpoint(count(lists(known, len(pivots), np.zeros(0, np.int64), [])))
    deep = np.array([r[0] for r in sizes.filter(F.col("size") > LONG_LIST).select("list").collect()] if len(pivots) > 2 else [], np.int64)
    if len(deep):
        sizes = checkpoint(count(lists(known, len(pivots), deep, [])))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    long_lists = checkpoint(sizes.filter(F.col("size") > BLOCK).select(F.col("list").alias("of_list"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    if long_lists.count() <= BROADCAST_LISTS:
        long_lists = F.broadcast(long_lists)
    entries = lists(known, len(pivots), deep, ["key", "weight", "vector", "near"]).join(long_lists, F.col("list") == F.col("of_list"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("blocks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    entries = entries.select("list", low.alias("low"), high.alias("high"), (F.col("own") == high).cast("int").alias("side"), "key", "weight", "vector", "near")
    n_tasks = max(1, -(-total // TASK_ROWS), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = entries.withColumn("task", F.pmod(F.xxhash64("list", "low", "high"), F.lit(n_tasks)).cast("int")).repartition(n_tasks, "task")
    found = checkpoint(compare(entries, len(pivots), cosine, item))
    links = found.groupBy(F.col("key").alias("of_key")).agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "least_id", "weight").join(label, F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("component", "key"))
    named = checkpoint(named)
    least = checkpoint(named.groupBy(F.col("group").alias("of_group")).agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")))
    named = split_join(named, least, "group", "of_group", "members", "key").join(links, F.col("key") == F.col("of_key"), "left")
    named = named.select(F.col("key").alias("known_key"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", key.alias("key")).join(named, F.col("key") == F.col("known_key"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
