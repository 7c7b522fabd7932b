"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-gram hashes is cut into fragments. A fragment's task sees the part of every document that falls into it: it
counts in how many documents each n-gram stands and hands the n-grams of two or more documents back to their documents. A
document most of whose n-grams stand nowhere else has no partner and drops out. For the others, candidate pairs share an
n-gram among the rarest, of which a similar partner must hold one, at places that leave room for the overlap (prefix and
position filters, both exact). Overlaps of candidates are counted in each fragment separately and summed per pair.

Documents with equal sets are one class from the start. To find components without listing all pairs of a large group of copies,
candidates are taken twice: first each document with the documents that hold most of what is common in its groups, then only pairs that are still in
different components. No link between components is lost.

The number of fragments follows from the table's bytes. An n-gram of very many documents (HOT_CELLS, and over a millionth of all) would make one fragment grow with the table, so the tasks that take the sets
count what recurs, and the cells of such n-grams go straight to their documents, spread by the set: their frequency is known to be the highest that is told apart. N-grams that stand in very many
prefixes are split over tasks by the set, and meet only sets of about their size.

Null or wordless texts have the empty set and link with nothing. Repeated rows (and repeated ids) are kept one by one. A null id links but names no component.
An empty table gives an empty table. Other columns are dropped by the query and carried through by the stage. A very long text is one row of n-grams, worked on as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, lean, sheltered, split_join, table, text_bytes
from .components import components
from .shingles import BITS, set_keys, shingle_sets, shingle_steps

#: Least fragments; each then spans at most 2 ** 48 hashes, which six bytes hold.
LEAST_FRAGMENTS = 16
#: Fragments in which the overlaps of candidates are counted.
COUNT_FRAGMENTS = 8
#: N-grams that a worker gathers before it hands on their fragments, and sets that it remembers to have handed on.
GATHER = 400_000
MOST_SEEN = 500_000
#: Bytes of text of which one fragment holds the n-grams, about.
PART_BYTES = 8 << 20
LEADERS = 2
#: Cells of an n-gram from which it leaves its fragment; at least MOST_DF, so that its frequency is known.
HOT_CELLS = 4096
#: N-grams that a worker gathers before it says which recur, and how often these do at least: n-grams below this in every such part have under eight millionths of all cells.
COUNT_CELLS, LEAST_REPEATS = 1 << 20, 8
#: The highest frequency that is told apart.
MOST_DF = 255


def six_bytes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def from_six_bytes(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def gather(column: pa.ChunkedArray, kind: str | None) -> np.ndarray:
    parts = column.to_pylist()
    if kind is None:
        return np.concatenate([from_six_bytes(x) for x in parts]) if parts else np.zeros(0, np.uint64)
    return np.concatenate([np.frombuffer(x, kind) for x in parts]) if parts else np.zeros(0, kind)


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values of consecutive runs of a numpy array's items."""
    size = data.dtype.itemsize
    buffer = np.ascontiguousarray(data).tobytes()
    return pa.array([buffer[size * a : size * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


def fragments_of(docs: DataFrame) -> int:
    """Fragments for docs (text): by their bytes, so that none grows with the table."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(LEAST_FRAGMENTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))


class Unseen:
    """Tells sets that a task has met from new ones, by their keys; of equal sets one is enough. It may forget, which only makes work."""

    def __init__(self) -> None:
        self.seen = np.zeros(0, np.uint64)

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        own_keys, first = np.unique(keys, return_index=True)
        unseen = self.seen[np.minimum(np.searchsorted(self.seen, own_keys), len(self.seen) - 1)] != own_keys if len(self.seen) else np.ones(len(own_keys), bool)
        fresh = np.zeros(len(keys), bool)
        fresh[first[unseen]] = True
        self.seen = np.sort(np.r_[self.seen, own_keys[unseen]]) if len(self.seen) < MOST_SEEN else own_keys
        return fresh


def recurring(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that come at least so often, and how often."""
    h = np.sort(np.concatenate(held))
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    times = np.diff(np.r_[edge, len(h)])
    often = times >= least
    return h[edge[often]], times[often]


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """row_id, n_shingles and set_key of docs (row_id, text); and rows with gram, an n-gram that n_shingles sets of a task hold, where these are many."""
    names = ["row_id", "n_shingles", "set_key", "gram"]

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        h, times = recurring(held, LEAST_REPEATS)
        nothing = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([nothing, pa.array(times), nothing, pa.array(h.view(np.int64))], names=names)

    def run(batches):
        held, n, unseen = [], 0, Unseen()
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            for a, b in shingle_steps(ends):
                with np.errstate(over="ignore"):
                    row, h, bounds = shingle_sets(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], size)
                    keys = set_keys(h, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(keys.view(np.int64)), pa.nulls(b - a, pa.int64())], names=names)
                held.append(h[unseen.fresh(keys)[row]])
                n += len(held[-1])
                if n >= COUNT_CELLS:
                    yield told(held)
                    held, n = [], 0
        if n:
            yield told(held)

    return docs.mapInArrow(lean(run), "row_id long, n_shingles long, set_key long, gram long")


def hot_grams(found: DataFrame) -> np.ndarray:
    """The n-grams that leave their fragments, in order: by the threshold a million at most, 8 MB."""
    cells = found.filter("gram is null").agg(F.sum("n_shingles")).first()[0] or 0
    most = max(HOT_CELLS, MOST_DF, cells // 1_000_000)
    grams = found.filter("gram is not null").groupBy("gram").agg(F.sum("n_shingles").alias("cells")).filter(F.col("cells") >= most)
    return np.sort(grams.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))


def fragments(docs: DataFrame, size: int, n_fragments: int, hot: np.ndarray) -> DataFrame:
    """Rows of (fragment, keys, counts, hashes): the parts of many documents in a fragment; counts[i] hashes are of the set keys[i], which comes several times if it has more than a byte counts.

    Fragments from n_fragments on have the hot n-grams, as places in their list, of the sets of a bucket.
    """
    told = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["fragment", "keys", "counts", "hashes"]

    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, row, h = [], [], []
        for keys, rows, hashes in held:
            row.append(rows + sum(map(len, key)))
            key.append(keys)
            h.append(hashes)
        key, row, h = map(np.concatenate, (key, row, h))
        part = (((h >> np.uint64(20)) * np.uint64(n_fragments)) >> np.uint64(BITS - 20)).astype(np.int64)
        h, place = h - lowest(part, n_fragments), place_in(told.value, h)
        part = np.where(place < 0, part, n_fragments + (key[row] % np.uint64(n_fragments)).astype(np.int64))
        h = np.where(place < 0, h, place.astype(np.uint64))
        order = np.argsort(part.astype(np.uint32), kind="stable")
        part, row, h = part[order], row[order], h[order]
        edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
        counts = np.diff(np.r_[edge, len(row)])
        several = -(-counts // 255)
        edge = np.repeat(edge, several) + 255 * (np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several))
        cells, counts = row[edge], np.diff(np.r_[edge, len(row)]).astype(np.uint8)
        first = np.flatnonzero(np.r_[True, part[edge][1:] != part[edge][:-1]])
        cut, at = np.r_[first, len(edge)], np.r_[edge[first], len(row)]
        packed = six_bytes(h).tobytes()
        hashes = [packed[6 * a : 6 * b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edge][first].astype(np.int32)), blobs(key[cells].astype("<u8"), cut), blobs(counts, cut), pa.array(hashes, pa.binary())], names=names)

    def run(batches):
        held, n, unseen = [], 0, Unseen()
        for batch in batches:
            data, ends = text_bytes(batch.column(0))
            for a, b in shingle_steps(ends):
                with np.errstate(over="ignore"):
                    row, h, bounds = shingle_sets(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], size)
                    keys = set_keys(h, bounds)
                own = unseen.fresh(keys)[row]
                held.append((keys, row[own], h[own]))
                n += int(own.sum())
                if n >= GATHER:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return docs.select("text").mapInArrow(lean(run), "fragment int, keys binary, counts binary, hashes binary")


def lowest(part: np.ndarray, n_fragments: int) -> np.ndarray:
    """The least hash of a fragment."""
    p = part.astype(np.uint64)
    n = np.uint64(n_fragments)
    return (((p << np.uint64(BITS - 20)) + n - np.uint64(1)) // n) << np.uint64(20)


def place_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in sorted values, -1 where it isn't there."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def set_sizes(member: DataFrame, n_fragments: int) -> DataFrame:
    """bucket, keys and sizes of many sets (row_id, n_shingles, set_key)."""

    def run(batches):
        for batch in batches:
            keys, first = np.unique(batch.column(1).to_numpy().view(np.uint64), return_index=True)
            sizes = batch.column(0).to_numpy()[first].astype("<u4")
            bucket = (keys % np.uint64(n_fragments)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.zeros(0, np.int64)
            cut = np.r_[edge, len(order)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][edge].astype(np.int32)), blobs(keys[order], cut), blobs(sizes[order], cut)], names=["bucket", "keys", "sizes"])

    return member.select("n_shingles", "set_key").mapInArrow(lean(run), "bucket int, keys binary, sizes binary")


def shared(parts: DataFrame, member: DataFrame, n_fragments: int, percent: int, hot: np.ndarray) -> DataFrame:
    """set_key, n, grams: the sets of which enough n-grams stand in another set too; grams are those, from the rarest on (dfs: in how many sets, 255 at most)."""

    told = parts.sparkSession.sparkContext.broadcast(hot)

    def count(key, rows):
        part = key[0].as_py()
        keys, counts = gather(rows.column("keys"), "<u8"), gather(rows.column("counts"), np.uint8)
        h = gather(rows.column("hashes"), None)
        keys, cell = np.unique(keys, return_inverse=True)
        cell = np.repeat(cell.reshape(-1).astype(np.int32), counts)
        order = np.lexsort((cell, h))
        h, cell = h[order], cell[order]
        del order
        new = np.r_[True, h[1:] != h[:-1]]
        own = new | np.r_[True, cell[1:] != cell[:-1]]
        h, cell, new = h[own], cell[own], new[own]
        run = np.cumsum(new, dtype=np.int32) - 1
        df = np.minimum(np.bincount(run), MOST_DF).astype(np.uint8)[run]
        if part < n_fragments:
            h += lowest(np.array([part]), n_fragments)[0]
        else:
            h, df = told.value[h.astype(np.int64)], np.full(len(h), MOST_DF, np.uint8)
        often = df > 1
        h, cell, df = h[often], cell[often].astype(np.int64), df[often]
        del run, new, own, often
        bucket = (keys % np.uint64(n_fragments)).astype(np.int64)
        order = np.lexsort((cell, bucket[cell]))
        h, cell, df = h[order], cell[order], df[order]
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        cells, counts = cell[edge], np.diff(np.r_[edge, len(cell)]).astype("<u4")
        of = bucket[cells]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        cut, at = np.r_[first, len(edge)], np.r_[edge[first], len(cell)]
        packed, dfs = np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), df.tobytes()
        pairs = list(zip(at[:-1], at[1:], strict=True))
        return pa.table({
            "bucket": pa.array(of[first].astype(np.int32)), "keys": blobs(keys[cells], cut), "counts": blobs(counts, cut),
            "grams": pa.array([packed[7 * a : 7 * b] for a, b in pairs], pa.binary()), "dfs": pa.array([dfs[a:b] for a, b in pairs], pa.binary()),
        })

    def keep(key, rows):
        told = rows.filter(rows.column("sizes").is_valid())
        rows = rows.filter(rows.column("sizes").is_null())
        of, first = np.unique(gather(told.column("keys"), "<u8"), return_index=True)
        size_of = gather(told.column("sizes"), "<u4")[first]
        keys, counts, dfs = (gather(rows.column(c), t) for c, t in (("keys", "<u8"), ("counts", "<u4"), ("dfs", np.uint8)))
        h = np.zeros((len(dfs), 8), np.uint8)
        h[:, :7] = gather(rows.column("grams"), np.uint8).reshape(-1, 7)
        h = h.reshape(-1).view("<u8")
        keys, cell = np.unique(keys, return_inverse=True)
        sizes, cell = size_of[np.searchsorted(of, keys)].astype(np.int64), np.repeat(cell.reshape(-1), counts)
        n_shared = np.bincount(cell, minlength=len(keys))
        stays = n_shared >= -(-percent * sizes // 100)
        own = stays[cell]
        h, cell, dfs = h[own], cell[own], dfs[own]
        order = np.lexsort((h, dfs, cell))
        h, cell, dfs = h[order], cell[order], dfs[order]
        left = np.flatnonzero(stays)
        cut = np.r_[np.searchsorted(cell, left), len(cell)]
        return pa.table({"set_key": pa.array(keys[left].view(np.int64)), "n": pa.array(sizes[left]), "grams": blobs(h, cut), "dfs": blobs(dfs, cut)})

    back = parts.repartition(n_fragments, "fragment").groupBy("fragment").applyInArrow(lean(count), "bucket int, keys binary, counts binary, grams binary, dfs binary")
    back = back.unionByName(set_sizes(member, n_fragments), allowMissingColumns=True)
    return back.repartition(n_fragments, "bucket").groupBy("bucket").applyInArrow(lean(keep), "set_key long, n long, grams binary, dfs binary")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """gram, set_key, n, place: the n-grams of each set among which a partner must hold one, with their places in rising frequency; common: how frequent the set's n-grams are."""

    def run(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            grams = [np.frombuffer(x, "<u8") for x in batch.column(2).to_pylist()]
            dfs = [np.frombuffer(x, np.uint8) for x in batch.column(3).to_pylist()]
            alone = n - np.array([len(g) for g in grams], np.int64)
            take = np.maximum(0, n - -(-percent * n // 100) + 1 - alone)
            take = np.minimum(take, [len(g) for g in grams])
            common = np.array([np.log(d.astype(float)).sum() for d in dfs]) / np.maximum(n, 1)
            row = np.repeat(np.arange(len(n)), take)
            place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + alone[row]
            gram = np.concatenate([g[:k] for g, k in zip(grams, take, strict=True)]) if len(grams) else np.zeros(0, np.uint64)
            columns = [gram.astype(np.int64), batch.column(0).to_numpy()[row], n[row], place, common[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "set_key", "n", "place", "common"])

    return sets.mapInArrow(lean(run), "gram long, set_key long, n long, place long, common double")


def room(percent: int) -> str:
    """SQL: two sets of n_a and n_b n-grams, whose first shared one is at place_a and place_b, may be similar."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND (100 + {percent}) * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with n_a, n_b and overlap, counted fragment by fragment and summed."""

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            for key, n, grams in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h = np.sort(np.frombuffer(grams, "<u8"))
                bounds = np.searchsorted(h, np.arange(COUNT_FRAGMENTS + 1).astype(np.uint64) << np.uint64(BITS - 3))
                for f in range(COUNT_FRAGMENTS):
                    for column, value in zip(out, (f, key, n, h[bounds[f] : bounds[f + 1]].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["fragment", "set_key", "n", "part"])

    def partial(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()] for k in (4, 5))
            row = np.concatenate([np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)])
            h = np.concatenate([*a, *b])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            counts = np.bincount(row[1:][same], minlength=len(a)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts)], names=["a", "b", "n_a", "n_b", "overlap"])

    parts = sets.select("set_key", "n", "grams").mapInArrow(lean(cut), "fragment int, set_key long, n long, part binary")
    side = lambda x: parts.select(F.col("fragment").alias(f"f_{x}"), F.col("set_key").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"), F.col("part").alias(f"part_{x}"))
    wide = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(COUNT_FRAGMENTS - 1))).alias("f"))
    wide = wide.join(side("a"), (F.col("f") == F.col("f_a")) & (F.col("a") == F.col("key_a")))
    wide = wide.join(side("b"), (F.col("f") == F.col("f_b")) & (F.col("b") == F.col("key_b")))
    counted = wide.select("a", "b", "n_a", "n_b", "part_a", "part_b").mapInArrow(lean(partial), "a long, b long, n_a long, n_b long, overlap long")
    return counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    similar = F.expr(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")
    return checkpoint(overlaps(pairs, sets).filter(similar).select("a", "b"))


def set_components(sets: DataFrame, percent: int) -> DataFrame:
    """set_key and component (a set's key) of sets that link with others."""
    grams = checkpoint(prefixes(sets, percent))
    by_gram = checkpoint(grams.groupBy("gram").agg(F.max(F.struct("common", "set_key", "n", "place")).alias("lead"), F.count("*").alias("size")).filter("size > 1"))
    lead = by_gram.select(F.col("gram").alias("of"), "size", F.col("lead.set_key").alias("b"), F.col("lead.n").alias("n_b"), F.col("lead.place").alias("place_b"))
    led = split_join(grams, lead, "gram", "of", "size", "set_key").filter("set_key <> b").withColumnsRenamed({"set_key": "a", "n": "n_a", "place": "place_a"})
    led = led.filter(room(percent)).groupBy("a", "b").agg(F.count("*").alias("votes"))
    ranked = led.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))).filter(F.col("rank") <= LEADERS)
    first = links(ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent)

    label = components(first).withColumnsRenamed({"node": "of_key"})
    marked = grams.join(label, F.col("set_key") == F.col("of_key"), "left").withColumn("group", F.coalesce("component", "set_key")).drop("of_key", "component", "common")
    marked = checkpoint(marked)
    mixed = marked.groupBy("gram").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("size")).filter("low <> high")
    mixed = checkpoint(mixed.select(F.col("gram").alias("of"), "size"))
    marked = split_join(marked, mixed, "gram", "of", "size", "set_key", "left_semi")
    # sizes of similar sets are at most one band apart
    marked = marked.withColumn("band", F.floor(F.log("n") / F.lit(1.001 * math.log(100 / percent) if percent < 100 else 1.0)))
    side = lambda x: marked.select("gram", "band", *(F.col(c).alias(f"{c}_{x}") for c in ("set_key", "n", "place", "group")))
    near = side("b").withColumnRenamed("gram", "gram_b").withColumn("band_b", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1))))).drop("band")
    rest = side("a").join(near, F.expr(f"gram = gram_b AND band = band_b AND group_a <> group_b AND set_key_a < set_key_b AND {room(percent)}"))
    second = links(rest.select(F.col("set_key_a").alias("a"), F.col("set_key_b").alias("b")).distinct(), sets, percent)
    return components(first.union(second)).withColumnsRenamed({"node": "set_key"})


def similar_groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """row_id, n_shingles, component_id (the smallest row id that links reach): one row per row of docs."""
    docs = docs.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    n_fragments = fragments_of(docs)
    found = checkpoint(sets_of(docs, size))
    member, hot = found.filter("gram is null").drop("gram"), hot_grams(found)
    sets = checkpoint(shared(fragments(docs, size, n_fragments, hot), member, n_fragments, percent, hot))
    linked = set_components(sets, percent).withColumnsRenamed({"set_key": "of_key"})
    least = member.filter("n_shingles > 0").groupBy(F.col("set_key").alias("own_key")).agg(F.min("row_id").alias("least_id"), F.count("*").alias("copies"))
    least = least.join(linked, F.col("own_key") == F.col("of_key"), "left").withColumn("group", F.coalesce("component", "own_key"))
    least = checkpoint(least.select("own_key", "group", "least_id", "copies"))
    by_group = least.groupBy(F.col("group").alias("of_group")).agg(F.min("least_id").alias("group_id"), F.sum("copies").alias("rows"), F.count("*").alias("size"))
    by_group = checkpoint(by_group.filter("rows > 1"))
    ids = split_join(least, by_group, "group", "of_group", "size", "own_key").select("own_key", "group_id")
    out = member.join(ids, (F.col("set_key") == F.col("own_key")) & (F.col("n_shingles") > 0), "left")
    return out.select("row_id", "n_shingles", F.coalesce("group_id", "row_id").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that with the smallest id."""
    groups = similar_groups(docs, size=size, percent=percent)
    gone = groups.filter("component_id <> row_id").select(F.col("row_id").alias("gone_id")).distinct()
    return sheltered(docs, lambda d: d.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""
