"""Removal of repeated passages by a distributed, sparse suffix array.

Every byte that a LENGTH-byte string covers which also starts earlier in the corpus is removed. The steps:

1. Each LENGTH-byte window picks the place of its least GRAM-byte hash. Equal windows pick the same place in them, so only
   suffixes that start at picked places need sorting. A place stands for the run of windows that picked it.
2. A filter that loses nothing: places whose gram's hash stands nowhere else are done. A worker knows at once that a gram which it holds twice isn't
   alone, so a passage that stands everywhere sends one record a worker. No byte is removed on account of this step.
3. All other suffixes are sorted by a distributed merge sort. Workers sort runs, keep the first of suffixes that agree in all bytes with a run's windows (the
   others are repeats), and send runs front-coded (what a suffix shares with the one before it isn't sent) to the tasks of sorted ranges, whose bounds come from a
   bounded sample. The receiver merges the runs with a loser tree that knows the common prefixes and compares no known byte again.
   Suffixes that share LENGTH - o bytes stand next to each other then, and with equal o bytes to the left they are equal windows.
   A gram before which and after which very many different texts stand is sorted window by window instead of as a whole.

All windows are judged on the input. Documents are ordered by id; a null id is the smallest, a null text is empty. Repeated rows (same id and text) are one
document: they lose the same bytes, and none on account of each other. Texts under LENGTH bytes lose nothing; longer ones are worked on in pieces of bounded size.
Columns beside those named are carried through; those that clash with a result's are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BACK, BYTE_CODE, STEP_BYTES, checkpoint, lean, mix, powers, sheltered, steps, table, text_bytes

LENGTH = 100
GRAM = 28
WINDOW = LENGTH - GRAM + 1
ORDER_BITS = np.uint64(28)
FIRST_ID = -(1 << 63)
#: Places that a worker gathers, and suffixes of a sorted run.
GATHER = 200_000
RUN = 32_000
#: Open places of a text that are worked on at once.
STEP_PLACES = 250
#: Bytes of text whose places one group of step 2 filters, and suffixes that one group of step 3 merges, about.
PART_BYTES = 12 << 20
MERGE_SUFFIXES = 40_000
#: The sample of step 3: texts and grams of a text at most, and ranges that it is cut into. More groups than ranges deal a range by hash of the gram.
SAMPLE_TEXTS, SAMPLE_GRAMS, MOST_RANGES = 1000, 32, 4096
#: Least number of different surroundings of one gram for it to be sorted window by window.
SPLIT_LEAST = 256


def pieces(data: np.ndarray, ends: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, rows and offsets in their texts, of steps; texts longer than a step come in pieces that overlap by LENGTH - 1 bytes."""
    for a, b in steps(ends, step):
        if b - a > 1 or ends[b] - ends[a] <= 2 * step:
            yield data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], np.arange(a, b), np.zeros(b - a, np.int64)
        else:
            for at in range(ends[a], ends[b], step):
                part = data[at : min(at + step + LENGTH - 1, ends[b])]
                yield part, np.array([0, len(part)]), np.array([a]), np.array([at - ends[a]])


def places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each picked place: hash of its gram, hash of its run of windows, row, first window, last window, place."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(n), out=total[1:])
    back = powers(n + 1, _BACK)
    gram = mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    m = len(gram)
    code = (gram >> ORDER_BITS << ORDER_BITS) | np.arange(m, dtype=np.uint64)
    block = np.concatenate([code, np.full(-m % WINDOW, np.iinfo(np.uint64).max)]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(block, 1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    n_windows = m - WINDOW + 1
    least = np.minimum(behind[:n_windows], ahead[WINDOW - 1 : WINDOW - 1 + n_windows])
    place = (least & np.uint64((1 << int(ORDER_BITS)) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n_windows]
    start = np.flatnonzero(np.arange(n_windows) + LENGTH <= ends[row + 1])
    if not len(start):
        return places(data[:0], ends)
    place, row = place[start], row[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    low, high, at, row = start[new], start[np.r_[new[1:], len(start)] - 1], place[new], row[new]
    run = (total[high + LENGTH] - total[low]) * back[low]
    run = mix(mix(run + (at - low).astype(np.uint64)) + (high - low).astype(np.uint64))
    return gram[at], run, row, low, high, at


def repeats(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, document and start; in that order: is it the first of its keys, and does it repeat (start after) the first?"""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    d, s = doc[order], start[order]
    return order, new, (d != d[first]) | (s != s[first])


FOUND = np.dtype([("key", "<i8"), ("low", "<u4"), ("span", "u1")])
#: What step 2 exchanges: six bytes of the gram's hash, four of its run's, and the place; NO_PLACE in span where the place needn't be told.
PICKED = np.dtype([("gram", "<u4"), ("more", "<u2"), ("run", "<u4"), ("key", "<i8"), ("low", "<u4"), ("left", "u1"), ("span", "u1")])
NO_PLACE = 255
SHORT = np.uint64((1 << 48) - 1)
WORK = np.dtype([("key", "<i8"), ("low", "<u4"), ("left", "u1"), ("span", "u1")])
HOT = np.dtype([("gram", "<u8"), ("n", "<u4")])


def record(dtype: np.dtype, **columns) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), dtype)
    for name, values in columns.items():
        out[name] = values
    return out


def dealt(parts: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    """rows of each part, as bytes."""
    order = np.argsort(parts, kind="stable")
    parts, rows = parts[order], rows[order]
    edge = np.r_[np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]), len(parts)] if len(parts) else np.zeros(1, np.int64)
    return [(int(parts[a]), rows[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def sent(rows: list[tuple[int, bytes]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k + 1] for r in rows], pa.binary()) for k in range(len(names)))], names=["part", *names])


def loaded(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def merged_spans(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans [low, high) that touch or overlap, by key."""
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    if not len(key):
        return key, low, high
    _, group = np.unique(key, return_inverse=True)
    wide = int(high.max()) + 1
    reach = np.maximum.accumulate(high + group * wide) - group * wide
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (low[1:] > reach[:-1])])
    return key[new], low[new], reach[np.r_[new[1:], len(key)] - 1]


def pick(docs: DataFrame, n_parts: int) -> DataFrame:
    """Step 1 and the workers' part of step 2, for docs (key, text): part by gram with classes of places (PICKED), or by document with open places (WORK)."""
    step, gather = STEP_BYTES, GATHER

    def emit(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, run, key, low, left, span = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((run, gram))
        gram, run, key, low, left, span = (x[order] for x in (gram, run, key, low, left, span))
        new = np.r_[True, gram[1:] != gram[:-1]]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        work = record(WORK, key=key[several], low=low[several], left=left[several], span=span[several])
        span[several] = NO_PLACE
        own = new | np.r_[True, run[1:] != run[:-1]]
        gram, run, key, low, left, span = (x[own] for x in (gram, run, key, low, left, span))
        picked = record(PICKED, gram=gram & np.uint64(0xFFFFFFFF), more=gram >> np.uint64(32), run=run, key=key, low=low, left=left, span=span)
        out = [(p, d, None) for p, d in dealt((gram % np.uint64(n_parts)).astype(np.int64), picked)]
        return sent(out + [(p, None, d) for p, d in dealt(work["key"] % n_parts, work)], "picked", "work")

    def run(batches):
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for data, ends, rows, offset in pieces(*text_bytes(batch.column(1)), step):
                with np.errstate(over="ignore"):
                    gram, run_hash, row, low, high, at = places(data, ends)
                low_in = (low - ends[row] + offset[row]).astype(np.uint32)
                held.append((gram & SHORT, run_hash.astype(np.uint32), keys[rows[row]], low_in, (at - low).astype(np.uint8), (high - low).astype(np.uint8)))
                n += len(gram)
                if n >= gather:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return docs.mapInArrow(lean(run), "part int, picked binary, work binary")


def open_places(picked: DataFrame, n_parts: int) -> DataFrame:
    """Step 2: part by document with the places whose grams aren't alone (WORK), and the grams with more than SPLIT_LEAST surroundings (HOT)."""
    least = SPLIT_LEAST

    def run(key, rows):
        known = [(key[0].as_py(), x, None) for x in rows.column("work").to_pylist() if x]
        got = loaded(rows.column("picked"), PICKED)
        gram = got["gram"].astype(np.uint64) | (got["more"].astype(np.uint64) << np.uint64(32))
        order = np.lexsort((got["run"], gram))
        got, gram = got[order], gram[order]
        new = np.r_[True, gram[1:] != gram[:-1]] if len(gram) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        different = np.bincount(group[new | np.r_[True, got["run"][1:] != got["run"][:-1]]] if len(gram) else group, minlength=int(new.sum()))
        still = got[(np.bincount(group)[group] > 1) & (got["span"] != NO_PLACE)] if len(gram) else got
        still = record(WORK, **{c: still[c] for c in WORK.names})
        hot = record(HOT, gram=gram[new][different > least], n=different[different > least])
        out = known + [(p, d, None) for p, d in dealt(still["key"] % n_parts, still)] + ([(key[0].as_py(), None, hot.tobytes())] if len(hot) else [])
        return pa.Table.from_batches([sent(out, "work", "hot")])

    return picked.repartition(n_parts, "part").groupBy("part").applyInArrow(lean(run), "part int, work binary, hot binary")


def by_document(still: DataFrame, n_parts: int) -> DataFrame:
    """key, work (WORK of its open places) and n_work; hot grams (HOT) in rows without a key."""

    def run(key, rows):
        hot = [x for x in rows.column("hot").to_pylist() if x]
        work = loaded(rows.column("work"), WORK)
        work = work[np.argsort(work["key"], kind="stable")]
        edge = np.r_[np.flatnonzero(np.r_[True, work["key"][1:] != work["key"][:-1]]), len(work)] if len(work) else np.zeros(1, np.int64)
        cells = [work[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        keys, none = work["key"][edge[:-1]].tolist(), [None] * len(hot)
        return pa.table({
            "key": pa.array(keys + none, pa.int64()), "work": pa.array(cells + none, pa.binary()),
            "n_work": pa.array(np.diff(edge).tolist() + [0] * len(hot), pa.int64()), "hot": pa.array([None] * len(cells) + hot, pa.binary()),
        })

    return still.repartition(n_parts, "part").groupBy("part").applyInArrow(lean(run), "key long, work binary, n_work long, hot binary")


def range_bounds(docs: DataFrame, n_rows: int, n_ranges: int) -> np.ndarray:
    """Grams that part the sorted suffixes into n_ranges of about equal size, from a bounded sample of docs (key, text)."""

    def run(batches):
        for batch in batches:
            for data, ends, rows, _ in pieces(*text_bytes(batch.column(0))):
                with np.errstate(over="ignore"):
                    gram, _, row, _, _, at = places(data, ends)
                order = np.lexsort((gram, row))
                row, at = row[order], at[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                at = at[nth < SAMPLE_GRAMS]
                yield pa.RecordBatch.from_arrays([pa.array([data[k : k + GRAM].tobytes() for k in at], pa.binary())], names=["gram"])

    few = docs.filter(F.pmod("key", F.lit(max(1, n_rows // SAMPLE_TEXTS))) == 0)
    sample = np.array(sorted(r[0] for r in few.select("text").mapInArrow(lean(run), "gram binary").collect()), f"S{GRAM}")
    if not len(sample) or n_ranges < 2:
        return np.zeros(0, f"S{GRAM}")
    return np.unique(sample[(np.arange(1, n_ranges) * len(sample)) // n_ranges])


SUFFIX = np.dtype([("doc", "<i8"), ("key", "<i8"), ("at", "<u4"), ("near", "u1"), ("far", "u1")])


def row_hashes(rows: np.ndarray, code: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Hashes of rows of bytes, a few thousand rows at a time; of the first inside[i] bytes of row i where that is given."""
    out = np.zeros(len(rows), np.uint64)
    for a in range(0, len(rows), 4096):
        part = BYTE_CODE[rows[a : a + 4096]] * code
        if inside is not None:
            part *= np.arange(rows.shape[1]) < inside[a : a + 4096, None]
        out[a : a + 4096] = part.sum(1, dtype=np.uint64)
    return out


def differs(x: np.ndarray) -> np.ndarray:
    """Is a row unlike the one before?"""
    out = np.ones(len(x), bool)
    out[1:] = (x[1:] != x[:-1]).any(1) if x.ndim > 1 else x[1:] != x[:-1]
    return out


def suffix_runs(rows: DataFrame, bounds: np.ndarray, hot: np.ndarray, n_parts: int) -> DataFrame:
    """Step 3, the workers' runs, for rows (key, doc, packed, work): part with a sorted, front-coded run, or with repeats (FOUND).

    A suffix starts at its place and has LENGTH bytes (zeros beyond the text). near and far bound the offsets o of its windows, which start o
    bytes before the place; the far bytes before it are sent in reverse. A place with a hot gram is sent window by window, each a suffix of its own.
    """
    held_bounds, held_hot = (rows.sparkSession.sparkContext.broadcast(x) for x in (bounds, hot))
    n_ranges = len(bounds) + 1
    per_range, run_length = -(-n_parts // n_ranges), RUN

    def emit(held: list[tuple]) -> pa.RecordBatch:
        right, left, meta, part = (np.concatenate(x) for x in zip(*held, strict=True))
        wide = np.zeros((len(right), -(-LENGTH // 8) * 8), np.uint8)
        wide[:, :LENGTH] = right
        columns = wide.view(">u8")
        before = np.zeros((len(left), -(-WINDOW // 8) * 8), np.uint8)
        before[:, :WINDOW] = np.where(np.arange(WINDOW) < meta["far"][:, None], left, 0)
        with np.errstate(over="ignore"):
            side = (before.view("<u8") * powers(before.shape[1] // 8, 0xD6E8FEB86659FD93)).sum(1, dtype=np.uint64)
        order = np.lexsort((meta["at"], meta["doc"], meta["far"], meta["near"], side, *(columns[:, k] for k in range(columns.shape[1])[::-1]), part))
        right, before, meta, part = right[order], before[order, :WINDOW], meta[order], part[order]
        new = differs(part) | differs(right) | differs(before) | differs(meta["near"]) | differs(meta["far"])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = meta[~new & ((meta["doc"] != meta["doc"][first]) | (meta["at"] != meta["at"][first]))]
        found = record(FOUND, key=gone["key"], low=gone["at"] - gone["far"], span=gone["far"] - gone["near"])
        right, before, meta, part = right[new], before[new], meta[new], part[new]
        unlike = np.ones((len(right), LENGTH + 1), bool)
        unlike[1:, :LENGTH] = right[1:] != right[:-1]
        common = unlike.argmax(1)
        edge = np.r_[np.flatnonzero(differs(part)), len(part)]
        common[edge[:-1]] = 0
        shown = np.arange(LENGTH) >= common[:, None]
        sides = np.arange(WINDOW) < meta["far"][:, None]
        rest = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rest.append((int(part[a]), meta[a:b].tobytes(), common[a:b].astype(np.uint8).tobytes(), right[a:b][shown[a:b]].tobytes(), before[a:b][sides[a:b]].tobytes(), None))
        return sent(rest + [(p, None, None, None, None, d) for p, d in dealt(found["key"] % n_parts, found)], "meta", "common", "rest", "before", "found")

    def suffixes(text: np.ndarray, key: int, doc: int, work: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bytes from each place on and before it, what is known of it, and its part."""
        far, near, at = work["left"].astype(np.int64), work["left"].astype(np.int64) - work["span"], work["low"].astype(np.int64) + work["left"]
        many, hot = np.zeros(len(work), bool), held_hot.value
        if len(hot):
            with np.errstate(over="ignore"):
                gram = mix(row_hashes(sliding_window_view(text, GRAM)[at + WINDOW], powers(GRAM))) & SHORT
            many = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
        times = np.where(many, far - near + 1, 1)
        which = np.repeat(np.arange(len(work)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        each = many[which]
        at = np.where(each, at[which] - near[which] - nth, at[which])
        far, near = np.where(each, 0, far[which]), np.where(each, 0, near[which])
        right = sliding_window_view(text, LENGTH)[at + WINDOW]
        left = sliding_window_view(text, WINDOW)[at][:, ::-1]
        part = np.searchsorted(held_bounds.value, np.ascontiguousarray(right[:, :GRAM]).view(f"S{GRAM}").ravel(), "right") * per_range
        with np.errstate(over="ignore"):
            if per_range > 1:
                part += (mix(row_hashes(right[:, :GRAM], powers(GRAM))) % np.uint64(per_range)).astype(np.int64)
            if each.any():
                whole = mix(row_hashes(right[each], powers(LENGTH)))
                part[each] = n_ranges * per_range + (whole % np.uint64(n_parts)).astype(np.int64)
        meta = record(SUFFIX, doc=np.full(len(at), doc), key=np.full(len(at), key), at=at, near=near, far=far)
        return right, left, meta, part

    def run(batches):
        unpack, held, n = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for key, doc, packed, work in zip(*(batch.column(k) for k in range(4)), strict=True):
                text = np.frombuffer(b"\0" * WINDOW + unpack.decompress(packed.as_py()) + b"\0" * LENGTH, np.uint8)
                work = np.frombuffer(work.as_py(), WORK)
                for a in range(0, len(work), STEP_PLACES):
                    held.append(suffixes(text, key.as_py(), doc.as_py(), work[a : a + STEP_PLACES]))
                    n += len(held[-1][0])
                    if n >= run_length:
                        yield emit(held)
                        held, n = [], 0
        if n:
            yield emit(held)

    return rows.mapInArrow(lean(run), "part int, meta binary, common binary, rest binary, before binary, found binary")


def front_decoded(common: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for k in common.tolist():
        last = last[:k] + rest[at : at + LENGTH - k]
        at += LENGTH - k
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Run, place in the run, and common prefix with the string before, of the strings of sorted runs in sorted order.

    A loser tree: each inner node keeps the loser of its match and how long a prefix it shares with the winner that passed. All strings that
    meet share known prefixes with the last winner; the longer one wins unread, and equal ones are compared from there on.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    at = [0] * size
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    node: list[tuple[int, int]] = [(0, 0)] * size

    def match(a: int, ka: int, b: int, kb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix with the last winner, loser and its prefix with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, ka, b, 0
        if x is None:
            return b, kb, a, 0
        if ka > kb:
            return a, ka, b, kb
        if kb > ka:
            return b, kb, a, ka
        k = ka
        while k < LENGTH and x[k] == y[k]:
            k += 1
        if k == LENGTH or x[k] < y[k]:
            return a, ka, b, k
        return b, kb, a, k

    def build(i: int) -> tuple[int, int]:
        if i >= size:
            return i - size, 0
        winner, kw, loser, kl = match(*build(2 * i), *build(2 * i + 1))
        node[i] = (loser, kl)
        return winner, kw

    winner, common = build(1)
    out_run, out_at, out_common = [], [], []
    while head[winner] is not None:
        out_run.append(winner)
        out_at.append(at[winner])
        out_common.append(common)
        at[winner] += 1
        strings, shared = runs[winner]
        if at[winner] < len(strings):
            head[winner], common = strings[at[winner]], shared[at[winner]]
        else:
            head[winner], common = None, 0
        i = (size + winner) // 2
        while i:
            winner, common, loser, kl = match(winner, common, *node[i])
            node[i] = (loser, kl)
            i //= 2
    return out_run, out_at, out_common


def merge(runs: DataFrame, n_parts: int) -> DataFrame:
    """Step 3, the merge: key and spans of the repeats among sorted suffixes."""

    def run(part, rows):
        found = loaded(rows.column("found"), FOUND)
        low = found["low"].astype(np.int64)
        key, start, stop = [found["key"].astype(np.int64)], [low], [low + found["span"] + LENGTH]
        sides = [(a, b, c, d) for a, b, c, d in zip(*(rows.column(x).to_pylist() for x in ("meta", "common", "rest", "before")), strict=True) if a]
        if sides:
            commons = [np.frombuffer(b, np.uint8) for _, b, _, _ in sides]
            which, at, common = merge_runs([(front_decoded(k, c), k.tolist()) for k, (_, _, c, _) in zip(commons, sides, strict=True)])
            first = np.cumsum([0, *map(len, commons)])
            order, common = first[np.array(which)] + np.array(at), np.array(common)
            meta = np.concatenate([np.frombuffer(a, SUFFIX) for a, _, _, _ in sides])
            left = np.zeros((len(meta), WINDOW), np.uint8)
            left[np.arange(WINDOW) < meta["far"][:, None]] = np.frombuffer(b"".join(d for _, _, _, d in sides), np.uint8)
            meta, left = meta[order], left[order]
            code = powers(WINDOW, 0xD6E8FEB86659FD93)
            with np.errstate(over="ignore"):
                whole = row_hashes(left, code, meta["far"])
            # suffixes of equal bytes and windows: all but the first repeat it whole
            same = np.cumsum(common < LENGTH)
            o_order, new, repeat = repeats([same, meta["near"], meta["far"], whole], meta["doc"], meta["at"])
            gone = meta[o_order[repeat]]
            low = gone["at"].astype(np.int64) - gone["far"]
            key.append(gone["key"])
            start.append(low)
            stop.append(low + (gone["far"] - gone["near"]) + LENGTH)
            own = np.sort(o_order[new])
            nearest = np.minimum.reduceat(common, np.r_[0, own[:-1] + 1]) if len(own) else common[:0]
            meta, left, common = meta[own], left[own], nearest
            near, far = meta["near"].astype(np.int64), meta["far"].astype(np.int64)
            behind = np.zeros(len(meta), np.uint64)
            for o in range(WINDOW):
                own = np.flatnonzero((near <= o) & (o <= far))
                if len(own) > 1:
                    group = np.cumsum(common < LENGTH - o)[own]
                    s = meta["at"][own].astype(np.int64) - o
                    o_order, _, repeat = repeats([group, behind[own]], meta["doc"][own], s)
                    gone = o_order[repeat]
                    key.append(meta["key"][own][gone])
                    start.append(s[gone])
                    stop.append(s[gone] + LENGTH)
                with np.errstate(over="ignore"):
                    behind += BYTE_CODE[left[:, o]] * code[o]
        keys, low, high = merged_spans(np.concatenate(key), np.concatenate(start), np.concatenate(stop))
        spans = np.stack([low, high], 1).astype("<u4")
        every = np.unique(keys)
        cut = zip(np.searchsorted(keys, every), np.searchsorted(keys, every, "right"), strict=True)
        return pa.table({"key": pa.array(every.astype(np.int64)), "spans": pa.array([spans[a:b].tobytes() for a, b in cut], pa.binary())})

    return runs.repartition(n_parts, "part").groupBy("part").applyInArrow(lean(run), "key long, spans binary")


def packed(docs: DataFrame, text: str) -> DataFrame:
    """docs with its text as zstd bytes, which is what the joins by document shuffle."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, ends = text_bytes(batch.column(names.index(text)))
            raw = memoryview(data)
            small = pa.array([pack.compress(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([small if c == text else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(lean(run), schema)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with RESULT and, where wanted, without its repeated passages; else without the text. A character that loses some bytes goes."""
    docs = docs.drop(*(x.split()[0] for x in RESULT.split(", ")), "row_key", "all_spans", "row_of")
    least_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_key = F.xxhash64(F.lit(1), doc_id, text)
    n_rows, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n_parts = max(least_parts, -(-n_bytes // PART_BYTES))
    keyed = docs.select(row_key.alias("key"), F.col(text).alias("text"))
    known = checkpoint(by_document(open_places(pick(keyed, n_parts), n_parts), n_parts))
    n_work = known.agg(F.sum("n_work")).first()[0] or 0
    n_merges = max(least_parts, -(-n_work // MERGE_SUFFIXES))
    hot = np.concatenate([np.zeros(0, HOT), *(np.frombuffer(r[0], HOT) for r in known.select("hot").filter("hot IS NOT NULL").collect())])
    hot = np.unique(hot["gram"][hot["n"] > max(SPLIT_LEAST, n_work // (2 * n_merges))])
    bounds = range_bounds(keyed, n_rows, min(MOST_RANGES, n_merges))
    whole = packed(docs.withColumn("row_key", row_key), text)
    todo = known.filter("n_work > 0").select(F.col("key").alias("todo_key"), "work")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_ID).cast("long"))
    work = whole.join(todo, F.col("row_key") == F.col("todo_key")).select(F.col("row_key").alias("key"), doc.alias("doc"), F.col(text).alias("packed"), "work")
    spans = merge(suffix_runs(work, bounds, hot, n_merges), n_merges)
    spans = spans.groupBy(F.col("key").alias("row_of")).agg(F.collect_list("spans").alias("all_spans"))
    rows = whole.join(spans, F.col("row_key") == F.col("row_of"), "left").drop("row_key", "row_of")
    names = [c for c in rows.columns if c != "all_spans"]
    kept = [c for c in names if keep_text or c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), RESULT])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, out = [], [[], [], [], []]
            for small, lists in zip(batch.column(text).to_pylist(), batch.column("all_spans").to_pylist(), strict=True):
                data = unpack.decompress(small)
                n, n_gone, n_spans, left = len(data), 0, 0, data
                if lists:
                    pairs = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in lists]).astype(np.int64)
                    _, low, high = merged_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                    n_gone, n_spans = int((high - low).sum()), len(low)
                    left = b"".join(data[a:b] for a, b in zip(np.r_[0, high], np.r_[low, n], strict=True))
                for column, value in zip(out, (n, n_gone, n_spans, hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(value)
                if keep_text:
                    texts.append(left.decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in kept]
            figures = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *figures], names=[*kept, *(x.split()[0] for x in RESULT.split(", "))])

    return rows.mapInArrow(lean(run), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages. One that loses everything is gone."""

    def step(d: DataFrame) -> DataFrame:
        out = remove_repeats(d).filter("n_removed = 0 OR n_removed < n_bytes")
        return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

    return sheltered(docs, step)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
o AS (SELECT doc_id, s, coalesce(s > 100 + lag(s) OVER (PARTITION BY doc_id ORDER BY s), true) AS opens FROM f),
i AS (SELECT doc_id, s, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM o),
p AS (SELECT doc_id, min(s) AS low, max(s) + 100 AS high FROM i GROUP BY doc_id, island),
q AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS from_ FROM p),
k AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, max(high) AS last,
        string_agg(substr(h, 2 * from_ + 1, 2 * (low - from_)), '' ORDER BY low) AS kept FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
