"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled once per worker into a normaliser (its character map as arcs over a trie, and its rules for white space), piece arcs and byte arcs. A text is composed with
them segment by segment (no piece holds a space mark after another character, so such places part the text for certain), which gives a lattice whose arcs are weighted in the tropical
semiring. The encoding is the lattice's shortest path, found best first: of the arcs with the least cost the one that reaches furthest comes next.

* Unigram models: an arc weighs minus the piece's score.
* BPE models: a path is the encoding exactly if every two neighbours, taken together, are encoded as these two. So an arc weighs 0 after a
  piece it agrees with and infinity after any other. Agreement is found by merging the two pieces' characters, once per pair, and only when an arc's turn comes. The encoding of each
  prefix is unique, so one state per place is enough.

A character without a piece takes its byte pieces, or the unknown piece where a model has none. Decoding concatenates the pieces' bytes; with the identity normaliser it gives
back the text, but that U+2581 comes back as a space. Models that mark white space at the end of words or don't escape it are refused. A null text is empty and has no ids; an empty
table gives an empty table; repeated rows are encoded one by one; other columns are carried through, those that clash with a result's are replaced. A very long text is worked on as a whole.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, steps, table, text_bytes
from .packing import vocabulary_path
from .wordcache import WordCache, kept

MODEL = "piece_bpe_32k.model"
SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Agreeing pairs that a worker remembers before it starts anew.
MOST_PAIRS = 300_000
#: Parts of segments, and segments, that it remembers.
MOST_PARTS = 400_000
MOST_SEGMENTS = 400_000


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            value = data[i : i + size]
            i += size
        out.append((key >> 3, value))
    return out


class Normaliser:
    """The model's character map and white space rules. The map is a double-array trie; it is read into arcs from (state, byte) to state, and replacements by state."""

    def __init__(self, spec: dict[int, int | bytes]):
        self.squeeze = bool(spec.get(4, 1))
        self.next: dict[tuple[int, int], int] = {}
        self.gives: dict[int, str] = {}
        data = spec.get(2, b"")
        if data:
            size = int.from_bytes(data[:4], "little")
            units, texts = np.frombuffer(data, "<u4", size // 4, 4).tolist(), data[4 + size :]
            base = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
            todo = [(0, 0)]  # state of the map here, place in the array
            n_states = 1
            while todo:
                state, at = todo.pop()
                down = at ^ base(units[at])
                if units[at] >> 8 & 1:
                    start = units[down] & 0x7FFFFFFF
                    self.gives[state] = texts[start : texts.index(b"\0", start)].decode()
                for byte in range(1, 256):
                    child = down ^ byte
                    if child < len(units) and units[child] & 0x800000FF == byte:
                        self.next[state, byte] = n_states
                        todo.append((n_states, child))
                        n_states += 1
        self.identity = not data and not self.squeeze

    def mapped(self, text: str) -> str:
        """The text with the longest matches of the character map replaced, from the left."""
        raw, out, at = text.encode(), [], 0
        while at < len(raw):
            state, end, found, got = 0, at, -1, ""
            while end < len(raw) and (state := self.next.get((state, raw[end]), -1)) >= 0:
                end += 1
                if state in self.gives:
                    found, got = end, self.gives[state]
            if found < 0:
                found = at + 1
                while found < len(raw) and raw[found] & 0xC0 == 0x80:
                    found += 1
                got = raw[at:found].decode()
            out.append(got)
            at = found
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.mapped(text) if self.next else text
        return re.sub(" +", " ", text.lstrip(" ").rstrip(" " + SPACE_MARK)) if self.squeeze else text


class Transducer:
    def __init__(self, model: bytes):
        top = fields(model)
        trainer, normaliser = (dict(f for k, v in top if k == part for f in fields(v)) for part in (2, 3))
        if trainer.get(24) or not normaliser.get(5, 1):
            raise ValueError("models must mark white space at the start of words and escape it")
        self.normalise = Normaliser(normaliser)
        self.kind, self.prefix = trainer.get(3, UNIGRAM), bool(normaliser.get(3, 1))
        self.pieces, self.byte_ids, self.unknown, self.out = {}, [0] * 256, 0, []
        lowest = 0.0
        for number, (_, value) in enumerate((k, v) for k, v in top if k == 1):
            piece = dict(fields(value))
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            score = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
            self.out.append(text.replace(SPACE_MARK, " ").encode())
            if kind == BYTE:
                byte = int(text[1:-1], 16)
                self.byte_ids[byte], self.out[-1] = number, bytes([byte])
            elif kind == UNKNOWN:
                self.unknown = number
            elif kind in (NORMAL, USER):
                self.pieces[text] = (number, score)
                lowest = min(lowest, score)
            if kind == CONTROL:
                self.out[-1] = b""
        self.bytes_from = min(self.byte_ids) if any(self.byte_ids) else -1
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.pieces) or any("\n" in p[1:] or (p[:1] == "\n" and len(p) > 1) for p in self.pieces):
            raise ValueError("pieces may hold space marks only at their start, and no line ends")
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_cost = 10.0 - lowest
        self.size, self.agreeing = len(self.out), {}
        self.parts: dict[str, list[int]] = {}
        self.inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        #: What pieces start with: the number of the piece, or -1 where it isn't one itself.
        self.arcs = {p[:k]: -1 for p in self.pieces for k in range(1, len(p) + 1)} | {p: number for p, (number, _) in self.pieces.items()}
        self.cost = [0.0] * self.size
        if self.kind != BPE:
            for number, score in self.pieces.values():
                self.cost[number] = -score

    def merged(self, text: str) -> list[str]:
        """Characters merged by score, the leftmost of equal scores first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.pieces.get(parts[k] + parts[k + 1])
                if piece and (best is None or piece[1] > best):
                    best, at = piece[1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: str, left_id: int, right: str, right_id: int) -> bool:
        """Are the two pieces, taken together, encoded as these two? An empty left asks whether the right one is a piece by itself."""
        key = (left_id + 2) * self.size + right_id
        got = self.agreeing.get(key)
        if got is None:
            if len(self.agreeing) >= MOST_PAIRS:
                self.agreeing.clear()
            got = self.agreeing[key] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def path(self, segment: str) -> list[tuple[str, int]]:
        """Pieces and their ids (-1 where there is no piece) on the shortest path through a segment's lattice, in the tropical semiring.

        Arcs wait with the least cost that they can have; an arc is weighed when its turn comes, and a place is settled by the first arc of finite weight that reaches it.
        """
        n, arcs, costs, bpe = len(segment), self.arcs, self.cost, self.kind == BPE
        no_piece = 0.0 if bpe else self.unknown_cost
        came: list[tuple[int, str, int] | None] = [None] * (n + 1)
        waiting: list[tuple[float, int, str, int]] = []
        at, cost = 0, 0.0
        push, pop, agree = heapq.heappush, heapq.heappop, self.agree
        while at < n:
            first = segment[at]
            number = arcs.get(first)
            if number is None or number < 0:
                push(waiting, (cost + no_piece, -at - 1, first, -1))
            elif came[at + 1] is None:
                push(waiting, (cost + costs[number], -at - 1, first, number))
            end = at + 2
            while end <= n and number is not None:
                piece = segment[at:end]
                number = arcs.get(piece)
                if number is not None and number >= 0 and came[end] is None:
                    push(waiting, (cost + costs[number], -end, piece, number))
                end += 1
            while True:
                cost, end, piece, number = pop(waiting)
                end = -end
                if came[end] is not None:
                    continue
                start = end - len(piece)
                before = came[start]
                # a neighbour without a piece merges with nothing, so the right one stands by itself
                if not bpe or number < 0 or (agree(before[1], before[2], piece, number) if before is not None and before[2] >= 0 else agree("", -2, piece, number)):
                    came[end] = (start, piece, number)
                    at = end
                    break
        out = []
        while at:
            start, piece, number = came[at]
            out.append((piece, number))
            at = start
        return out[::-1]

    def ids(self, segment: str) -> list[int]:
        """A segment's ids. Where two characters stand next to each other in no piece, the lattice falls into parts for certain; parts are remembered."""
        inside, out, start = self.inside, [], 0
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in inside:
                out += self.part_ids(segment[start:k])
                start = k
        return out + self.part_ids(segment[start:]) if out else self.part_ids(segment)

    def part_ids(self, part: str) -> list[int]:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= MOST_PARTS:
                self.parts.clear()
            got = self.parts[part] = self.path_ids(part)
        return got

    def path_ids(self, segment: str) -> list[int]:
        out = []
        for piece, number in self.path(segment):
            if number >= 0:
                out.append(number)
            elif self.bytes_from >= 0:
                out += [self.byte_ids[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        """Keys of a text's segments: a line end and what follows it, or what follows a space mark (kept only where there are several)."""
        if not self.normalise.identity:
            text = self.normalise(text)
        if not text:
            return []
        if self.prefix and SPACE_MARK not in text:
            plain = text.replace("\n", " \n")
            if plain[0] not in " \n" and plain[-1] != " " and "  " not in plain:
                return plain.split(" ")
        whole = (SPACE_MARK if self.prefix else "") + text.replace(" ", SPACE_MARK)
        keys = re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}\n]*|\n[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+", whole)
        return [k[1:] if k[0] == SPACE_MARK and len(k) > 1 and k[1] != SPACE_MARK else k if k[0] in SPACE_MARK + "\n" else "\n\n" + k for k in keys]

    def ids_of_key(self, key: str) -> list[int]:
        if key.startswith("\n\n"):
            return self.ids(key[2:])
        return self.ids(key if key[0] in SPACE_MARK + "\n" else SPACE_MARK + key)

    def encode(self, text: str) -> list[int]:
        return [i for k in self.segments(text) for i in self.ids_of_key(k)]

    def decode(self, ids: list[int]) -> bytes:
        joined = b"".join(map(self.out.__getitem__, ids))
        return joined[1:] if self.prefix and joined[:1] == b" " else joined


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str, text: str = "text", round_trip: bool = False) -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit) and n_fallback, the number of byte pieces; with round_trip also decoded, the text of the ids, from the same pass.
    model: a path that tasks can open."""
    more = ["ids", "n_fallback", *["decoded"] * round_trip]
    docs = docs.drop(*more)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids binary, n_fallback long" + ", decoded string" * round_trip])

    def run(batches):
        machine = kept(("transducer", model), lambda: Transducer(model_bytes(model)))
        low, high = machine.bytes_from, machine.bytes_from + 256
        cache = kept(("segments", model), lambda: WordCache(lambda words: [machine.ids_of_key(w) for w in words], MOST_SEGMENTS))
        for batch in batches:
            data, ends = text_bytes(batch.column(names.index(text)))
            raw = memoryview(data)
            for a, b in steps(ends):
                words, counts = [], []
                for i in range(a, b):
                    got = machine.segments(str(raw[ends[i] : ends[i + 1]], "utf-8"))
                    words += got
                    counts.append(len(got))
                ids, bounds = cache.encode(words, counts)
                fallback = np.concatenate([[0], np.cumsum((ids >= low) & (ids < high) & (low >= 0))])
                packed = ids.astype("<u4").tobytes()
                own = [packed[4 * x : 4 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [*batch.slice(a, b - a).columns, pa.array(own, pa.binary()), pa.array(np.diff(fallback[bounds]), pa.int64())]
                if round_trip:
                    columns.append(pa.array([machine.decode(ids[x:y].tolist()).decode("utf-8", "replace") for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *more])

    return docs.mapInArrow(lean(run), schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows with decoded, the text of their ids."""
    rows = rows.drop("decoded")
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded string"])

    def run(batches):
        machine = kept(("transducer", model), lambda: Transducer(model_bytes(model)))
        for batch in batches:
            texts = [machine.decode(np.frombuffer(x or b"", "<u4").tolist()).decode("utf-8", "replace") for x in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(lean(run), schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary_path(MODEL)
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, round_trip=True)
    whole = F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE_MARK), F.lit(" "))
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        "n_fallback",
        (F.col("decoded") == whole).alias("round_trip"),
    )
