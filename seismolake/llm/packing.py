"""Harmonic packing of documents into sequences of a fixed capacity.

Every document's ids are cut into whole sequences and a rest; the rest is cut further at reciprocals of the capacity until what is
left is small or nearly fills a class's share. A piece of length in (capacity / (j + 1), capacity / j] belongs to class j, and a bin of
class j takes exactly j pieces, so workers fill bins on their own, without looking at lengths elsewhere. Small pieces have
coarser classes. What stands in a worker's unfinished bins (fewer than one capacity for each of some thirty classes) goes through a second step, which
cuts a stream of such pieces at the capacity, spread over tasks by hash; the end of each stream is cut into sequences whose
lengths are powers of two, which need no padding.

A document of any length is cut as a whole; columns beside doc_id and text are dropped. A null text is empty; an empty document is its end id alone. Repeated rows are packed one by one. Null ids of documents are carried along. An
empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lean, steps, table, text_bytes
from .wordcache import WordCache, kept

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Rests up to this length aren't cut any more.
TAIL = 256
#: A piece that fills this part of its share is not cut.
FULL = 0.97
#: Ids that a task of the second step takes.
STREAM_IDS = 8 << 20
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [x.split()[0] for x in PIECE.split(", ")]
KINDS = [pa.int64()] * 7 + [pa.binary()]


def tail_classes(capacity: int = CAPACITY) -> list[int]:
    """Pieces to a bin for the small classes, some 12 % apart."""
    out, j = [], max(1, capacity // TAIL)
    while j < 8 * (capacity // TAIL):
        out.append(j)
        j = max(j + 1, j * 9 // 8)
    return [*out, j]


def cut(total: int, capacity: int = CAPACITY, tails: list[int] | None = None) -> list[tuple[int, int]]:
    """Lengths of a document's pieces in order, each with the number of pieces to its bin."""
    tails = tails or tail_classes(capacity)
    out = [(capacity, 1)] * (total // capacity)
    rest = total % capacity
    while rest > TAIL:
        j = capacity // rest
        if rest >= FULL * (capacity // j):
            out.append((rest, j))
            rest = 0
        else:
            out.append((capacity // (j + 1), j + 1))
            rest -= capacity // (j + 1)
    if rest:
        out.append((rest, max(j for j in tails if j * rest <= capacity)))
    return out


#: Stems (words without the marks after them) that a worker keeps before it starts anew.
MOST_STEMS = 500_000
#: Words and stems of a worker that keeps none for its next task, which has less memory to itself.
LEAN_WORDS, LEAN_STEMS = 150_000, 75_000
MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
WORD_END = "</w>"
LATIN = "\xff"


def stem_of(word: str) -> str:
    """A word without the ASCII marks after its last letter or digit, lower-cased: what the tokenizer takes by itself. Special tokens, and words beyond Latin-1, stay as they are."""
    if "<|" in word or not (word.isascii() or max(word) <= LATIN):
        return word
    stem = word.rstrip(MARKS)
    return stem.lower() if stem and (stem[-1].isalpha() or stem[-1] in "0123456789") else word


def is_plain(stem: str) -> bool:
    """One run of letters, which is one word to the tokenizer."""
    return stem.isalpha() and (stem.isascii() or max(stem) <= LATIN)


def word_encoder(vocabulary: str, most_stems: int = MOST_STEMS):
    """Ids of words. This tokenizer lower-cases, and takes runs of letters, digits and runs of marks one by one, so marks are put on afterwards and the letters in common are encoded once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    known: dict[str, list[int]] = {}
    vocabulary_items = tokenizer.get_vocab()
    is_end = np.zeros(max(vocabulary_items.values()) + 1, bool)
    is_end[[i for t, i in vocabulary_items.items() if t.endswith(WORD_END)]] = True

    def learn(stems: list[str]) -> None:
        plain, rest = [], []
        for s in stems:
            (plain if is_plain(s) else rest).append(s)
        for a in range(0, len(plain), 1000):
            ids = tokenizer.encode(" ".join(plain[a : a + 1000]), add_special_tokens=False).ids
            stops = (np.flatnonzero(is_end[ids]) + 1).tolist()
            known.update(zip(plain[a : a + 1000], (ids[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)), strict=True))
        known.update(zip(rest, (x.ids for x in tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))

    def encode_many(words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        stems = [t.lower() if t.isascii() and t.isalnum() else stem_of(t) for t in texts]
        marks = [t[len(s) :] for t, s in zip(texts, stems, strict=True)]
        if len(known) > most_stems:
            known.clear()
        fresh = set(stems).union(marks).difference(known)
        fresh.discard("")
        learn(list(fresh))
        return [known[s] + known[m] if m else known[s] for s, m in zip(stems, marks, strict=True)]

    return encode_many


def encoded(column: pa.Array, cache: WordCache):
    """Ids of each text of a column, in steps. White space parts words for this tokenizer, so texts are encoded word by word."""
    data, ends = text_bytes(column)
    raw = memoryview(data)
    for a, b in steps(ends):
        words, counts = [], []
        for i in range(a, b):
            got = bytes(raw[ends[i] : ends[i + 1]]).split()
            words += got
            counts.append(len(got))
        yield a, b, *cache.encode(words, counts)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def fill(docs: DataFrame, vocabulary: str, keep_ids: bool, capacity: int = CAPACITY, keep_words: bool = True) -> DataFrame:
    """First step: PIECE rows; those of unfinished bins have no sequence, and always their ids. With keep_words workers keep their words for the next task."""

    def run(batches):
        cache = kept(("words", vocabulary), lambda: WordCache(word_encoder(vocabulary))) if keep_words else WordCache(word_encoder(vocabulary, LEAN_STEMS), LEAN_WORDS)
        tails, bins, made, rows = tail_classes(capacity), {}, 0, []
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, ends in encoded(batch.column(1), cache):
                for i in range(a, b):
                    own = np.empty(ends[i - a + 1] - ends[i - a] + 1, "<u4")
                    own[:-1], own[-1] = ids[ends[i - a] : ends[i - a + 1]], END_ID
                    start = 0
                    for length, j in cut(len(own), capacity, tails):
                        held = bins.setdefault(j, [])
                        held.append((doc_ids[i], start, own[start : start + length], len(own)))
                        start += length
                        if len(held) == j:
                            offset = 0
                            for doc_id, at, part, total in held:
                                rows.append((doc_id, at, len(part), crc(part), total, first + made, offset, part.tobytes() if keep_ids else None))
                                offset += len(part)
                            made += 1
                            del bins[j]
                if len(rows) > 5000:
                    yield batch_of(rows)
                    rows = []
        rows += [(doc_id, at, len(part), crc(part), total, None, None, part.tobytes()) for held in bins.values() for doc_id, at, part, total in held]
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(lean(run), PIECE)


def stream(rest: DataFrame, groups: int, keep_ids: bool, capacity: int = CAPACITY) -> DataFrame:
    """Second step: streams of left pieces, cut at the capacity and at the end into powers of two."""

    def run(key, rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        columns = [rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
        left = sum(rows.column("length").to_pylist())
        number, out = (1 << 62) + (key[0].as_py() << 32), []

        def room_of(n: int) -> int:
            return capacity if n >= capacity else 1 << (n.bit_length() - 1)

        room, offset = room_of(left), 0
        for doc_id, start, total, ids in zip(*columns, strict=True):
            part = np.frombuffer(ids, "<u4")
            while len(part):
                own = part[: room - offset]
                out.append((doc_id, start, len(own), crc(own), total, number, offset, own.tobytes() if keep_ids else None))
                start, part, offset = start + len(own), part[len(own) :], offset + len(own)
                if offset == room:
                    left -= room
                    number, offset = number + 1, 0
                    room = room_of(left) if left else capacity
        return pa.Table.from_batches([batch_of(out)])

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int")
    return rest.withColumn("stream", group).groupBy("stream").applyInArrow(lean(run), PIECE)


def pack(docs: DataFrame, vocabulary: str, keep_ids: bool = True, capacity: int = CAPACITY, keep_words: bool = True) -> DataFrame:
    """The pieces of docs (doc_id, text): PIECE. Without keep_ids the ids column is null."""
    pieces = checkpoint(fill(docs, vocabulary, keep_ids, capacity, keep_words))
    rest = pieces.filter(F.col("sequence_id").isNull())
    left = rest.agg(F.sum("length")).first()[0] or 0
    done = pieces.filter(F.col("sequence_id").isNotNull())
    return done.unionByName(stream(rest, max(1, -(-left // STREAM_IDS)), keep_ids, capacity))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False).drop("ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents. Workers keep no words, as the pipeline's other stages need the memory."""
    return pack(docs, vocabulary_path(), keep_ids=False, keep_words=False).drop("ids")
