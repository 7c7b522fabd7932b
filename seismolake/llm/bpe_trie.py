"""Byte-level BPE by last tokens on a trie of words.

The encoding of a prefix is that of a shorter prefix and one more token, its last one, so one token a prefix is all that has to be known. The different words of a step are put into a trie, which is
walked depth first: each byte takes the longest token that ends there (an automaton over the vocabulary's bytes) or the next shorter ones, until one agrees with the last token of what is before it.
Prefixes that words share are worked out once. Two tokens agree if merging never crosses their border; this is read off the merges on both sides of it, and kept. A few hundred thousand words are kept, too, so a trie holds the words that are new.

Texts are cut into words as the library's byte-level splitter does, from classes of code points which that splitter is asked for. Strings of added tokens are tokens wherever they stand, as the library
takes them. A null text is empty: no ids, and decoded it is empty. Texts of any length are worked on in bounded pieces that end before a space. Repeated rows and null ids go through as they are; columns that
have the results' names are replaced, others carried along. Empty tables give no rows.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, steps, table, text_bytes
from .packing import vocabulary_path
from .wordcache import WordCache, kept

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are worked on together; longer texts are cut before spaces.
STEP = 1 << 21
#: Words, their bytes and pairs of tokens that a worker keeps before it starts anew.
MOST_WORDS, MOST_WORD_BYTES, MOST_PAIRS = 500_000, 16 << 20, 2_000_000
LETTER, DIGIT, WHITE, MARK = 1, 2, 3, 4
#: Endings that are words after an apostrophe. Fixed values.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
NEVER = 1 << 60
#: Keys of an automaton's state beside bytes.
TOKEN, BACK = -1, -2


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Trie:
    """A trie of different words, written down depth first: the words in order, each with the depth at which its path leaves that of the word before. Shared prefixes are there once."""

    #: Bytes of neighbouring words that are compared at once; longer common prefixes are found by halving.
    WIDTH = 24

    def __init__(self, words: list[bytes]):
        self.order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[k] for k in self.order]
        self.leaves = [0] * len(words)
        if len(words) > 1:
            heads = np.array([w[: self.WIDTH] for w in self.words], f"S{self.WIDTH}").view(np.uint8).reshape(len(words), self.WIDTH)
            differ = heads[1:] != heads[:-1]
            depth = np.where(differ.any(axis=1), differ.argmax(axis=1), self.WIDTH)
            # padding equals the byte 0, so a word's own end bounds its prefix
            size = np.fromiter(map(len, self.words), np.int64, len(words))
            self.leaves[1:] = np.minimum(depth, np.minimum(size[1:], size[:-1])).tolist()
            for k in np.flatnonzero((depth == self.WIDTH) & (np.minimum(size[1:], size[:-1]) > self.WIDTH)).tolist():
                self.leaves[k + 1] = self.common(self.words[k], self.words[k + 1])

    @staticmethod
    def common(x: bytes, y: bytes) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
        return low


class Encoder:
    """A byte-level BPE vocabulary: how texts are cut, what follows what, and the bytes of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file["pre_tokenizer"] or {}
        if model["type"] != "BPE" or file["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in file["added_tokens"]):
            raise ValueError("added tokens must stand for themselves and hold no spaces")
        self.special_in = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.kinds = np.zeros(0x110000, np.uint8)
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, number in ids.items():
            self.bytes_of[number] = bytes(alphabet[c] for c in token)
        for token, number in self.special.items():
            self.bytes_of[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.length = [len(x) for x in self.bytes_of]
        self.take_merges(ids, model["merges"])
        self.build_automaton(ids)

    def take_merges(self, ids: dict[str, int], merges: list) -> None:
        self.born, self.parts, self.rank = [-1] * self.size, [(-1, -1)] * self.size, {}
        #: Tokens that are their own encoding; others never occur.
        self.whole = [self.length[t] == 1 for t in range(self.size)]
        for rank, pair in enumerate(merges):
            x, y = (ids[p] for p in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[(pair if isinstance(pair, str) else " ".join(pair)).replace(" ", "")]
            if self.born[made] >= 0 or self.length[made] == 1 or not all(self.length[p] == 1 or self.born[p] >= 0 for p in (x, y)):
                raise ValueError("each token must come from one merge of earlier tokens")
            self.born[made], self.parts[made], self.rank[x * self.size + y] = rank, (x, y), rank
            self.whole[made] = self.whole[x] and self.whole[y] and self.apart(x, y, rank)
        if not all(bytes([b]) in {self.bytes_of[n] for n in ids.values() if self.length[n] == 1} for b in range(256)):
            raise ValueError("every byte must be a token")

    def apart(self, x: int, y: int, until: int = NEVER) -> bool:
        """Does no merge earlier than `until` cross the border of x and y? The tokens at the border are followed back in time; the pair there would have merged if its rank came before either was merged elsewhere."""
        born, parts, rank, size = self.born, self.parts, self.rank, self.size
        left = right = until
        while True:
            merge = rank.get(x * size + y)
            if merge is not None and merge < left and merge <= right:
                return merge == until
            if born[x] > born[y]:
                left, x = born[x], parts[x][1]
            elif born[y] >= 0:
                right, y = born[y], parts[y][0]
            else:
                return True

    def build_automaton(self, ids: dict[str, int]) -> None:
        """States are beginnings of tokens: dictionaries of what follows each byte, with the longest token that ends in the state and the state to fall back to. `shorter` has the next token that ends in a token."""
        self.root: dict = {TOKEN: -1, BACK: None}
        self.shorter, states = [-1] * self.size, []
        for number in sorted(ids.values()):
            if not self.whole[number]:
                continue
            state = self.root
            for depth, byte in enumerate(self.bytes_of[number]):
                found = state.get(byte)
                if found is None:
                    found = state[byte] = {TOKEN: -1, BACK: None}
                    states.append((depth, found, state, byte))
                state = found
            state[TOKEN] = number
        for depth, found, state, byte in sorted(states, key=lambda x: x[0]):
            back = state[BACK]
            while back is not None and byte not in back:
                back = back[BACK]
            found[BACK] = back[byte] if depth else self.root
            if found[TOKEN] >= 0:
                self.shorter[found[TOKEN]] = found[BACK][TOKEN]
            else:
                found[TOKEN] = found[BACK][TOKEN]
        self.agreeing: list[dict[int, bool]] = [{} for _ in range(self.size)]
        self.pairs = 0

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of different words, by one walk of their trie, depth first. `last` and `states` hold the last token and the automaton's state at each depth of the path."""
        if self.pairs > MOST_PAIRS:
            self.agreeing, self.pairs = [{} for _ in range(self.size)], 0
        plain = [k for k, w in enumerate(words) if w not in self.special]
        out = [[self.special[w]] if w in self.special else [] for w in words]
        trie = Trie([words[k].encode() for k in plain])
        shorter, length, agreeing = self.shorter, self.length, self.agreeing
        last, states = [0], [self.root]
        for number, word, at in zip(trie.order, trie.words, trie.leaves, strict=True):
            del last[at + 1 :], states[at + 1 :]
            state = states[at]
            for byte in word[at:]:
                at += 1
                found = state.get(byte)
                while found is None:
                    state = state[BACK]
                    found = state.get(byte)
                state = found
                token = state[TOKEN]
                start = at - length[token]
                while start:
                    before = last[start]
                    good = agreeing[token].get(before)
                    if good is None:
                        good = agreeing[token][before] = self.apart(before, token)
                        self.pairs += 1
                    if good:
                        break
                    token = shorter[token]
                    start = at - length[token]
                last.append(token)
                states.append(state)
            ids = []
            while at:
                token = last[at]
                ids.append(token)
                at -= length[token]
            ids.reverse()
            out[plain[number]] = ids
        return out

    def learn_kinds(self, codes: np.ndarray) -> None:
        """Asks the library's splitter what new code points are: it keeps letters with letters, digits with digits, marks with marks."""
        for code in codes.tolist():
            held = [{*range(*span)} for _, span in self.splitter.pre_tokenize_str(f"a{chr(code)}1{chr(code)}!{chr(code)}")]
            joined = lambda x, y: any(x in h and y in h for h in held)  # noqa: E731, B023
            self.kinds[code] = LETTER if joined(0, 1) else DIGIT if joined(2, 3) else MARK if joined(4, 5) else WHITE

    def words(self, text: str, edges: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The words of neighbouring texts, and how many each has; edges: where the texts begin, and the end of the last."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(codes)
        kind = self.kinds[codes]
        if n and not kind.all():
            self.learn_kinds(np.unique(codes[kind == 0]))
            kind = self.kinds[codes]
        inner = []
        if self.special_in.search(text):
            bounds = edges.tolist()
            inner = [m.span() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in self.special_in.finditer(text, a, b)]
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        for a, b in inner:
            edge[[a, b]] = True
        begins = edge[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # the last white character before a word goes by itself, or with the word if it is a space
        final = kind == WHITE
        final[:-1] &= kind[1:] != WHITE
        final &= ~edge[1:]
        begins |= final
        final &= codes == 32
        begins[1:] &= ~final[:-1]
        for at in np.flatnonzero((codes[:-1] == 39) & begins[:-1] & (kind[1:] == LETTER) & ~edge[1:n]).tolist() if n > 1 else ():
            size = next((len(e) for e in ENDINGS if text.startswith(e, at + 1) and not edge[at + 2 : at + 1 + len(e)].any()), 0)
            if size:
                begins[at + 1 : at + 1 + size] = False
                begins[at + 1 + size : at + 2 + size] = True
        for a, b in inner:
            begins[a + 1 : b] = False
        starts = np.flatnonzero(begins)
        cuts = [*starts.tolist(), n]
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.diff(np.searchsorted(starts, edges))


class BoundedCache(WordCache):
    """Words and their ids; also starts anew when the words' characters are too many."""

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def learn(self, words: list) -> None:
        self.held += sum(map(len, words))
        if self.held > MOST_WORD_BYTES and self.index:
            raise OverflowError
        super().learn(words)


def safe_cuts(data: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of about `step` bytes of a text, cut before a space that follows an ASCII letter or digit: a word begins there whatever stands around."""
    first, n = 0, len(data)
    while n - first > step:
        after = None
        for a in range(first + step, n - 1, step):
            here = data[a : a + step + 1]
            before = here[:-1] | 32
            found = np.flatnonzero((here[1:] == 32) & ((before >= 97) & (before <= 122) | (here[:-1] >= 48) & (here[:-1] <= 57)))
            if len(found):
                after = a + int(found[0]) + 1
                break
        if after is None:
            break
        yield first, after
        first = after
    yield first, n


def ids_of(column: pa.Array, encoder: Encoder, cache: WordCache, step: int = STEP) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows and the ids of each of their texts, little-endian unsigned 32-bit."""
    data, ends = text_bytes(column)
    raw = memoryview(data)
    for a, b in steps(ends, step):
        # one long text is worked on in pieces, short ones together
        ranges = [(ends[a] + x, ends[a] + y) for x, y in safe_cuts(data[ends[a] : ends[b]], step)] if b == a + 1 else [(ends[a], ends[b])]
        out: list[list[bytes]] = [[] for _ in range(b - a)]
        for x, y in ranges:
            bounds = ends[a : b + 1] if b > a + 1 else np.array([x, y])
            counted = np.concatenate([[0], np.cumsum((data[x:y] & 0xC0) != 0x80)])
            words, counts = encoder.words(str(raw[x:y], "utf-8"), counted[bounds - x])
            ids, cut = cache.encode(words, counts.tolist())
            packed, cut = ids.astype("<u4").tobytes(), cut.tolist()
            for k, held in enumerate(out):
                held.append(packed[4 * cut[k] : 4 * cut[k + 1]])
        yield a, b, [b"".join(held) for held in out]


def compiled(path: str) -> Encoder:
    encoder = Encoder(path)
    gc.freeze()  # it lives as long as the worker
    return encoder


def machine(path: str) -> Encoder:
    return kept(("trie", path), lambda: compiled(path))


def text_of(encoder: Encoder, ids: bytes | None) -> str:
    """The text of ids. Bytes that aren't UTF-8, which ids that come from no text may give, become U+FFFD."""
    return b"".join(map(encoder.bytes_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, text: str = "text", round_trip: bool = False) -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit); with round_trip also decoded, the text of the ids, from the same pass. vocabulary: a path that tasks can open."""
    more = ["ids", *["decoded"] * round_trip]
    docs = docs.drop(*more)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids binary" + ", decoded string" * round_trip])

    def run(batches):
        encoder = machine(vocabulary)
        cache = kept(("trie words", vocabulary), lambda: BoundedCache(encoder.encode_words, MOST_WORDS))
        for batch in batches:
            for a, b, ids in ids_of(batch.column(names.index(text)), encoder, cache):
                columns = [*batch.slice(a, b - a).columns, pa.array(ids, pa.binary())]
                if round_trip:
                    columns.append(pa.array([text_of(encoder, x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *more])

    return docs.mapInArrow(lean(run), schema)


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """rows with decoded, the text of their ids."""
    rows = rows.drop("decoded")
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded string"])

    def run(batches):
        encoder = machine(vocabulary)
        for batch in batches:
            texts = [text_of(encoder, x) for x in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(lean(run), schema)


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(VOCABULARY), round_trip=True)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))
