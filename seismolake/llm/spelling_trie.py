"""Spelling variants: words at distance one, and the commoner word that a rare one is a form of.

The vocabulary is a trie that is partitioned by prefixes. A prefix with more than LEAF_WORDS words below it is heavy; a word belongs to the partition of its first prefix (of growing lengths) that isn't.
Each partition joins its part of the trie with itself: walking down, every node carries its active nodes, those at distance one that further equal letters may still bring to a word. Siblings, the parent and
children of a node become active for it, active nodes follow its letters, and where a word ends the active nodes with words of their own give the pairs.

Above the partitions, on heavy nodes, an active node whose one edit is spent can only follow equal letters, wherever these lead: that is an equality of what is left of both words, so these pairs
are a join by heavy node and rest, in which a key has a word for each letter at most. A pair is found where its words first differ, so once.

A null text has no words, a null id is written as nothing before the colon, repeated rows count each, further columns are dropped. Ties among near words of one count go to the smallest in code-point
order. Words of any length take part: a partition keeps what follows a branch as one piece. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, split_join, table, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One in so many runs (by hash) loses a letter.
SLIP = 199
#: A form has this many times a word's occurrences.
TIMES = 5
#: Words below a prefix from which it is heavy, so at most as many are in a partition.
LEAF_WORDS = 4096
#: Different words that a task counts before it hands them on, and the length from which a text's runs aren't listed at once.
HELD_WORDS, LONG_TEXT = 400_000, 1 << 22
LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased (A-Z only) runs of letters that are long and common enough; one in `slip` runs of a document has lost a letter."""

    def run(batches):
        # shorter runs can't give a word
        find = re.compile(f"[{LETTERS}]{{{least_length},}}")
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, times in Counter(find.findall(text) if len(text) < LONG_TEXT else (m.group() for m in find.finditer(text))).items():
                    word = word.lower() if word.isascii() else word.translate(LOWER)
                    code = zlib.crc32(word.encode(), seed)
                    if code % slip == 0:
                        at = code % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += times
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(lean(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def depths(longest: int) -> list[int]:
    """Lengths of prefixes that may bound a partition: each up to eight, then half as long again."""
    out = [0]
    while out[-1] < longest:
        out.append(out[-1] + 1 if out[-1] < 8 else out[-1] * 3 // 2)
    return out


def parted(words: DataFrame, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """words with leaf, the length of the first prefix that isn't heavy; one more than the word's length if all are."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    ladder = F.filter(F.array(*(F.lit(d) for d in depths(longest))), lambda d: d <= F.length("word"))
    prefixes = words.select("word", F.explode(ladder).alias("depth")).withColumn("key", F.xxhash64("depth", F.expr("substring(word, 1, depth)")))
    heavy = written(prefixes.groupBy("key").agg(F.count("*").alias("below")).filter(F.col("below") > leaf_words).withColumnRenamed("key", "heavy"), "heavy")
    light = split_join(prefixes, heavy, "key", "heavy", "below", "word", "left").groupBy("word").agg(F.min(F.when(F.col("heavy").isNull(), F.col("depth"))).alias("leaf"))
    return words.join(light, "word").withColumn("leaf", F.coalesce("leaf", F.length("word") + 1))


class Trie:
    """The part of the trie below a prefix. A node has children by letter, or a tail: what is left of the only word below it."""

    def __init__(self, words: list[str], depth: int):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.tail: list[str | None] = [None]
        waiting = [(0, 0, len(words), depth)]
        while waiting:
            node, low, high, at = waiting.pop()
            if high - low == 1 and node:
                self.word[node], self.tail[node] = low, words[low][at:]
                continue
            if len(words[low]) == at:
                self.word[node] = low
                low += 1
            while low < high:
                letter, stop = words[low][at], low + 1
                while stop < high and words[stop][at] == letter:
                    stop += 1
                child = self.children[node][letter] = len(self.word)
                self.children.append({})
                self.word.append(-1)
                self.tail.append(None)
                waiting.append((child, low, stop, at + 1))
                low = stop

    def follow(self, active: list[tuple[int, int]], letter: str) -> list[tuple[int, int]]:
        """Active places (node, letters of its tail that are behind) after one more equal letter."""
        out = []
        for node, at in active:
            tail = self.tail[node]
            if tail is None:
                child = self.children[node].get(letter)
                if child is not None:
                    out.append((child, 0))
            elif tail[at : at + 1] == letter:
                out.append((node, at + 1))
        return out

    def ends(self, node: int, at: int, rest: str) -> int:
        """The word that is reached from a place by exactly these letters, or -1."""
        for k, letter in enumerate(rest):
            if self.tail[node] is not None:
                return self.word[node] if self.tail[node][at:] == rest[k:] else -1
            node, at = self.children[node].get(letter, -1), 0
            if node < 0:
                return -1
        return self.word[node] if not self.tail[node] or len(self.tail[node]) == at else -1

    def pairs(self) -> tuple[list[int], list[int]]:
        """Words at distance one, each pair in both directions."""
        left, right = [], []
        waiting = [(0, [(c, 0) for c in self.children[0].values()])]
        while waiting:
            node, active = waiting.pop()
            word = self.word[node]
            if word >= 0:
                rest = self.tail[node] or ""
                near = {self.ends(y, at, rest) for y, at in active} - {-1, word}
                left += [word] * len(near)
                right += near
            children = self.children[node]
            for letter, child in children.items():
                more = self.follow(active, letter)
                more.append((node, 0))
                more += [(c, 0) for c in children.values() if c != child]
                more += [(c, 0) for c in self.children[child].values()]
                waiting.append((child, list(dict.fromkeys(more))))
        return left, right


PAIR = "word string, near string, near_n long"


def within(words: DataFrame) -> DataFrame:
    """Pairs inside the partitions."""

    def run(key, rows):
        rows = rows.sort_by("word")
        texts, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
        left, right = Trie(texts, key[0].as_py()).pairs()
        return pa.table([pa.array([texts[k] for k in left], pa.string()), pa.array([texts[k] for k in right], pa.string()), pa.array([counts[k] for k in right], pa.int64())], names=["word", "near", "near_n"])

    return words.filter(F.col("leaf") <= F.length("word")).withColumn("prefix", F.expr("substring(word, 1, leaf)")).groupBy("leaf", "prefix").applyInArrow(lean(run), PAIR)


def between(words: DataFrame) -> DataFrame:
    """Pairs whose words part on a heavy node: both have the same rest, after one lost a letter there, or both did."""
    at = F.explode(F.sequence(F.lit(0), F.least(F.col("leaf") - 1, F.length("word")))).alias("at")
    placed = words.filter("leaf > 0").select("word", "n", at)
    kept = F.struct(F.lit(True).alias("whole"), F.col("word").alias("rest"))
    cut = F.struct(F.lit(False).alias("whole"), F.expr("concat(substring(word, 1, at), substring(word, at + 2))").alias("rest"))
    places = placed.select("word", "n", "at", F.explode(F.when(F.col("at") < F.length("word"), F.array(kept, cut)).otherwise(F.array(kept))).alias("x")).select("word", "n", "at", "x.*")
    # at most one whole word a key, and one cut word for each letter
    keys = places.groupBy("at", "rest").agg(F.collect_list(F.struct("word", "n", "whole")).alias("members")).filter(F.size("members") > 1)
    both = keys.select("at", "members", F.explode("members").alias("x")).select("at", "x", F.explode("members").alias("y"))
    part = lambda c: F.expr(f"substring({c}.word, at + 1, 1)")
    return both.filter((part("x") != part("y")) & ~(F.col("x.whole") & F.col("y.whole"))).select("x.word", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def near_pairs(words: DataFrame, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """word, near, near_n: all pairs of words (word, n; each word once) that differ by one inserted, deleted or replaced code point, in both directions."""
    words = written(parted(words, leaf_words), "parted")
    return within(words).unionByName(between(words))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where following forms ends. Counts grow at each step, so there are few; each round doubles the steps."""
    held = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        held = written(held.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if held.filter("moved").isEmpty():
            return held.select("word", "root")
        held = held.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n; each word once)."""
    words = written(words, "vocabulary")
    best = near_pairs(words, leaf_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    common = -F.col("best.less") >= times * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")
    )
    formed = written(formed, "forms")
    return formed.join(roots(formed.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crcs AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(i AS BIGINT)) ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (
  SELECT run, times, xor(4294967295, list_reduce(
           flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, ord(c) - 64] END)),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM lowered, crcs),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM coded),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cuts AS MATERIALIZED (SELECT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM v, range(1, 100000) AS r(k) WHERE k <= length(word)),
maybe AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.word <> b.word WHERE length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.rest = b.word),
near AS (SELECT word, near, near_n FROM maybe 
         WHERE length(word) <> length(near) OR len(list_filter(range(1, length(word) + 1), lambda k: substr(word, k, 1) <> substr(near, k, 1))) = 1),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN ranked ON v.word = ranked.word AND place = 1),
chain AS (SELECT word, word AS root, form AS further FROM formed UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON chain.further = formed.word)
SELECT formed.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN chain ON formed.word = chain.word AND chain.further IS NULL
"""
