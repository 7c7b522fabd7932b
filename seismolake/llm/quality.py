"""Quality rules of documents and of their hosts.

Each document is held against fixed rules. The failures are summed by host (the column named `host`), every host's failure
rate is shrunk towards the corpus by a beta prior whose two parameters are fitted to all hosts by the method of moments, and
the hosts' verdicts are joined back to the documents. A document stays if it passes the rules itself and its host's shrunken
rate is at most `worst_rate`.

Nulls: a null text has no words and so fails; a null host is a host of its own. An empty table gives an empty table.
Repeated rows are judged and counted one by one; ties in a text (equal lines) count from the second on. A very long text is measured as a whole. Columns beside the named ones are carried through; those whose names clash
with a result's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import SPACE, checkpoint, lean, sheltered, span_hashes, split_join, steps, table, text_bytes, window_hashes, words, written

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: A host is refused if more than this part of its documents would fail, after shrinkage.
WORST_RATE = 0.75
#: More hosts than this are joined by a shuffle instead of a broadcast.
BROADCAST_HOSTS = 100_000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measures(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a step."""
    n = len(ends) - 1
    start, end, row = words(data, ends)
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_row(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(SYMBOL[data]),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    raw = data.tobytes()
    for i in np.flatnonzero(per_row(data == 10)):
        out["n_dup_lines"][i] = repeated_lines(raw[ends[i] : ends[i + 1]])
    value, at = window_hashes(span_hashes(data, start, end), row, WINDOW)
    if len(at):
        order = np.lexsort((value, row[at]))
        same = (value[order][1:] == value[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(row) + WINDOW + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(row[np.cumsum(edge)[: len(row)] > 0], minlength=n)
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS and base_failed."""
    docs = docs.drop(*COUNTS, "base_failed")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} long" for c in COUNTS)])
    names = docs.columns

    def run(batches):
        for batch in batches:
            data, ends = text_bytes(batch.column(names.index(text)))
            for a, b in steps(ends):
                with np.errstate(over="ignore"):
                    got = measures(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=[*names, *COUNTS])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return docs.mapInArrow(lean(run), schema).withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, host: str = "source", worst_rate: float = WORST_RATE) -> DataFrame:
    """One row per host: host, host_docs, host_failures, host_rate (shrunken), host_kept.

    The prior is beta(a, b). Its mean is the documents' failure rate; a + b follows from the variance of the hosts' rates
    beyond what chance alone gives. With no such variance the hosts are taken as alike, and a + b is very large.
    """
    by = rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    n, k = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    total = by.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count("*").alias("hosts"), F.sum(n * n).alias("nn")).withColumn("m", F.col("k") / F.col("n"))
    spread = by.crossJoin(F.broadcast(total)).agg(
        F.first("m").alias("m"),
        F.sum(n * (k / n - F.col("m")) * (k / n - F.col("m"))).alias("s"),
        F.first("n").alias("all_n"), F.first("hosts").alias("hosts"), F.first("nn").alias("nn"),
    )
    m = F.col("m")
    chance = m * (1 - m)
    scale = F.col("all_n") - F.col("nn") / F.col("all_n")
    between = F.when(scale > 0, (F.col("s") - (F.col("hosts") - 1) * chance) / scale)
    weight = F.when((chance <= 0) | between.isNull() | (between <= chance * 1e-6), F.lit(1e6)).otherwise(F.greatest(chance / between - 1, F.lit(1e-3)))
    prior = spread.select((m * weight).alias("a"), ((1 - m) * weight).alias("b"))
    rate = (F.col("host_failures") + F.col("a")) / (F.col("host_docs") + F.col("a") + F.col("b"))
    return by.crossJoin(F.broadcast(prior)).withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= worst_rate).drop("a", "b")


def with_verdicts(rows: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """rows with their host's columns, and kept. Few hosts are broadcast; many are joined with large hosts split over several tasks."""
    held = checkpoint(hosts)
    rows = rows.drop(*(c for c in held.columns if c != host and c in rows.columns), "kept")
    if held.count() <= BROADCAST_HOSTS:
        out = rows.join(F.broadcast(held), F.col(host).eqNullSafe(F.col("host")), "left")
    else:
        # a null host is one, too; rows of one host are dealt by all that they hold of plain columns
        plain = [f.name for f in rows.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
        rows = rows.withColumns({"host_key": F.to_json(F.struct(F.col(host).alias("h"))), "row_hash": F.xxhash64(*(f"`{c}`" for c in plain))})
        held = held.withColumn("of_key", F.to_json(F.struct(F.col("host").alias("h"))))
        out = split_join(rows, held, "host_key", "of_key", "host_docs", "row_hash", "left").drop("host_key", "row_hash", "of_key")
    return out.drop("host").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep_text: bool = True) -> DataFrame:
    """docs (without their text if it isn't to be kept) with their counts, base_failed, their host's figures, and kept.

    Without the text, the counts are a table that both the hosts' rates and the result read, and texts are measured once. With it they are measured twice, as such a table would be a copy of the corpus.
    """
    if keep_text:
        return with_verdicts(measured(docs, text), host_verdicts(measured(docs.select(F.col(text).alias("text"), F.col(host).alias("host_of"))), "host_of"), host)
    rows = written(measured(docs, text).drop(text), "measured")
    return with_verdicts(rows, host_verdicts(rows, host), host)


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs, keep_text=False).select("doc_id", *COUNTS, "base_failed", "kept", "source", "host_docs", "host_failures", F.round("host_rate", 9).alias("host_rate"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sheltered(docs, lambda d: judge(d).filter("kept"))


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] AS w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM c, range(8) x(o) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (
  SELECT doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS host_docs, CAST(sum(CAST(base_failed AS INT)) AS BIGINT) AS host_failures FROM b GROUP BY 1),
a AS (SELECT CAST(sum(host_docs) AS DOUBLE) AS n, CAST(sum(host_failures) AS DOUBLE) / sum(host_docs) AS m, CAST(count(*) AS DOUBLE) AS hosts, CAST(sum(host_docs * host_docs) AS DOUBLE) AS nn FROM h),
s AS (SELECT a.*, (SELECT sum(host_docs * pow(CAST(host_failures AS DOUBLE) / host_docs - a.m, 2)) FROM h) AS s, m * (1 - m) AS chance, n - nn / n AS scale FROM a),
e AS (SELECT *, CASE WHEN scale > 0 THEN (s - (hosts - 1) * chance) / scale END AS between_ FROM s),
p AS (SELECT m, CASE WHEN chance <= 0 OR between_ IS NULL OR between_ <= chance * 1e-6 THEN 1e6 ELSE greatest(chance / between_ - 1, 1e-3) END AS weight FROM e),
v AS (SELECT h.*, (host_failures + m * weight) / (host_docs + weight) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.75 AS kept, b.source, host_docs, host_failures,
  round(host_rate, 9) AS host_rate FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
