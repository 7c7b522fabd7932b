"""What five filters do to each other, whatever their order: a SQL CUBE over their failure flags and the part of a document.

Documents become one row for each combination of flags and part, and these rows are cubed: in a grouping set, the row whose selected flags are all false counts the survivors of that
subset of filters. A step of an order is a pair of subsets, one filter apart, so all orders follow from joins of survivors with survivors; no document is looked at twice.

Filters: A under 200 words; B fewer different words than half of all; C capitals A-Z over 3 % of the code points; D holds one of `#$%&*|`; E equal to the text of any smaller doc_id, wherever that
stands. A null text is empty (fails A alone, and E where another empty text has a smaller id); a null lang is the part ''. Equal texts are told by SHA-256. A null doc_id is neither smaller nor larger
than another: such rows never fail E and have no labels. Repeated rows count each; rows that share id and text don't make each other fail E. Labels that repeat an id count as one, good or toxic if any
of them is. Empty tables give no rows. Further columns of documents and labels are dropped, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, r"[#$%&*|]"
#: Places that rows without an id are spread over in the join with labels.
SPREAD = 1024
COUNTS = ("n", "good", "toxic")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the flags A to D, a narrow row for each document."""
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    split = whole.select("doc_id", "part", "text", F.array_remove(F.split("text", WHITE), "").alias("words"))
    sized = split.select("doc_id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    return sized.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (F.col("n_words") < LEAST_WORDS).alias("A"),
        (100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(MARKS).alias("D"),
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E and the counts n, good, toxic: one row for each combination that documents have.

    A text's rows are summed per id, then per part, before they meet, so a text that very many documents have is never gathered: what meets are its parts' sums.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.lit(0))
    rows = measured(docs).withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    flags = [F.first(c).alias(c) for c in "ABCD"]
    by_id = rows.groupBy("doc_id", "spread", "digest", "part").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"), *flags)
    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS))).alias("lowest")
    without = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_null") for c in COUNTS]
    by_part = by_id.groupBy("digest", "part").agg(*(F.sum(c).alias(c) for c in COUNTS), lowest, *without, *flags)
    first = F.min("lowest.doc_id").over(Window.partitionBy("digest"))
    held = by_part.withColumn("first", first).withColumn("own", F.coalesce(F.col("lowest.doc_id") == F.col("first"), F.lit(False)))
    kept = [(F.when(F.col("own"), F.col(f"lowest.{c}")).otherwise(0) + F.col(f"{c}_null")).alias(f"{c}_kept") for c in COUNTS]
    both = held.select("part", *"ABCD", *COUNTS, *kept)
    sides = F.array(
        F.struct(F.lit(False).alias("E"), *(F.col(f"{c}_kept").alias(c) for c in COUNTS)),
        F.struct(F.lit(True).alias("E"), *((F.col(c) - F.col(f"{c}_kept")).alias(c) for c in COUNTS)),
    )
    parted = both.select("part", *"ABCD", F.explode(sides).alias("side")).select("part", *"ABCD", "side.*")
    return parted.filter("n > 0").groupBy("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS))


def survivors(combinations: DataFrame) -> DataFrame:
    """part, subset (bit k for the k-th filter) and the counts of documents that pass all filters of the subset, zeros included; part is null for all parts together."""
    cubed = combinations.cube(*FILTERS, "part").agg(*(F.sum(c).alias(c) for c in COUNTS), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"free_{f}") for f in FILTERS))
    passing = cubed.filter(" and ".join(f"(free_{f} = 1 or not {f})" for f in FILTERS))
    subset = sum(((1 - F.col(f"free_{f}")) * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0)).cast("int")
    found = checkpoint(passing.select("part", subset.alias("subset"), *COUNTS))
    every = found.filter("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    return every.alias("e").join(found.alias("f"), F.expr("e.part <=> f.part and e.subset = f.subset"), "left").select("e.part", "e.subset", *(F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in COUNTS))


def orders() -> list[tuple[str, int, str, int]]:
    """filter_order, step, the step's filter and the subset before it: a fixed number of rows."""
    return [("".join(o), k + 1, f, sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame, all_parts: bool = False) -> DataFrame:
    """A row for each part, order and step. With all_parts also rows whose part is null, over all parts."""
    spark, whole = docs.sparkSession, (1 << len(FILTERS)) - 1
    subsets = survivors(flagged(docs, labels))
    subsets = checkpoint(subsets if all_parts else subsets.filter("part is not null"))
    added = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(1 << k).alias("bit")) for k, f in enumerate(FILTERS)))).alias("x")
    before = subsets.select("*", added).select("part", "subset", *COUNTS, "x.*").filter("subset & bit = 0")
    pairs = before.alias("b").join(subsets.alias("a"), F.expr("a.part <=> b.part and a.subset = b.subset | b.bit")).select(
        "b.part", "b.filter", F.col("b.subset").alias("before"), "b.bit", F.col("a.n").alias("kept"), *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(name) for c, name in zip(COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True))
    )
    own = Window.partitionBy("part", "filter")
    size = F.bit_count("before")
    times = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), size + 1)
    pairs = pairs.select(
        "*",
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(own).alias("failing"),
        F.sum(F.when(F.col("before") == F.lit(whole) - F.col("bit"), F.col("removed"))).over(own).alias("unique_fails"),
        F.sum(F.col("removed") * times).over(own).alias("shapley"),
    )
    steps = F.broadcast(spark.createDataFrame(orders(), "filter_order string, step int, filter string, before int"))
    return pairs.join(steps, ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > first_id THEN 'E' END) AS failed
  FROM w LEFT JOIN known ON w.doc_id = known.doc_id),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT '' AS s UNION ALL SELECT s || letter FROM o, letters WHERE strpos(s, letter) = 0),
steps AS (SELECT s AS filter_order, CAST(k AS INTEGER) AS step, substr(s, k, 1) AS letter, substr(s, 1, k - 1) AS earlier FROM o, range(1, 6) AS r(k) WHERE length(s) = 5),
x AS (
  SELECT part, filter_order, step, letter, n, good, toxic, strpos(failed, letter) > 0 AS fails_here, failed = letter AS only_here,
         translate(earlier, failed, '') <> earlier AS gone
  FROM g, steps),
y AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_here), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND fails_here), 0) AS redundant, coalesce(sum(n) FILTER (only_here), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails_here), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_here), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM y
"""
