"""Chat formatting by perspective rotation: every participant in turn is the assistant.

For each conversation and each participant (each speaker but the system), the dialogue is rendered with that speaker as
assistant, the others as named users, and a mask that covers just the assistant's words and end marks. The rendering is a
table of segments, in order, with their places in the dialogue; `assemble` joins the segments of dialogues to strings. Equal turns are counted first, so copies
of a turn are one row until the end. Participants are joined by conversation and block of turns, and places are prefix
sums over blocks and then within a block, so a conversation of any length is spread over many tasks; what is held together of it are its blocks.

Other columns are dropped. Nulls: a null role speaks as "unknown", a null text is empty, null conversation ids form one conversation, a null turn comes first.
Turns of equal number are ordered by role and text; repeated rows are repeated segments. A conversation without participants (system
turns only) has no perspective and no rows; an empty table gives no rows. Marks inside texts are broken up, so texts can't forge them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"
END = "<|end|>\n"
BLOCK_TURNS = 64


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, seq, speaker, segment, start, end, mask_start, mask_end (code points; null where nothing is learnt)."""
    role = F.coalesce("role", F.lit("unknown"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    said = turns.select("conv_id", "turn", role.alias("speaker"), body.alias("body")).groupBy("conv_id", "turn", "speaker", "body").agg(F.count("*").alias("copies"))
    said = said.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK_TURNS).cast("long"))
    met = said.select("conv_id", "block", "speaker").distinct()
    people = met.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of_conv"), F.col("speaker").alias("perspective")).distinct()
    people = met.select("conv_id", "block").distinct().join(people, F.col("conv_id").eqNullSafe(F.col("of_conv"))).select("of_conv", F.col("block").alias("of_block"), "perspective")
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.replace("speaker", F.lit("|"), F.lit("/")), F.lit("|>\n")))
    )
    rows = (
        said.join(people, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("block") == F.col("of_block")))
        .drop("of_conv", "of_block")
        .withColumn("head", head)
        .withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
    )
    key = ["conv_id", "perspective"]
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key, "block").agg(F.sum(F.col("copies") * F.col("size")).alias("block_size"), F.sum("copies").alias("block_rows"))
    blocks = blocks.select(
        *(F.col(c).alias(f"of_{c}") for c in (*key, "block")),
        F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("perspective") == F.col("of_perspective")) & (F.col("block") == F.col("of_block"))
    inside = Window.partitionBy(*key, "block").orderBy("turn", "speaker", "body")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.join(blocks, same)
        .withColumn("last_seq", F.col("rows_before") + F.sum("copies").over(upto) - 1)
        .withColumn("last_end", F.col("size_before") + F.sum(F.col("copies") * F.col("size")).over(upto))
        .withColumn("later", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("seq", F.col("last_seq") - F.col("later"))
        .withColumn("end", F.col("last_end") - F.col("later") * F.col("size"))
    )
    start = F.col("end") - F.col("size")
    return rows.select(
        *key,
        "turn",
        "seq",
        "speaker",
        F.concat("head", "body", F.lit(END)).alias("segment"),
        start.alias("start"),
        "end",
        F.when(own, start + F.length("head")).alias("mask_start"),
        F.when(own, F.col("end") - 1).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, rendered, masks: whole dialogues as strings, for conversations that fit into a row."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end")))
    rows = segments.groupBy("conv_id", "perspective").agg(ordered.alias("all"))
    learnt = F.filter(F.transform("all", lambda x: F.struct(x["mask_start"], x["mask_end"])), lambda x: x["mask_start"].isNotNull())
    return rows.select("conv_id", "perspective", F.array_join(F.transform("all", lambda x: x["segment"]), "").alias("rendered"), learnt.alias("masks"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id AS of_conv, speaker AS perspective FROM said WHERE speaker <> 'system'),
r AS (
  SELECT conv_id, perspective, turn, speaker, body,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || replace(speaker, '|', '/') || '|>' END || chr(10) AS head
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM of_conv),
s AS (SELECT *, CAST(length(head) + length(body) + 8 AS BIGINT) AS size FROM r),
p AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(size) OVER w AS BIGINT) AS "end"
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, seq, speaker, head || body || '<|end|>' || chr(10) AS segment, "end" - size AS start, "end",
       CASE WHEN speaker = perspective THEN "end" - size + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN "end" - 1 END AS mask_end
FROM p
"""
