"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and everyone else as a named user; the loss mask covers
what the assistant says. Rendered text comes in blocks of consecutive turns, each
with its offset in the whole dialogue, so that a conversation of any length
renders in bounded rows; the blocks of one perspective, in order, concatenate to
the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read

BEGIN, END = "<|begin|>", "<|end|>\n"
#: Turns a part at most, and turn numbers a block.
BLOCK = 64
NOBODY = "unknown"


def _safe(text: Column) -> Column:
    """Text in which the markers cannot occur."""
    return F.regexp_replace(text, r"<\|(begin|end)\|>", "<!$1!>")


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, assistant, block, part, n_turns, start, text, masks, n_masked).

    A block holds ``block`` turn numbers; should more turns share them, it goes
    on in further parts, so no row holds more than ``block`` turns.

    masks: array of (start, end) code-point ranges, in the whole dialogue, of the
    assistant's words with their end marker. Participants are the distinct roles;
    "system" takes no perspective of its own but is shown to all as itself. A
    null or empty role is the participant "unknown". Null texts are empty turns.
    Null turn numbers come last; ties keep the order of (role, text), and repeated
    rows stay repeated turns. A null conv_id is one conversation. Markers inside
    texts are defused. Other columns are not read; an empty table gives an
    empty result.
    """
    role = F.coalesce(F.nullif(F.trim(turns[role_col].cast("string")), F.lit("")), F.lit(NOBODY))
    said = _safe(F.coalesce(turns[text_col].cast("string"), F.lit("")))
    t = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), role.alias("role"), said.alias("said"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit((1 << 53))).cast("long"))
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").isNull(), "turn", "role", "said")
    t = t.withColumn("part", F.floor((F.row_number().over(in_block) - 1) / block).cast("long"))
    speakers = t.filter("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("assistant")).distinct()
    # one row a turn and perspective; both sides are dealt by conversation and long ones split by AQE
    seen = t.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("role") == F.col("assistant")
    head = F.concat(F.lit(BEGIN), F.when(own, "assistant").when(F.col("role") == "system", "system").otherwise(F.concat(F.lit("user name="), _safe(F.col("role")))), F.lit("\n"))
    body = F.concat("said", F.lit(END))
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "said", own.alias("own"), head.alias("head"), body.alias("body"))
    held = seen.groupBy("conv_id", "assistant", "block", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"])
    held = held.withColumn("size", F.aggregate("turns", F.lit(0).cast("long"), lambda acc, x: acc + size(x)))
    order = Window.partitionBy("conv_id", "assistant").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    walk = F.aggregate(
        "turns",
        F.struct(F.col("start").alias("at"), none.alias("masks")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(x["own"], F.array_append(acc["masks"], F.struct((acc["at"] + F.length(x["head"])).alias("start"), (acc["at"] + size(x)).alias("end")))).otherwise(acc["masks"]).alias("masks"),
        ),
    )
    return held.withColumn("masks", walk["masks"]).select(
        "conv_id",
        "assistant",
        "block",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        "start",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        "masks",
        F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + m["end"] - m["start"]).alias("n_masked"),
    )


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return out.select("conv_id", "assistant", "block", "part", "n_turns", "start", "n_masked", F.sha2("text", 256).alias("text_sha256"), F.sha2(spans, 256).alias("masks_sha256"))


OP5_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), '{NOBODY}') AS role,
         regexp_replace(coalesce(text, ''), '<\|(begin|end)\|>', '<!\1!>', 'g') AS said,
         CAST(coalesce(floor(turn / {BLOCK}.0), {1 << 53}) AS BIGINT) AS block
  FROM conversations
), n AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS LAST, role, said) - 1) / {BLOCK}.0) AS BIGINT) AS part FROM t
), p AS (
  SELECT DISTINCT conv_id, role AS assistant FROM t WHERE role <> 'system'
), r AS (
  SELECT n.*, assistant,
         '{BEGIN}' || CASE WHEN role = assistant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
         said || '<|end|>' || chr(10) AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, assistant ORDER BY block, part, turn NULLS LAST, role, said ROWS UNBOUNDED PRECEDING) AS until FROM r
)
SELECT conv_id, assistant, block, part, count(*) AS n_turns, CAST(min(until - length(head) - length(body)) AS BIGINT) AS start,
       CAST(coalesce(sum(length(body)) FILTER (WHERE role = assistant), 0) AS BIGINT) AS n_masked,
       sha256(string_agg(head || body, '' ORDER BY turn NULLS LAST, role, said)) AS text_sha256,
       sha256(coalesce(string_agg(CAST(CAST(until - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(until AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS LAST, role, said) FILTER (WHERE role = assistant), '')) AS masks_sha256
FROM o GROUP BY conv_id, assistant, block, part
"""
