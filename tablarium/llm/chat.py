"""Chat formatting: the dialogue from each participant's point of view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablarium.llm.common import read

NARRATOR = "system"
#: Turns whose lengths are summed at once, and code points of a part of a long dialogue, about.
TURNS, PART_CHARS = 64, 65_536


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, segment, mask_start, mask_end: every turn as each participant sees it.

    perspective is any role of the conversation but `system`. That speaker's turns are rendered as assistant,
    the others' as named users. The training mask is [mask_start, mask_end) of segment, in code points, and covers
    the content and the end mark of the assistant's turns; it is empty elsewhere. A dialogue is its segments in the
    order of turn, one row each, so that no task holds a whole conversation. Null roles are participant
    `unknown`, null texts are empty, rows with a null conv_id form one conversation, repeated rows stay.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    views = t.filter(F.col("role") != NARRATOR).select(F.col("conv_id").alias("view_id"), F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    label = F.when(own, "assistant").when(F.col("role") == NARRATOR, NARRATOR).otherwise(F.concat(F.lit("user name="), F.col("role")))
    seen = t.join(views, F.col("conv_id").eqNullSafe(F.col("view_id"))).withColumn("head", F.concat(F.lit("<|"), label, F.lit("|>\n")))
    seen = seen.withColumn("segment", F.concat("head", "text", F.lit("<|end|>\n")))
    return seen.select(
        "conv_id", "perspective", "turn", "role", "segment",
        F.when(own, F.length("head")).otherwise(0).alias("mask_start"), F.when(own, F.length("segment") - 1).otherwise(0).alias("mask_end"),
    )


def placed(segments: DataFrame) -> DataFrame:
    """segments (of rotate()) with start, the code points before each in its dialogue: by turn (null last), role and text; equal rows in any order.

    Lengths are summed over turns of 64 at a time, then over these sums, so that no task orders a whole conversation of many turns.
    """
    rows = segments.withColumns({"block": F.floor(F.col("turn") / TURNS), "n": F.length("segment").cast("long")})
    order = [F.col("turn").asc_nulls_last(), "role", "segment"]
    within = F.sum("n").over(Window.partitionBy("conv_id", "perspective", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_last())) - F.col("size")
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), before.alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("block").eqNullSafe(F.col("b"))
    return rows.withColumn("within", within).join(starts, same).select(*segments.columns, (F.col("within") + F.col("before")).alias("start"))


def dialogues(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, perspective, part, start, text, masks: every dialogue as each participant sees it; see rotate() for the rendering and odd rows.

    masks lists start:end of what the assistant is trained on, in code points of the whole dialogue. A dialogue longer than
    part_chars comes in parts that begin with a turn each; start is where a part begins, and the parts' texts joined are the
    dialogue. Almost all are one part. An empty table has no dialogues.
    """
    rows = placed(rotate(turns)).withColumn("part", F.floor(F.col("start") / part_chars))
    mask = F.when(F.col("mask_end") > 0, F.concat_ws(":", (F.col("start") + F.col("mask_start")).cast("string"), (F.col("start") + F.col("mask_end")).cast("string")))
    one = F.array_sort(F.collect_list(F.struct("start", "segment", mask.alias("mask")))).alias("x")  # part_chars and a turn at most
    joined = rows.groupBy("conv_id", "perspective", "part").agg(one)
    take = lambda k: F.transform("x", lambda r: r[k])
    return joined.select("conv_id", "perspective", "part", F.get("x", F.lit(0))["start"].alias("start"), F.array_join(take("segment"), "").alias("text"), F.array_join(take("mask"), ",").alias("masks"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, rendered for each of its participants."""
    return dialogues(read(spark, sf_dir, "conversations"))


QUERIES = {"op2_chat": op2_chat}
ORACLES = {
    "op2_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS view_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT t.*, perspective, '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || '|>' || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.view_id),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, segment ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS pos FROM g)
SELECT conv_id, perspective, pos // {PART_CHARS} AS part, min(pos) AS start, string_agg(segment, '' ORDER BY pos) AS text,
  coalesce(string_agg(CASE WHEN role = perspective THEN (pos + length(head)) || ':' || (pos + length(segment) - 1) END, ',' ORDER BY pos), '') AS masks
FROM o GROUP BY ALL"""
}
