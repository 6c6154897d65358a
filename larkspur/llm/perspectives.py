"""Operator 2: chat formatting by multi-party perspective rotation. Spark functions only.

For every participant of a conversation the dialogue is rendered with that participant as the assistant and all
others as users with their names; the mask marks what the assistant says, with the mark that ends a turn.
Turns of a narrator (``system``) are instructions in every rendering; a narrator is no participant.

A rendering comes in parts of up to ``TURNS`` turns, in order, so that a conversation of any length is
rendered without one task holding all of it; the parts joined give the whole. Offsets are code points within the part.
Turn numbers of a conversation are counted over slices of a global order.

Turns are ordered by number, then role, then text, nulls first. A null role is the speaker ``unknown``, a null text is
empty, a null conversation is one of its own. Marks of the format inside a text lose their force by a blank. Repeated
rows are turns of their own. Long texts are rendered whole, each in one part. Conversations of narrators alone give no rows, and neither does an empty table. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import read_table, stored
from larkspur.operators.ordering import running_totals

TURNS = 64
NARRATORS = ("system",)
UNKNOWN = "unknown"
_BEGIN, _END = "<|im_start|>", "<|im_end|>"


def _safe(column: Column) -> Column:
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def render_perspectives(df: DataFrame, turns: int = TURNS, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """One row per conversation, participant and part: ``text``, ``masks`` as (start, end), ``n_turns``."""
    name = F.replace(F.replace(_safe(F.coalesce("role", F.lit(UNKNOWN))), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    said = df.select("conv_id", "turn", "role", "text", name.alias("speaker"), _safe(F.col("text")).alias("said"))
    # A unique order cuts a long conversation anywhere; equal rows are interchangeable.
    ordered = stored(said.withColumn("_row", F.monotonically_increasing_id()), "turns")
    placed = running_totals(ordered, ["conv_id"], ["turn", "role", "text", "_row"], {"place": F.lit(1).cast("bigint")})
    placed = placed.withColumn("part", F.expr(f"place div {turns}"))
    narrated = F.col("speaker").isin(*narrators)
    parts = placed.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "speaker", "said"))).alias("turns")
    )
    people = placed.where(~narrated).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    pairs = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def rendered(turn: Column) -> Column:
        head = (
            F.when(turn["speaker"].isin(*narrators), F.lit("system\n"))
            .when(turn["speaker"] == F.col("perspective"), F.lit("assistant\n"))
            .otherwise(F.concat(F.lit('user name="'), turn["speaker"], F.lit('"\n')))
        )
        return F.struct(
            F.concat(F.lit(_BEGIN), head).alias("head"),
            F.concat(turn["said"], F.lit(_END)).alias("body"),
            (turn["speaker"] == F.col("perspective")).alias("own"),
        )

    pieces = pairs.select("conv_id", "perspective", "part", F.transform("turns", rendered).alias("pieces"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["head"])
        end = start + F.length(piece["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        masks = F.when(piece["own"], F.concat(state["masks"], span)).otherwise(state["masks"])
        return F.struct((end + 1).alias("at"), masks.alias("masks"))

    masks = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("masks")), add, lambda s: s["masks"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return pieces.select(
        "conv_id", "perspective", "part", F.size("pieces").alias("n_turns"), text.alias("text"), masks.alias("masks")
    )


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return render_perspectives(read_table(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", "part", F.col("n_turns").cast("bigint").alias("n_turns"), "text",
        F.array_join(spans, ",").alias("masks"),
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         replace(replace(replace(coalesce(role, '{UNKNOWN}'), '<|im_', '<| im_'), chr(10), ' '), '"', '''') AS speaker,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS said FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1
    AS place FROM t
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM n WHERE speaker <> 'system'),
r AS (
  SELECT n.conv_id, perspective, place // {TURNS} AS part, place, speaker = perspective AS own,
         '{_BEGIN}' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
           ELSE 'user name="' || speaker || '"' END || chr(10) AS head, said || '{_END}' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(head) AS start FROM r
)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(start AS VARCHAR) || ':' || CAST(start + length(body) AS VARCHAR), ','
         ORDER BY place) FILTER (own), '') AS masks
FROM s GROUP BY ALL
"""
