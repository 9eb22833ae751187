"""Chat formatting: every participant's view of a dialogue, with loss masks.

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant,
the system's turns as they are and everyone else as a named user. Only the assistant's bodies are trained on.

The rendering stays a table of segments - one row per turn and perspective, with its place in the rendered
text - so a conversation of any length never has to fit in one task: turns fall into blocks of ``block``
consecutive turn numbers, running sums inside blocks are completed by running sums over the block totals.
No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
#: The template; {name} is the speaker.
ASSISTANT_HEAD, SYSTEM_HEAD, USER_HEAD, USER_HEAD_END, TAIL = "<|assistant|>\n", "<|system|>\n", "<|user name=", "|>\n", "<|end|>\n"


def rotate_perspectives(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    block: int = 256,
) -> DataFrame:
    """Rows (conv_id, perspective, pos, speaker, tag, segment, seg_start, seg_end, train, train_start, train_end).

    ``perspective`` runs over the distinct speakers but ``system``; ``pos`` is the turn's place from 0; offsets are
    code points of the rendered dialogue; ``train`` marks the perspective's own turns and train_start/_end their
    body and end mark (null elsewhere). Order: turn (null first), speaker, text. Null speakers are called
    ``unknown``, null texts are empty, a null conversation id is one conversation; repeated turns are repeated
    segments. A dialogue of system turns alone has no participant and gives no rows.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    ).withColumn("blk", F.floor(F.col("turn") / block))
    head = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM_HEAD)).otherwise(F.concat(F.lit(USER_HEAD), "speaker", F.lit(USER_HEAD_END)))
    t = t.withColumn("as_user", F.length(head) + F.length("body") + len(TAIL))
    # Without a perspective every turn is a user's; the assistant's shorter or longer heads are counted apart.
    own_head = F.when(F.col("speaker") == SYSTEM, F.lit(0)).otherwise(F.lit(len(ASSISTANT_HEAD)) - F.length(head))
    sums = t.groupBy("conv_id", "blk", "speaker").agg(F.sum("as_user").alias("n_chars"), F.sum(own_head).alias("n_own"), F.count(F.lit(1)).alias("n_turns"))
    people = sums.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective")).distinct()
    blocks = sums.groupBy("conv_id", "blk").agg(
        F.sum("n_chars").alias("n_chars"), F.sum("n_turns").alias("n_turns"),
        F.map_from_entries(F.collect_list(F.struct("speaker", "n_own"))).alias("own"),  # speakers of one block: at most its turns
    )
    blocks = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv"))).select(
        "conv_id", "blk", "perspective", "n_turns", (F.col("n_chars") + F.coalesce(F.try_element_at("own", F.col("perspective")), F.lit(0))).alias("n_chars")
    )
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.col("blk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("blk").alias("b_blk"), "perspective",
        F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n_turns").over(before), F.lit(0)).alias("turns_before"),
    )
    own = F.col("speaker") == F.col("perspective")
    tag = F.when(F.col("speaker") == SYSTEM, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    shown = F.when(F.col("tag") == "assistant", F.lit(ASSISTANT_HEAD)).otherwise(head)
    rows = (
        t.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("blk").eqNullSafe(F.col("b_blk")))
        .withColumn("tag", tag)
        .withColumn("segment", F.concat(shown, "body", F.lit(TAIL)))
    )
    order = Window.partitionBy("conv_id", "blk", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body")
    end = F.col("chars_before") + F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("seg_end", end.cast("long")).withColumn("pos", (F.col("turns_before") + F.row_number().over(order) - 1).cast("long"))
    train = F.col("tag") == "assistant"
    start = F.col("seg_end") - F.length("segment")
    return rows.select(
        "conv_id", "perspective", "pos", "speaker", "tag", "segment", start.cast("long").alias("seg_start"), "seg_end",
        train.alias("train"), F.when(train, start + len(ASSISTANT_HEAD)).cast("long").alias("train_start"),
        F.when(train, F.col("seg_end")).alias("train_end"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), r AS (
  SELECT t.conv_id, perspective, turn, speaker, body,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS tag
  FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, CASE tag WHEN 'system' THEN '<|system|>' WHEN 'assistant' THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END
    || chr(10) || body || '<|end|>' || chr(10) AS segment FROM r
), o AS (
  SELECT *, CAST(sum(length(segment)) OVER w AS BIGINT) AS seg_end, CAST(row_number() OVER w - 1 AS BIGINT) AS pos FROM s
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, pos, speaker, tag, segment, CAST(seg_end - length(segment) AS BIGINT) AS seg_start, seg_end,
  tag = 'assistant' AS train, CAST(CASE WHEN tag = 'assistant' THEN seg_end - length(segment) + 14 END AS BIGINT) AS train_start,
  CAST(CASE WHEN tag = 'assistant' THEN seg_end END AS BIGINT) AS train_end
FROM o
"""
