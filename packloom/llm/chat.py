"""Dialogues seen by each of their speakers, with loss masks, in DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the
assistant and everybody else as a named user; only the assistant's words and
their end mark are trained on.  The result has one row per turn and perspective:
a dialogue's rendering is its segments in the order of ``turn``.  No row depends
on another turn, so a dialogue of any length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What a text or name shows where it holds one of the marks, so that it cannot forge a turn.
SHOWN = {"<|im_start|>": "<im_start>", "<|im_end|>": "<im_end>"}
SYSTEM, ASSISTANT, USER, UNKNOWN = "system", "assistant", "user", "unknown"


def _harmless(text: Column) -> Column:
    for mark, shown in SHOWN.items():
        text = F.replace(text, F.lit(mark), F.lit(shown))
    return text


def rotate_perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows ``conv_id, perspective, turn, chat_role, name, segment, mask_start, mask_end``.

    ``segment`` is the turn's rendering; characters ``mask_start`` up to
    ``mask_end`` of it are trained on (equal where none is).  The system is no
    participant: its turns stay system turns in every perspective, and a
    dialogue of system turns only gives no rows.  A null speaker is a
    participant named ``unknown``; a null text is empty; null ids are one
    dialogue; turns that share a number, and repeated rows, are all rendered,
    in any order among themselves; texts may be of any length.  Marks inside a
    text or name are written as ``SHOWN`` says, and line breaks in a name as
    spaces.  An empty table gives no rows; other columns are ignored.
    """
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col).cast("string"), F.lit(UNKNOWN)).alias("speaker"), _harmless(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    cast = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("cast_id"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(cast, turns.conv_id.eqNullSafe(cast.cast_id))
    chat_role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), ASSISTANT).otherwise(USER)
    seen = seen.withColumn("chat_role", chat_role).withColumn("name", F.when(F.col("chat_role") == USER, _harmless(F.regexp_replace("speaker", r"[\r\n]+", " "))))
    head = F.concat(F.lit(START), "chat_role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    begin = F.char_length(head).cast("long")
    trained = F.when(F.col("chat_role") == ASSISTANT, F.char_length("text") + len(END)).otherwise(0)
    return seen.select("conv_id", "perspective", "turn", "chat_role", "name", F.concat(head, "text", F.lit(END)).alias("segment"), begin.alias("mask_start"), (begin + trained).cast("long").alias("mask_end"))


#: DuckDB counterpart over ``conversations``.
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS text FROM conversations),
seen AS (
  SELECT t.*, c.perspective,
         CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN '{ASSISTANT}' ELSE '{USER}' END AS chat_role
  FROM turns t JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> '{SYSTEM}') c
    ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
headed AS (
  SELECT *, '{START}' || chat_role || CASE WHEN name IS NOT NULL THEN ' name=' || name ELSE '' END || chr(10) AS head
  FROM (SELECT *, CASE WHEN chat_role = '{USER}' THEN replace(replace(regexp_replace(speaker, '[\r\n]+', ' ', 'g'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') END AS name FROM seen))
SELECT conv_id, perspective, turn, chat_role, name, head || text || '{END.strip()}' || chr(10) AS segment,
       CAST(length(head) AS BIGINT) AS mask_start,
       CAST(length(head) + CASE WHEN chat_role = '{ASSISTANT}' THEN length(text) + {len(END)} ELSE 0 END AS BIGINT) AS mask_end
FROM headed
"""
