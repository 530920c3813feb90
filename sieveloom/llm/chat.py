"""Chat formatting by prefix-target expansion: an example for every assistant turn.

An example's ``prompt`` holds all turns before it, and the head of the
assistant's turn; ``target`` is the reply with its end mark. Only the characters
``train_start`` to ``train_end`` (exclusive) of prompt and target, one after the
other, are to be trained, and these are the target's.

Turns are in the order of ``turn`` (null first), then role, then text, so that
ties have a fixed order; repeated rows are turns each. A null role is
``unknown``; a null text is empty. An assistant turn without text gives no
example, but stands in the context of later ones; one without earlier turns has
an empty context. Rows without ``conv_id`` are left out. ``<|`` in a text is
written ``<\\u200b|`` (with a zero-width space), so that no text can pass for a
mark. Other columns are ignored; an empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.llm.common import table

OPEN, CLOSE = "<|turn|>", "<|end|>"
REPLY = "assistant"


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, n_context, prompt, target, train_start, train_end)."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\u200b|"))
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    said = F.concat(F.lit(OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(CLOSE + "\n"))
    # one sort by conversation serves both columns; a turn sees what was before it
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    found = turns.withColumn("said", said).withColumn("context", F.collect_list("said").over(before)).where((F.col("role") == REPLY) & (F.col("text") != ""))
    return found.select(
        "conv_id",
        "turn",
        F.size("context").alias("n_context"),
        F.concat(F.array_join("context", ""), F.lit(f"{OPEN}{REPLY}\n")).alias("prompt"),
        F.concat(safe(F.col("text")), F.lit(CLOSE + "\n")).alias("target"),
    ).select("*", F.length("prompt").alias("train_start"), (F.length("prompt") + F.length("target")).alias("train_end"))


def query(spark, sf_dir: str) -> DataFrame:
    return examples(table(spark, sf_dir, "conversations"))


ORACLE = f"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null
), s as (
  select *, '{OPEN}' || replace(role, '<|', '<' || chr(8203) || '|') || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || '{CLOSE}' || chr(10) as said from t
), c as (
  select *, string_agg(said, '') over w as context, count(*) over w as n
  from s window w as (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and 1 preceding)
), e as (
  select conv_id, turn, n::int as n_context, coalesce(context, '') || '{OPEN}{REPLY}' || chr(10) as prompt, replace(text, '<|', '<' || chr(8203) || '|') || '{CLOSE}' || chr(10) as target
  from c where role = '{REPLY}' and text <> ''
)
select *, length(prompt)::int as train_start, (length(prompt) + length(target))::int as train_end from e
"""
