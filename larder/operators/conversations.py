"""Conversation logs: trimming, visible turns, session activity, token use and question intent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.functions import labels as L

IDLE_HOURS = 4


def trim_history(turns: DataFrame, max_turns: int = 50) -> DataFrame:
    """The newest turns of each conversation; a system turn at its start is kept and counts as one of them.

    The cut to the newest turns is done per partition before the turns of a conversation meet. A head that lies before the cut
    comes with the oldest turn that is kept, so the turns are read twice and joined once, with one row per conversation.
    """
    columns = turns.columns
    first = turns.groupBy("conv_id").agg(F.min_by(F.struct(*columns), "turn").alias("_head"), F.count(F.lit(1)).alias("_n"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (
        turns.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= max_turns).join(first, "conv_id")
    )
    has_head = (F.col("_head.role") == "system") & (F.col("_n") > max_turns)
    row = F.struct(*columns)
    rows = F.when(F.coalesce(has_head, F.lit(False)) & (F.col("_age") == max_turns), F.array("_head")).otherwise(F.array(row))
    return recent.select(F.inline(rows))


def visible_history(turns: DataFrame, include_system: bool = False) -> DataFrame:
    """Turns as a reader sees them, in order."""
    shown = turns if include_system else turns.where(F.col("role") != "system")
    return shown.orderBy("conv_id", "turn")


def session_overview(log: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Messages, first and last activity per session."""
    return (
        log.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("message_count"),
            F.min(at).alias("created_at"),
            F.max(at).alias("last_activity"),
        )
    )


def expired_sessions(
    log: DataFrame, as_of: dt.datetime | Column, key: str = "user_id", at: str = "ts", idle_hours: float = IDLE_HOURS
) -> DataFrame:
    """Sessions idle for longer than the limit at the given time."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))
    return session_overview(log, key, at).where(idle > int(idle_hours * 3_600_000_000)).select(key, "last_activity")


def token_usage(calls: DataFrame) -> DataFrame:
    """One row: calls, prompt tokens, completion tokens and their sum."""
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("total_prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("total_completion_tokens"),
    ).withColumn("total_tokens", F.col("total_prompt_tokens") + F.col("total_completion_tokens"))


def question_intent(questions: DataFrame, text: str = "text") -> DataFrame:
    """Questions with intent and confidence by the first rule whose keywords occur anywhere in the text."""
    lowered = F.lower(text)
    intent, confidence = map(F.lit, L.QUESTION_DEFAULT)
    for name, words, score in reversed(L.QUESTION_RULES):
        hit = lowered.rlike("|".join(words))
        intent, confidence = F.when(hit, name).otherwise(intent), F.when(hit, score).otherwise(confidence)
    return questions.withColumns({"intent": intent, "confidence": confidence})
