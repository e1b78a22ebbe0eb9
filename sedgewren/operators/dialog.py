"""Conversation history: turns, trimming, caps and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.functions.text import strip, truncated


def turns(messages: DataFrame, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Messages with their turn number; a turn closes with an assistant message."""
    w = Window.partitionBy(session).orderBy(pos)
    closed = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("turn", F.coalesce(closed, F.lit(0)))


def trimmed_history(messages: DataFrame, max_turns: int = 4, max_chars: int = 1500, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Messages of the newest turns: at most ``max_turns``, whole turns up to ``max_chars``, the newest always kept.

    Messages of other roles than user and assistant and blank messages take no part.
    """
    known = messages.where(F.col("role").isin("user", "assistant") & (strip(F.coalesce("content", F.lit(""))) != ""))
    t = turns(known, session, pos)
    sizes = t.groupBy(session, "turn").agg(F.sum(F.length("content")).alias("chars"))
    newest = Window.partitionBy(session).orderBy(F.desc("turn"))
    keep = sizes.withColumn("age", F.row_number().over(newest)).withColumn("upto", F.sum("chars").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    keep = keep.where((F.col("age") <= max_turns) & ((F.col("age") == 1) | (F.col("upto") <= max_chars)))
    return t.join(keep.select(session, "turn"), [session, "turn"], "left_semi")


def last_messages(history: Column, n: int = 40) -> Column:
    """The last ``n`` entries of an array."""
    return F.when(F.size(history) > n, F.slice(history, -n, n)).otherwise(history)


def history_text(history: Column, n: int = 400) -> Column:
    """Labelled lines of an array of (role, content); unknown roles and blank contents are left out; none gives 无."""
    known = F.filter(history, lambda m: m["role"].isin("user", "assistant") & (strip(m["content"]) != ""))
    lines = F.transform(known, lambda m: F.concat(F.when(m["role"] == "user", "用户：").otherwise("助手："), truncated(strip(m["content"]), n, "…")))
    return F.when(F.size(known) > 0, F.array_join(lines, "\n")).otherwise("无")
