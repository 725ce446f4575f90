"""Conversations: usable turns, the last of them as text, and follow-ups that need rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import strip
from ledgerline.functions.text import wants_rewrite


def usable_turns(turns: DataFrame, width: int | None = 600) -> DataFrame:
    """Turns of user and assistant with text, stripped and, with a width, cut."""
    rows = turns.where(F.col("role").isin("user", "assistant")).withColumn("text", strip(F.col("text")))
    rows = rows.where("text <> ''")
    return rows if width is None else rows.withColumn("text", F.substring("text", 1, width))


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", last: int = 6, width: int = 600) -> DataFrame:
    """One row a conversation: its last usable turns, labelled and in order."""
    recent = usable_turns(turns, width).withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("_n") <= last)
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l"))))
    return recent.groupBy(conv).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(listed, lambda x: x["l"]), "\n").alias("history"))


def synthesis_history(turns: DataFrame, messages: DataFrame, conv: str = "conv_id", turn: str = "turn", message: str = "message", last: int = 6, width: int = 1000) -> DataFrame:
    """One row a conversation, as for `history`: a last user turn that equals the conversation's current message is left out first."""
    rows = usable_turns(turns, None).join(messages.select(conv, strip(F.col(message)).alias("_message")), conv, "left")
    is_last = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn))) == 1
    rows = rows.withColumn("_last", is_last).where(~(F.col("_last") & (F.col("role") == "user") & F.col("text").eqNullSafe(F.col("_message"))))
    return history(rows.select(*turns.columns), conv, turn, last, width)


def follow_ups(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, message, rewrite) for each conversation's last user turn: whether it needs what was said before."""
    rows = usable_turns(turns, None)
    latest = rows.where("role = 'user'").groupBy(conv).agg(F.max_by("text", turn).alias("message"), F.max(turn).alias("_at"))
    before = rows.select(conv, F.col(turn).alias("_t")).groupBy(conv).agg(F.min("_t").alias("_first"))
    return latest.join(before, conv, "left").select(conv, "message", wants_rewrite(F.col("message"), F.col("_first") < F.col("_at")).alias("rewrite"))


def keep_messages(messages: DataFrame, chat: str, turn: str, last: int = 50) -> DataFrame:
    """The last well-formed messages of each chat."""
    good = messages.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    return good.withColumn("_n", F.row_number().over(Window.partitionBy(chat).orderBy(F.desc(turn)))).where(F.col("_n") <= last).drop("_n")
