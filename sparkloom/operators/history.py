"""Chat history: suffixes by turns and by characters, and prompts made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spoken(conversations: DataFrame) -> DataFrame:
    """Turns of the user and the assistant."""
    return conversations.where(F.col("role").isin("user", "assistant"))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each conversation."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back")


def trimmed(turns: DataFrame, n: int = 16, most_chars: int = 2000) -> DataFrame:
    """The last n messages, less the oldest pairs while their characters exceed ``most_chars`` and more than two messages are left.

    Pairs are counted from the oldest kept message; what is dropped goes pair by pair, so a pair stays if it and all after it fit. The last two messages always stay.
    """
    recent = last_turns(turns, n)
    place = Window.partitionBy("conv_id").orderBy("turn")
    whole = Window.partitionBy("conv_id")
    rows = recent.withColumns({"_at": F.row_number().over(place) - 1, "_size": F.coalesce(F.length("text"), F.lit(0))})
    rows = rows.withColumns({"_all": F.count("*").over(whole), "_pair": F.floor(F.col("_at") / 2)})
    # Characters from the first message of the pair to the end, and messages there.
    tail = Window.partitionBy("conv_id").orderBy(F.desc("_pair")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_chars": F.sum("_size").over(tail), "_left": F.col("_all") - 2 * F.col("_pair")})
    # A pair that fits with all after it, or the longest rest of two messages at most.
    fits = (F.col("_chars") <= most_chars) | (F.col("_left") <= 2)
    return rows.where(fits).drop("_at", "_size", "_all", "_pair", "_chars", "_left")


def rewrite_prompt(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages as ``User:`` and ``Bot:`` lines. At most n rows a conversation are gathered."""
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Bot: "), F.coalesce("text", F.lit("")))
    lines = last_turns(turns, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("line")))).alias("x"))
    return lines.select("conv_id", F.array_join(F.transform("x", lambda v: v.line), "\n").alias("history"))
