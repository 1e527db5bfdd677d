"""Conversations turn by turn: keyed state for histories of a stream of turns, and a chat loop that answers a stream of questions.

Both may be given a batch again, or start anew from their checkpoint, and end with the same rows: a turn that is not later than the last one known of its conversation changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators import history
from sparkloom.session import cut

#: Messages of a conversation that are held, and characters that a history may have.
MESSAGES, CHARS, SHOWN = 16, 2000, 6
TURN = "conv_id long, turn long, role string, text string"
STATE = "last long, turns array<long>, roles array<string>, texts array<string>"
HISTORY = "conv_id long, turn long, role string, n_kept int, first_kept long, chars long, history string"


def turn_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """New Parquet files of turns as they come. Without a bound all files that are there make one batch, so the turns of a table may lie in any of its files; with one, files must come in the order of their turns."""
    stream = spark.readStream.schema(TURN)
    return (stream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else stream).parquet(path)


def kept_from(sizes: list[int], most_chars: int) -> int:
    """How many of the oldest messages go: pairs, while the characters exceed ``most_chars`` and more than two messages are left."""
    at, chars = 0, sum(sizes)
    while chars > most_chars and len(sizes) - at > 2:
        chars -= sum(sizes[at : at + 2])
        at += 2
    return at


def histories(turns: DataFrame, most: int = MESSAGES, most_chars: int = CHARS, shown: int = SHOWN) -> DataFrame:
    """For each turn of the user or the assistant, the history that the conversation has with it, as ``history.trimmed`` has it of all turns so far: how many messages stay, the first one's turn, and their characters;
    ``history`` has the ``shown`` messages before the turn as lines, null for the first.

    ``turns`` is a stream. The state of a conversation is its last ``most`` messages. Turns count in ascending order; one that comes late, again, or without a number or a conversation is left out, and of several rows of one turn
    the first by role and text counts. A null text is empty. A batch of one conversation is sorted in memory: the size of a batch is the source's to bound.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *held = state.get if state.exists else (None, [], [], [])
        known, roles, texts = (list(x) for x in held)
        rows = sorted((int(t), r, x or "") for part in parts for t, r, x in zip(part["turn"], part["role"], part["text"], strict=True))
        out = []
        for turn, role, text in rows:
            if last is not None and turn <= last:
                continue
            before = "\n".join(("User: " if r == "user" else "Bot: ") + x for r, x in zip(roles[-shown:], texts[-shown:], strict=True))
            known, roles, texts = ([*x, new][-most:] for x, new in ((known, turn), (roles, role), (texts, text)))
            sizes = [len(x) for x in texts]
            at = kept_from(sizes, most_chars)
            out.append((int(key[0]), turn, role, len(sizes) - at, known[at], sum(sizes[at:]), before if last is not None else None))
            last = turn
        if out:
            state.update((last, known, roles, texts))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "n_kept", "first_kept", "chars", "history"])

    rows = history.spoken(turns).where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").applyInPandasWithState(step, HISTORY, STATE, "append", GroupStateTimeout.NoTimeout)


def written_histories(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Histories of all turns that are there, appended to Parquet; each batch is committed once."""
    return histories(turns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


MESSAGE = "conv_id long, turn long, side int, role string, text string"


def recent(messages: DataFrame, most: int) -> DataFrame:
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("side"))
    return messages.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most).drop("_back")


def converse(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, most: int = MESSAGES, most_chars: int = CHARS, shown: int = SHOWN) -> StreamingQuery:
    """Answer a stream of questions (``conv_id``, ``turn``, ``text``), each with the history that earlier answers have made.

    A batch goes in rounds: the first open question of every conversation, then the next. ``answer`` gets ``qid`` (the conversation), ``question`` and ``history`` (null at first) and
    gives ``qid`` and ``answer``; ``flow.answer`` is one. After a round, question and answer join the history, which is trimmed as in ``history.trimmed``. ``path/answers/v<batch>`` has the answers of a batch and
    ``path/history/v<batch>`` all histories after it, made of the version before: a batch that is run again overwrites both with the same rows. Questions without a conversation or a number, and turns that are not later than the last
    one, are left out; of several rows of one turn the least text counts. Rounds are as many as the questions of one conversation in a batch.
    """
    columns = [f.strip().split()[0] for f in MESSAGE.split(",")]

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        held = spark.read.schema(MESSAGE).parquet(f"{path}/history/v{number - 1}") if number else spark.createDataFrame([], MESSAGE)
        last = held.groupBy("conv_id").agg(F.max("turn").alias("last"))
        fresh = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        fresh = fresh.join(last, "conv_id", "left").where("last IS NULL OR turn > last").drop("last")
        fresh = cut(fresh.withColumn("round", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))))
        said = None
        for k in range(1, (fresh.agg(F.max("round")).first()[0] or 0) + 1):
            now = fresh.where(F.col("round") == k)
            line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Bot: "), "text")
            lines = recent(held, shown).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "side", line.alias("line")))).alias("x"))
            told = lines.select("conv_id", F.array_join(F.transform("x", lambda v: v.line), "\n").alias("history"))
            asked = now.join(told, "conv_id", "left").select(F.col("conv_id").alias("qid"), F.col("text").alias("question"), "history")
            replies = answer(asked).select(F.col("qid").alias("conv_id"), "answer")
            done = cut(now.join(replies, "conv_id", "left").select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer")))
            said = done if said is None else said.unionByName(done)
            side = lambda n, role, text: done.select("conv_id", "turn", F.lit(n).alias("side"), F.lit(role).alias("role"), F.col(text).alias("text"))  # noqa: E731, B023
            every = recent(held.unionByName(side(0, "user", "question")).unionByName(side(1, "assistant", "answer")), most)
            # ``trimmed`` orders by one number: places of the two sides.
            placed = every.withColumnsRenamed({"turn": "_turn"}).withColumn("turn", F.struct("_turn", "side"))
            held = cut(history.trimmed(placed, most, most_chars).drop("turn").withColumnRenamed("_turn", "turn").select(columns))
        empty = spark.createDataFrame([], "conv_id long, turn long, question string, answer string")
        (empty if said is None else said).write.mode("overwrite").parquet(f"{path}/answers/v{number}")
        held.write.mode("overwrite").parquet(f"{path}/history/v{number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
