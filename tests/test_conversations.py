"""Streams of turns against the batch operators, again and after a restart."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import history
from sparkloom.plans import flow
from sparkloom.session import scratch, table
from sparkloom.streaming import conversations


def said(seed, n):
    return "x" * random.Random(seed).randrange(n)


#: Conversations of many lengths; null and long texts, other roles, rows without a number or a conversation.
TURNS = [(c, t, ["user", "assistant", "system", "user"][(c + t) % 4], None if (c * t) % 11 == 5 else said(c * 100 + t, 900)) for c in range(12) for t in range(0, 3 * c + 1)] + [(None, 1, "user", "lost"), (3, None, "user", "lost")]


def batch_oracle(spark, rows):
    """``history.trimmed`` of each beginning of each conversation."""
    kept = [r for r in rows if r[0] is not None and r[1] is not None and r[2] != "system"]
    prefixes = [(f"{c} {t}", u, r, x) for c, t, _, _ in kept for d, u, r, x in kept if d == c and u <= t]
    made = history.trimmed(spark.createDataFrame(prefixes, "conv_id string, turn long, role string, text string"))
    found = made.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).collect()
    return {tuple(map(int, r.conv_id.split())): (r.n, r["first"], r.chars) for r in found}


def streamed(spark, source, path, checkpoint, bound=None):
    conversations.written_histories(conversations.turn_stream(spark, source, bound), path, checkpoint).awaitTermination()
    rows = spark.read.schema(conversations.HISTORY).parquet(path).collect()
    assert len(rows) == len({(r.conv_id, r.turn) for r in rows})
    return {(r.conv_id, r.turn): (r.n_kept, r.first_kept, r.chars) for r in rows}


def test_histories_turn_by_turn(spark):
    source, path, checkpoint = (scratch(spark, x) for x in ("turns", "histories", "stream"))
    put = lambda rows, mode="append": spark.createDataFrame(rows, conversations.TURN).repartition(3).write.mode(mode).parquet(source)
    put([r for r in TURNS if (r[1] or 0) < 6])
    first = streamed(spark, source, path, checkpoint)
    # Started anew from its checkpoint, with rows that were there before among the new ones.
    put([r for r in TURNS if (r[1] or 0) >= 4])
    both = streamed(spark, source, path, checkpoint)
    assert first.items() <= both.items() and both == batch_oracle(spark, TURNS)
    put([r for r in TURNS if (r[1] or 0) < 9])
    assert streamed(spark, source, path, checkpoint, 1) == both
    lines = {(r.conv_id, r.turn): r.history for r in spark.read.schema(conversations.HISTORY).parquet(path).collect()}
    own = sorted(r for r in TURNS if r[0] == 5 and r[2] != "system" and r[1] is not None)
    assert lines[5, own[0][1]] is None
    assert lines[5, own[4][1]] == "\n".join(("User: " if r == "user" else "Bot: ") + (x or "") for _, _, r, x in own[:4])


def test_histories_of_the_table(spark, sf_dir):
    from sparkloom.plans import answers

    got = {(r.conv_id, r.turn): (r.n_kept, r.first_kept, r.chars) for r in answers.history_by_turn(spark, sf_dir).collect()}
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect() if r.role in ("user", "assistant")]
    assert got == batch_oracle(spark, rows)


@pytest.mark.parametrize("most_chars", [0, 10, 30, 10_000])
def test_pairs_go_first(most_chars):
    for sizes in ([], [5], [5, 5], [5, 5, 50], [20, 1, 1, 1, 9], [9] * 7):
        at = conversations.kept_from(sizes, most_chars)
        fits = [k for k in range(0, max(1, len(sizes)), 2) if sum(sizes[k:]) <= most_chars or len(sizes) - k <= 2]
        assert at == fits[0]


QUESTIONS = [(c, t, f"question {c} {t}" if t % 4 else None) for c in range(5) for t in range(1, 2 * c + 3)]


def plain_loop(rows, most=16, most_chars=2000, shown=6):
    held, out = {}, {}
    for c, t, x in sorted(rows, key=lambda r: (r[0], r[1])):
        own = held.setdefault(c, [])
        before = "\n".join(own[-shown:]) if own else None
        reply = f"{len(x or '')} {len(before or '')} " + "y" * (97 * t % 400)
        out[c, t] = (x or "", reply)
        own += [f"User: {x or ''}", f"Bot: {reply}"]
        del own[:-most]
        sizes = [len(m.split(": ", 1)[1]) for m in own]
        del own[: conversations.kept_from(sizes, most_chars)]
    return out


def replies(asked):
    told = F.concat_ws(" ", F.length("question"), F.length(F.coalesce("history", F.lit(""))), F.expr("repeat('y', (97 * int(coalesce(nullif(regexp_extract(question, '([0-9]+)$', 1), ''), '0'))) % 400)"))
    return asked.select("qid", told.alias("answer"))


def test_chat_loop(spark):
    rows = [(c, t, x or "") for c, t, x in QUESTIONS if x]
    source, path, checkpoint = (scratch(spark, x) for x in ("questions", "chat", "stream"))
    schema = "conv_id long, turn long, text string"

    def run(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        conversations.converse(stream, replies, path, checkpoint).awaitTermination()
        return {(r.conv_id, r.turn): (r.question, r.answer) for r in spark.read.parquet(f"{path}/answers/*").collect()}

    half = [r for r in rows if r[1] < 5]
    first = run([*half, (None, 1, "lost"), (1, None, "lost")])
    both = run([r for r in rows if r[1] >= 3])
    assert first.items() <= both.items() and both == plain_loop(rows)
    # The last batch once more, as after a failure before its commit.
    for commit in sorted(__import__("glob").glob(f"{checkpoint.removeprefix('file://')}/commits/*1")):
        __import__("os").remove(commit)
    for part in __import__("glob").glob(f"{checkpoint.removeprefix('file://')}/commits/.1.crc"):
        __import__("os").remove(part)
    stream = spark.readStream.schema(schema).parquet(source)
    conversations.converse(stream, replies, path, checkpoint).awaitTermination()
    assert {(r.conv_id, r.turn): (r.question, r.answer) for r in spark.read.parquet(f"{path}/answers/*").collect()} == both
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def test_chat_loop_through_the_flow(spark):
    """The guarded flow answers a conversation: its second question comes with the first one's answer."""
    from sparkloom.operators import vectors

    children = vectors.embedded(spark.createDataFrame([(1, "p", "alpha beta"), (2, "q", "gamma")], "vec_id long, parent_id string, text string")).cache()
    parents = spark.createDataFrame([("p", "alpha beta gamma"), ("q", "gamma delta")], "parent_id string, text string")
    seen = []

    def answer(asked):
        seen.extend(r.history for r in asked.collect())
        return flow.answer(asked, children, parents, flow.stub, flow.Flow(domain=False)).select("qid", "answer")

    source, path, checkpoint = (scratch(spark, x) for x in ("questions", "chat", "stream"))
    spark.createDataFrame([(1, 1, "what is alpha"), (1, 2, "and gamma")], "conv_id long, turn long, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(source)
    conversations.converse(stream, answer, path, checkpoint).awaitTermination()
    said = {r.turn: r.answer for r in spark.read.parquet(f"{path}/answers/v0").collect()}
    assert seen == [None, f"User: what is alpha\nBot: {said[1]}"] and said[2].startswith("Answer of")
