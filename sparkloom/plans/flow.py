"""The guarded answer flow over a table of questions: each node is a projection or a join, each branch a condition, each loop unrolled.

Models stand behind two small interfaces, a generator (prompts to texts, ``None`` for a failed call) and a reranker (a Column). The
stand-ins are deterministic, so the flow runs offline.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import vectors
from sparkloom.session import cut

#: Fixed texts.
NO_CONTEXT = "No relevant information found in the knowledge base."
FAILED = "I encountered an error while generating the answer. Please try again."
OUT_OF_DOMAIN = "I can only answer questions about this knowledge base."
UI_FAILED = "Something went wrong. Please try again."
GRADED_CHARS = 1000


@dataclass(frozen=True)
class Flow:
    """Which stages run, and how often loops may repeat (0 to 2 and 0 to 1 rounds)."""

    domain: bool = True
    rewrite: bool = True
    grading: bool = False
    checking: bool = False
    retries: int = 2
    regenerations: int = 1


Generator = Callable[[str], str | None]


def generated(prompt: Column, model: Generator) -> Column:
    """The model's text for each prompt; null prompts are not sent, failed calls give null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            try:
                return model(p)
            except Exception:  # a failed call is a result of the flow
                return None

        return x.map(one)

    return run(prompt)


def domain_of(raw: Column) -> Column:
    """``out_of_domain`` if the answer contains ``out``; a missing answer is in the domain."""
    return F.when(F.lower(F.trim(raw)).contains("out"), "out_of_domain").otherwise("in_domain")


def hallucination_of(raw: Column) -> Column:
    return F.when(F.lower(F.trim(raw)).contains("hallucinated"), "hallucinated").otherwise("grounded")


def grades(rows: DataFrame, raw: str, n_docs: str, qid: str = "qid") -> DataFrame:
    """Documents kept by a grader's answer: ``qid``, ``doc`` (from 1), ``place``.

    Lines ``n: label`` count in their order, repeats too; a label with ``relevant`` and without ``not`` keeps the document. Malformed lines and numbers out of range are ignored. Documents without a
    grade follow; without an answer all are kept.
    """
    line = rows.select(qid, n_docs, F.posexplode(F.split(F.lower(F.coalesce(raw, F.lit(""))), "\n")).alias("at", "line"))
    number = F.regexp_extract("line", "^\\s*(\\d{1,9})\\s*:", 1).try_cast("int")
    graded = line.select(qid, n_docs, "at", number.alias("doc"), F.regexp_extract("line", ":(.*)$", 1).alias("label")).where(F.col("doc").between(1, F.col(n_docs)))
    kept = graded.where(F.col("label").contains("relevant") & ~F.col("label").contains("not")).select(qid, "doc", F.lit(0).alias("later"), "at")
    every = rows.where(F.col(n_docs) > 0).select(qid, F.explode(F.sequence(F.lit(1), F.col(n_docs))).alias("doc"))
    rest = every.join(graded.select(qid, "doc").distinct(), [qid, "doc"], "left_anti").select(qid, "doc", F.lit(1).alias("later"), F.col("doc").alias("at"))
    place = Window.partitionBy(qid).orderBy("later", "at")
    return kept.unionByName(rest).withColumn("place", F.row_number().over(place)).select(qid, "doc", "place")


def grading_prompt(texts: Column, question: Column) -> Column:
    """Numbered documents, the first characters of each."""
    numbered = F.array_join(F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(x, 1, GRADED_CHARS))), "\n\n")
    return F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nDOCUMENTS:\n"), numbered)


def route_after_grading(grade: Column, retries: Column, most: int = 2) -> Column:
    return F.when((grade == "not_relevant") & (F.coalesce(retries, F.lit(0)) < most), "retry").otherwise("generate")


def route_after_check(grade: Column, rounds: Column, most: int = 1) -> Column:
    return F.when((grade == "hallucinated") & (F.coalesce(rounds, F.lit(0)) < most), "regenerate").otherwise("end")


def retrieved(questions: DataFrame, children: DataFrame, parents: DataFrame, text: str, rerank: Callable[[Column, Column], Column], threshold: bool) -> DataFrame:
    """Search, best child a parent, parent texts, rerank, top ten, and the adaptive cut where asked for."""
    queries = vectors.embedded(questions.select("qid", F.col(text).alias("text")))
    hits = vectors.similar(queries.select("qid", "embedding"), children)
    told = hits.join(children.select(F.col("vec_id").cast("long").alias("vec_id"), "parent_id", F.col("text").alias("child_text")), "vec_id")
    # The best child of each parent; a child without a parent stands for itself.
    first = Window.partitionBy("qid", F.coalesce("parent_id", F.concat(F.lit("child "), F.col("vec_id").cast("string")))).orderBy("rank")
    told = told.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "score")
    pairs = vectors.with_parents(told, parents).join(questions.select("qid", F.col(text).alias("_q")), "qid")
    ranked = vectors.reranked(pairs, rerank(F.col("_q"), F.col("text"))).select("qid", "place", "score", "text")
    return vectors.adaptive_cut(ranked) if threshold else ranked


def answer(questions: DataFrame, children: DataFrame, parents: DataFrame, generate: Generator, flow: Flow = Flow(), rerank: Callable[[Column, Column], Column] = vectors.lexical_score) -> DataFrame:
    """Answers to ``questions`` (``qid``, ``question``, ``history``): one row each, with every grade and counter."""
    state = questions.select("qid", "question", "history")
    raw = generated(F.concat(F.lit("DOMAIN?\n"), F.col("question")), generate) if flow.domain else F.lit("in_domain")
    # Model calls are made once: each stage that has one ends in a checkpoint.
    state = cut(state.withColumn("domain_check", domain_of(raw)))
    asked = state.where("domain_check = 'in_domain'")
    if flow.rewrite:
        prompt = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit("REWRITE\n"), "history", F.lit("\n"), "question"))
        asked = asked.withColumn("rewritten_question", F.coalesce(generated(prompt, generate), "question"))
    else:
        asked = asked.withColumn("rewritten_question", F.col("question"))
    asked = cut(asked)
    docs = cut(retrieved(asked, children, parents, "rewritten_question", rerank, threshold=True))
    asked = asked.withColumns({"retrieval_grade": F.lit("relevant"), "retrieval_retry_count": F.lit(0)})
    if flow.grading:
        for k in range(flow.retries + 1):
            docs, asked = (cut(x) for x in graded(asked, docs, generate, k, flow.retries, children, parents, rerank))
    gathered = vectors.context(docs, most=None).withColumnRenamed("context", "_whole")
    asked = asked.join(gathered, "qid", "left").withColumn("_context", F.coalesce(F.substring("_whole", 1, vectors.CONTEXT_CHARS), F.lit(NO_CONTEXT)))
    say = lambda head, context: F.concat(F.lit(f"{head}\nCONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), F.col("rewritten_question"), F.lit("\n\nANSWER:"))
    asked = cut(asked.withColumn("answer", F.coalesce(generated(say("ANSWER", F.col("_context")), generate), F.lit(FAILED))))
    asked = asked.withColumns({"hallucination_grade": F.lit("grounded"), "hallucination_retry_count": F.lit(0)})
    if flow.checking:
        check = lambda: hallucination_of(generated(F.when(F.col("_whole").isNotNull(), F.concat(F.lit("GROUNDED?\n"), "_whole", F.lit("\n"), "answer")), generate))
        asked = cut(asked.withColumn("hallucination_grade", check()))
        for _ in range(flow.regenerations):
            again = route_after_check(F.col("hallucination_grade"), F.col("hallucination_retry_count"), flow.regenerations) == "regenerate"
            redone = generated(F.when(F.col("_again"), say("STRICT ANSWER", F.col("_whole"))), generate)
            asked = cut(asked.withColumn("_again", again)).withColumn("answer", F.when(F.col("_again"), F.coalesce(redone, F.lit(FAILED))).otherwise(F.col("answer")))
            asked = asked.withColumn("hallucination_retry_count", F.col("hallucination_retry_count") + F.col("_again").cast("int")).withColumn("hallucination_grade", F.when(F.col("_again"), check()).otherwise(F.col("hallucination_grade"))).drop("_again")
            asked = cut(asked)
    columns = ["qid", "question", "rewritten_question", "domain_check", "retrieval_grade", "retrieval_retry_count", "hallucination_grade", "hallucination_retry_count", "answer"]
    turned = state.where("domain_check = 'out_of_domain'").withColumns({"rewritten_question": F.col("question"), "retrieval_grade": F.lit(None).cast("string"), "retrieval_retry_count": F.lit(0), "hallucination_grade": F.lit(None).cast("string"), "hallucination_retry_count": F.lit(0), "answer": F.lit(OUT_OF_DOMAIN)})
    return asked.select(columns).unionByName(turned.select(columns))


def graded(asked: DataFrame, docs: DataFrame, generate: Generator, k: int, retries: int, children: DataFrame, parents: DataFrame, rerank) -> tuple[DataFrame, DataFrame]:
    """One grading round, and a new search (without the cut) for questions of which nothing was relevant, as long as rounds are left."""
    texts = docs.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda v: v.text).alias("texts"))
    told = asked.join(texts, "qid", "left").withColumn("n_docs", F.coalesce(F.size("texts"), F.lit(0)))
    told = cut(told.withColumn("raw", generated(F.when(F.col("n_docs") > 0, grading_prompt(F.col("texts"), F.col("rewritten_question"))), generate)))
    kept = grades(told, "raw", "n_docs").withColumnRenamed("place", "new_place")
    left = docs.withColumn("doc", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).join(kept, ["qid", "doc"]).select("qid", F.col("new_place").alias("place"), "score", "text")
    left = cut(left)
    some = left.select("qid").distinct().withColumn("_some", F.lit(True))
    asked = told.drop("texts", "n_docs", "raw").join(some, "qid", "left").withColumn("retrieval_grade", F.when(F.col("_some"), "relevant").otherwise("not_relevant")).drop("_some")
    if k == retries:
        return left, asked
    again = route_after_grading(F.col("retrieval_grade"), F.col("retrieval_retry_count"), retries) == "retry"
    asked = cut(asked)
    failed = cut(asked.where(again).withColumn("rewritten_question", F.coalesce(generated(F.concat(F.lit("RETRY\n"), "question"), generate), "question")))
    fresh = retrieved(failed, children, parents, "rewritten_question", rerank, threshold=False)
    redone = failed.withColumn("retrieval_retry_count", F.col("retrieval_retry_count") + 1)
    return left.unionByName(fresh), asked.where(~again).unionByName(redone)


def ui_history(history: list, most: int = 15) -> list[tuple[str, str]]:
    """Role and text of the last messages of either wire form: dictionaries with role and content, or pairs of both sides."""
    out: list[tuple[str, str]] = []
    for x in history:
        if isinstance(x, dict):
            out.append((x.get("role", "user"), x.get("content") or ""))
        else:
            out += [(role, said) for role, said in zip(("user", "assistant"), x, strict=False) if said]
    return out[-most:]


def ui_answer(message: str, history: list, ask: Callable[[str, list[tuple[str, str]]], str], most: int = 15) -> str:
    """One turn of a chat interface: the adapted history goes to ``ask``; a failure gives a fixed text."""
    try:
        return ask(message, ui_history(history, most))
    except Exception:  # shown to the user as a text
        return UI_FAILED


def stub(prompt: str) -> str:
    """A deterministic stand-in for a language model."""
    kind, _, rest = prompt.partition("\n")
    if kind == "DOMAIN?":
        return "in_domain" if len(rest) % 7 else "out_of_domain"
    if kind == "GROUNDED?":
        return "grounded" if len(rest) % 3 else "hallucinated"
    if kind.startswith("QUESTION:"):
        return "\n".join(f"{i}: {'relevant' if i % 2 else 'not_relevant'}" for i in range(1, 11))
    if kind in ("REWRITE", "RETRY"):
        return rest.rsplit("\n", 1)[-1]
    return f"Answer of {len(rest)} characters."
