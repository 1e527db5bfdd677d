"""A corpus pipeline of five stages over ``documents``; each reads what its predecessor wrote.

Toxic documents go; of near-duplicates one stays; documents that contain a benchmark item go; secrets are replaced by a mark
(``n_chars`` follows the text); what is left is packed into sequences.

Defined results, of all stages. Null, empty and blank texts are neither toxic nor copies nor contaminated, and hold no secrets; they are packed as their end id alone. Rows without an id are copies of nothing and stay. Rows that share an id
are one document to the near-dedup stage, which keeps one of them. Ties don't matter: components are named by their smallest id, and packing places every row. Texts of any length are taken whole. Columns that the
documents have besides are kept as they are, whatever their names, by all but the last stage. An empty table goes through all stages and stays empty; without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import certified_packing, containment, odd_sketches, queries, secret_novelty, tokens, toxicity_chain
from sparkloom.llm.common import written
from sparkloom.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not hold toxic, at the threshold that it has learnt for its recall."""
    return toxicity_chain.cleaned(docs, queries.toxicity_model(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return odd_sketches.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    hidden = secret_novelty.redacted(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 ids."""
    return certified_packing.pack(docs, tokens.public_path(), capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]
#: Learned scores and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
