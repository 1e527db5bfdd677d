"""The thin queries over whole tables: each calls its operator with production parameters and derives the digests."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bit_sliced, certified_packing, chat_layouts, containment, grammar_ids, interaction_audit, jump_shards, license_patience, odd_sketches, periodic_runs, rule_ledger, secret_novelty, tokens, toxicity_chain
from sparkloom.llm.common import shared_dir, written
from sparkloom.session import table


def op1_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    return license_patience.scan(table(spark, sf_dir, "documents"))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all documents; ``kept`` by the strict policy, which contains the base rules."""
    found = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    base, strict = rule_ledger.POLICIES
    failed = rule_ledger.decided(found, base).withColumn("base_failed", ~F.col("kept")).drop("kept", "policy")
    return rule_ledger.decided(failed, strict).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the strict policy over all documents: how many fail it, fail it alone, and would be kept without it; from the ledger's bits."""
    found = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rule_ledger.ablations(found, rule_ledger.POLICIES[1])


def op3_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written in the block format, then read back from the files."""
    path = f"{shared_dir(spark)}/sparkloom-blocks-{uuid.uuid4().hex}"
    grammar_ids.write_blocks(table(spark, sf_dir, "documents"), path, tokens.public_path())
    return grammar_ids.read_documents(spark, path)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity_chain.Chain:
    """The chain over the label table: low quality first, since junk is seldom labelled toxic, then toxic."""
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return toxicity_chain.train(docs, table(spark, sf_dir, "labels"), categories)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all documents, and whether each is held toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_model(spark, docs, sf_dir)
    return toxicity_chain.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= chain.thresholds["toxic"])


def op5_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.75."""
    return odd_sketches.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    return secret_novelty.scan(table(spark, sf_dir, "documents"))


def op7_chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, which are turn rows, and conversation -7, a record of messages; written, then read back."""
    said = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    added = spark.createDataFrame([(-7, record)], "conv_id bigint, record string")
    turns = chat_layouts.from_rows(table(spark, sf_dir, "conversations")).unionByName(chat_layouts.from_json(added))
    return chat_layouts.digests(written(chat_layouts.formatted(turns), "chat"))


def op8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return containment.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return certified_packing.pack(table(spark, sf_dir, "documents"), tokens.public_path(), capacity=2048)


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of all documents, and the shard with one more."""
    return jump_shards.assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op11_bitmap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over all documents, by language, with what they cost in good and save in toxic documents."""
    flags = interaction_audit.failures(table(spark, sf_dir, "documents"))
    rows = interaction_audit.labelled(flags, table(spark, sf_dir, "labels"), {"good": "quality = 1", "toxic": "toxic = 1"})
    return interaction_audit.report(interaction_audit.subset_counts(rows))


def op12_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in three bits at most."""
    return bit_sliced.near_duplicates(table(spark, sf_dir, "documents"))


def repeated_tail(key: int | None, found: list[bytes]) -> list[bytes]:
    """For a tenth of the ids, the words from some place on are a few words said again and again."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n = len(found)
    if h % 10 or not n:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + (found[a : a + p] * -(-(n - a) // p))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which end in a repetition."""
    return periodic_runs.scan(table(spark, sf_dir, "documents"), repeated_tail)
