"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once. The ledger keeps the measurements and one bit for
each failed rule; a policy is a named, versioned mask over those bits, and
ablations are counted from the masks without touching the texts again.

Defined results. Null and empty text have no words: all measurements are 0, and the
rules on too few words fail. Rows are independent, so repeats and ties change
nothing; an empty table gives an empty ledger. Columns other than id and text are
not carried. All work on a text is linear, or sorts its own windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACE


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition on the measurements; its place in the list is its bit."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of these rules."""

    name: str
    version: int
    rules: tuple[str, ...]


#: Bits are for ever: add rules at the end only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("upper_case", "100 * n_upper > 60 * word_chars"),
    Rule("exclamations", "10 * n_exclaim > 3 * n_words"),
)
POLICIES = (
    Policy("base", 1, ("few_words", "repeated_windows")),
    Policy("strict", 2, tuple(x.name for x in RULES)),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable, which no optimizer rule repeats."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted with their places; neighbours of equal text are repeats. Their places, sorted
    again, cover three words each, or as many as lie before the next one.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    again = lambda s: F.array_sort(
        F.transform(
            F.filter(s, lambda x, k: (x.w == F.get(s, k - 1).w) | (x.w == F.get(s, k + 1).w)),
            lambda x: x.i,
        )
    )
    covered = lambda p: F.aggregate(
        p, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a.n + F.least(i - a.at, F.lit(3))).alias("n")),
    ).n
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.array_sort(windows), lambda s: let(again(s), covered)))


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    # Optional: a text that starts with white space has an empty first part.
    parts = F.filter(F.split(body, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    left = lambda keep: F.length(F.regexp_replace(body, keep, ""))
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        let(parts, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("m"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        left(f"[{SPACE}]+").cast("long").alias("word_chars"),
        left("[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        left("[^A-Z]+").cast("long").alias("n_upper"),
        left("[^!]+").cast("long").alias("n_exclaim"),
    )
    return found.select("doc_id", "m.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "m.n_repeat_words", "n_upper", "n_exclaim")


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(0).cast("long")
    for bit, rule in enumerate(rules):
        out = out.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    place = {x.name: bit for bit, x in enumerate(rules)}
    return sum(1 << place[x] for x in policy.rules)


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed_bits`` of each document."""
    return measured(docs, id_col, text).withColumn("failed_bits", failure_bits(rules))


def decided(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``kept`` under one policy, from the ledger alone."""
    return found.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0).withColumn("policy", F.lit(f"{policy.name}-v{policy.version}"))


def ablations(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that are kept without it. One row, then unfolded: no shuffle but the sums."""
    whole = mask(policy, rules)
    bits = [(x.name, 1 << i) for i, x in enumerate(rules) if x.name in policy.rules]
    failed = F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long"))
    sums = [F.count("*").alias("n")]
    for name, bit in bits:
        sums += [F.count_if(failed.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{name}_fails"), F.count_if(failed == bit).alias(f"{name}_alone"), F.count_if(failed.bitwiseAND(F.lit(whole & ~bit).cast("long")) == 0).alias(f"{name}_without")]
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"{name}_fails").alias("n_fails"), F.col(f"{name}_alone").alias("n_alone"), F.col(f"{name}_without").alias("n_kept_without")) for name, _ in bits]
    return found.agg(*sums).select(F.inline(F.array(*rows)))
