"""Registered queries of the training-data operators, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from sparkloom.llm import queries as q
from sparkloom.llm import sql

QUERIES = {
    "op1_license_patience": q.op1_license_patience,
    "op2_rule_ledger": q.op2_rule_ledger,
    "op3_grammar_ids": q.op3_grammar_ids,
    "op4_toxicity_chain": q.op4_toxicity_chain,
    "op5_odd_sketches": q.op5_odd_sketches,
    "op6_secret_novelty": q.op6_secret_novelty,
    "op7_chat_layouts": q.op7_chat_layouts,
    "op8_containment": q.op8_containment,
    "op9_certified_packing": q.op9_certified_packing,
    "op10_jump_shards": q.op10_jump_shards,
    "op11_bitmap_audit": q.op11_bitmap_audit,
    "op12_bit_sliced": q.op12_bit_sliced,
    "op13_periodic_runs": q.op13_periodic_runs,
    "rule_ablations": q.rule_ablations,
}
ORACLES = {
    "op2_rule_ledger": sql.RULE_LEDGER,
    "op11_bitmap_audit": sql.BITMAP_AUDIT,
    "rule_ablations": sql.RULE_ABLATIONS,
}
