"""The queries of this subpackage and their SQL for the oracle."""

from __future__ import annotations

from . import binary_output, bpe, exact_dedup, line_dedup, mixing, near_dedup, quality_crf, quality_rules, secrets, token_rollup

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_binary_output": binary_output.op3_binary_output,
    "op4_bpe": bpe.op4_bpe,
    "op5_secrets": secrets.op5_secrets,
    "op6_quality_classifier": quality_crf.op6_quality_classifier,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_token_counts": token_rollup.op9_token_counts,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLE_SQL = {"op1_mixing": mixing.oracle(), "op10_exact_dedup": exact_dedup.OP10_SQL}
