"""The queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact, lines, negatives, oracles, periodic, pieces, quality, rules, secrets, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_token_counts": pieces.op6_token_counts,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_exact_dedup": exact.op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op2_decontaminate": oracles.DECONTAMINATION,
    "op5_quality_rules": oracles.QUALITY_RULES,
    "op7_secret_scans": oracles.SECRET_SCANS,
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_exact_dedup": oracles.EXACT_DEDUP,
}
