"""Named queries of the operators in this subpackage and, where SQL can express them, their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumipair.llm import (
    bpe,
    exact_dedup,
    language,
    near_dedup,
    packing,
    periodic_runs,
    pii,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_counts,
    token_files,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.op1_token_files,
    "op2_packing": packing.op2_packing,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_language": language.op5_language,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_simhash": near_dedup.op7_simhash,
    "op8_pii": pii.op8_pii,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
