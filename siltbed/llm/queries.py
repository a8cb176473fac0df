"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm import minhash_dedup, quality_rules, source_mixing
from siltbed.llm.language_id import op6_language_id
from siltbed.llm.mpeg_audio import op7_mpeg_audio
from siltbed.llm.packing import op10_packing
from siltbed.llm.quality_classifier import op3_quality_classifier
from siltbed.llm.suffix_tree_lm import op4_suffix_tree_lm
from siltbed.llm.token_counts import op5_token_counts
from siltbed.llm.wavelet_matrix import op8_wavelet_matrix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
        "op2_source_mixing": source_mixing.op2_source_mixing,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_suffix_tree_lm": op4_suffix_tree_lm,
        "op5_token_counts": op5_token_counts,
        "op6_language_id": op6_language_id,
        "op7_mpeg_audio": op7_mpeg_audio,
        "op8_wavelet_matrix": op8_wavelet_matrix,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": minhash_dedup.ORACLE, "op2_source_mixing": source_mixing.ORACLE, "op9_quality_rules": quality_rules.ORACLE}
