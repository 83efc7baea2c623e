"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_query import op1_bpe
from .classifier_queries import op6_toxicity, op7_quality
from .embedding_dedup_query import OP2_SQL, op2_embedding_dedup
from .exact_dedup_query import OP4_SQL, op4_exact_dedup
from .license_query import OP9_SQL, op9_license_scan
from .line_dedup_query import OP10_SQL, op10_line_dedup
from .minhash_query import OP8_SQL, op8_minhash
from .packing_query import op5_best_fit_packing
from .suffix_dedup_query import OP3_SQL, op3_suffix_array


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_suffix_array": op3_suffix_array,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_minhash": op8_minhash,
        "op9_license_scan": op9_license_scan,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": OP2_SQL,
        "op3_suffix_array": OP3_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op8_minhash": OP8_SQL,
        "op9_license_scan": OP9_SQL,
        "op10_line_dedup": OP10_SQL,
    }
