"""The corpus queries: one opN_<name> for each operator, and pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op6_audio
from .byte_pairs import op11_byte_pairs
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .licenses import op3_licenses
from .mixing import op5_mixing
from .packing import op9_packing
from .quality_model import op10_quality_model
from .quality_rules import OP8_SQL, op8_quality_rules
from .sharding import op2_sharding
from .simhash import op1_simhash
from .toxicity import op4_toxicity
from .url_rules import op7_url_rules
from .vector_codes import OP12_SQL, op12_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_sharding": op2_sharding,
        "op3_licenses": op3_licenses,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_audio": op6_audio,
        "op7_url_rules": op7_url_rules,
        "op8_quality_rules": op8_quality_rules,
        "op9_packing": op9_packing,
        "op10_quality_model": op10_quality_model,
        "op11_byte_pairs": op11_byte_pairs,
        "op12_vector_codes": op12_vector_codes,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": OP8_SQL, "op12_vector_codes": OP12_SQL, "op13_hard_negatives": OP13_SQL}
