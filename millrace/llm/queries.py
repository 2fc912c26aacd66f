"""The queries of this subpackage and the SQL that expresses them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup
from .decontaminate import op7_decontamination
from .embeddings import op3_embedding_dedup
from .language_id import op1_language_id
from .line_dedup import op5_line_dedup
from .minhash import op8_minhash
from .packing import op6_packing
from .secrets import op4_secrets
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = (op1_language_id, op2_substring_dedup, op3_embedding_dedup, op4_secrets, op5_line_dedup, op6_packing, op7_decontamination, op8_minhash, op9_toxicity, op10_suffix_dedup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.ORACLE}
