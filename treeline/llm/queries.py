"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.html_extract import op2_html_extraction
from treeline.llm.language_model import op7_language_model
from treeline.llm.line_dedup import OP9_SQL, op9_line_dedup
from treeline.llm.mixing import op6_mixing
from treeline.llm.near_dedup import OP4_SQL, op4_near_dedup
from treeline.llm.packing import op5_packing
from treeline.llm.quality import op1_quality
from treeline.llm.token_counts import op10_token_counts
from treeline.llm.topk import OP8_SQL, op8_topk
from treeline.llm.winnowing import OP3_SQL, op3_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_html_extraction": op2_html_extraction,
    "op3_winnowing": op3_winnowing,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_language_model": op7_language_model,
    "op8_topk": op8_topk,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op3_winnowing": OP3_SQL, "op4_near_dedup": OP4_SQL, "op8_topk": OP8_SQL, "op9_line_dedup": OP9_SQL}
