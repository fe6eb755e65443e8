"""The operators' queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidra.llm.html_text import op8_html_text
from evidra.llm.line_dedup import OP4_SQL, op4_line_dedup
from evidra.llm.lm_score import op9_lm_score
from evidra.llm.minhash import op1_minhash
from evidra.llm.mixing import OP2_SQL, op2_mixing
from evidra.llm.negatives import OP12_SQL, op12_negatives
from evidra.llm.pieces import op6_pieces
from evidra.llm.quality import op5_quality
from evidra.llm.resampling import OP13_SQL, op13_resampling
from evidra.llm.token_counts import op11_token_counts
from evidra.llm.topk import OP3_SQL, op3_topk
from evidra.llm.toxicity import op7_toxicity
from evidra.llm.warc import OP10_SQL, op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator."""
    return {
        "op1_minhash": op1_minhash,
        "op2_mixing": op2_mixing,
        "op3_topk": op3_topk,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality": op5_quality,
        "op6_pieces": op6_pieces,
        "op7_toxicity": op7_toxicity,
        "op8_html_text": op8_html_text,
        "op9_lm_score": op9_lm_score,
        "op10_warc": op10_warc,
        "op11_token_counts": op11_token_counts,
        "op12_negatives": op12_negatives,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the operator."""
    return {"op2_mixing": OP2_SQL, "op3_topk": OP3_SQL, "op4_line_dedup": OP4_SQL, "op10_warc": OP10_SQL, "op12_negatives": OP12_SQL, "op13_resampling": OP13_SQL}
