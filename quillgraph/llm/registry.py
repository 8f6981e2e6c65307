"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .chat import op8_chat_format
from .decontaminate import op9_decontaminate
from .html import op10_html_content
from .lines import op6_line_dedup
from .packing import op5_packing
from .pii import op4_pii
from .quality import op3_quality_rules
from .simhash import op1_simhash
from .toxicity import op7_toxicity
from .urls import op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_url_filter": op2_url_filter,
        "op3_quality_rules": op3_quality_rules,
        "op4_pii": op4_pii,
        "op5_packing": op5_packing,
        "op6_line_dedup": op6_line_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_chat_format": op8_chat_format,
        "op9_decontaminate": op9_decontaminate,
        "op10_html_content": op10_html_content,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
