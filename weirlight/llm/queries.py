"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirlight.llm.decontaminate import op9_decontaminate
from weirlight.llm.html_extract import op8_html_extract
from weirlight.llm.line_dedup import OP3_SQL, op3_line_dedup
from weirlight.llm.near_dedup import OP4_SQL, op4_near_dedup
from weirlight.llm.neighbours import op5_nearest
from weirlight.llm.packing import op2_pack
from weirlight.llm.secret_scan import op10_secrets
from weirlight.llm.suffix_dedup import OP6_SQL, op6_suffix_dedup
from weirlight.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from weirlight.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pack": op2_pack,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_nearest": op5_nearest,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
}
