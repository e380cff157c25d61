"""The queries of this subpackage, one an operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import pipeline
from quarryline.llm.decontaminate import LEAKS_SQL, op3_decontaminate
from quarryline.llm.line_dedup import LINES_SQL, op1_line_dedup
from quarryline.llm.lm_score import op7_lm_score
from quarryline.llm.mixing import MIX_SQL, op10_mixing
from quarryline.llm.neighbours import op4_neighbours
from quarryline.llm.simhash import op8_simhash
from quarryline.llm.substring_dedup import REPEATS_SQL, op9_substring_dedup
from quarryline.llm.token_counts import op2_token_counts
from quarryline.llm.toxicity import op5_toxicity
from quarryline.llm.url_filter import URL_SQL, op6_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_token_counts, op3_decontaminate, op4_neighbours, op5_toxicity, op6_url_filter, op7_lm_score, op8_simhash, op9_substring_dedup, op10_mixing, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINES_SQL, "op3_decontaminate": LEAKS_SQL, "op6_url_filter": URL_SQL, "op9_substring_dedup": REPEATS_SQL, "op10_mixing": MIX_SQL}
