"""The queries of the training-data operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taktwerk.llm.chat import OP4_SQL, op4_chat_formatting
from taktwerk.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from taktwerk.llm.html_text import op10_html_extraction
from taktwerk.llm.importance import OP13_SQL, op13_importance_resampling
from taktwerk.llm.mixing import op5_mixing
from taktwerk.llm.ngram_join import op2_ngram_join
from taktwerk.llm.packing import op9_packing
from taktwerk.llm.quality_model import op6_quality_classifier
from taktwerk.llm.quality_rules import op7_quality_rules
from taktwerk.llm.sharding import op1_sharding
from taktwerk.llm.token_files import op8_token_files
from taktwerk.llm.toxicity import op12_toxicity
from taktwerk.llm.vector_search import OP3_SQL, op3_vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_ngram_join": op2_ngram_join,
        "op3_vector_search": op3_vector_search,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_mixing": op5_mixing,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_files": op8_token_files,
        "op9_packing": op9_packing,
        "op10_html_extraction": op10_html_extraction,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_toxicity": op12_toxicity,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_vector_search": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op11_fill_in_middle": OP11_SQL, "op13_importance_resampling": OP13_SQL}
