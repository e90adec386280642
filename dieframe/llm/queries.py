"""The queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ball_tree import OP11_SQL, op11_ball_tree
from .bpe import op1_bpe
from .maxscore import OP9_SQL, op9_maxscore
from .mixing import OP5_SQL, op5_mixing
from .ngram_jaccard import op10_ngram_jaccard
from .packing import op13_packing
from .periodic_runs import op12_periodic_runs
from .secrets import op3_secrets
from .substring_dedup import op2_substring_dedup
from .tool_calls import OP6_SQL, op6_tool_calls
from .toxicity import op4_toxicity
from .warc import op8_warc
from .webp import op7_webp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_tool_calls": op6_tool_calls,
    "op7_webp": op7_webp,
    "op8_warc": op8_warc,
    "op9_maxscore": op9_maxscore,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_ball_tree": op11_ball_tree,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": OP5_SQL,
    "op6_tool_calls": OP6_SQL,
    "op9_maxscore": OP9_SQL,
    "op11_ball_tree": OP11_SQL,
}
