"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: module, query
OPERATORS = [
    ("op2_quality", "op2_rff_quality"),
    ("op1_lm_score", "op1_lm_score"),
    ("op5_html_text", "op5_site_text"),
    ("op3_sharding", "op3_ring_sharding"),
    ("op9_embedding_near_dedup", "op9_lattice_near_dedup"),
    ("op6_byte_bpe", "op6_byte_bpe"),
    ("op8_language_id", "op8_language_id"),
    ("op4_decontamination", "op4_winnowing_decontamination"),
    ("op7_near_dedup", "op7_minhash_near_dedup"),
    ("op10_substrings", "op10_substring_dedup"),
    ("op11_token_files", "op11_token_files"),
    ("op12_alignment", "op12_token_alignment"),
    ("op13_spelling", "op13_spelling_variants"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module, _query in OPERATORS:
    _m = import_module(f"{__package__}.{_module}")
    QUERIES[_query] = getattr(_m, _query)
    if getattr(_m, "SQL", None):
        ORACLES[_query] = _m.SQL
