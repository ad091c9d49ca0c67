"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Each is a module here with query(spark, sf_dir) and SQL (None where SQL can't express it).
OPERATORS = (
    "op2_best_fit_packing",
    "op4_lm_scoring",
    "op9_sentencepiece",
    "op3_simhash_neardup",
    "op7_media_columns",
    "op10_language_id",
    "op6_line_dedup",
    "op1_license_scan",
    "op5_url_filter",
    "op8_exact_dedup",
)


def queries() -> dict:
    return {name: import_module(f"{__package__}.{name}").query for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f"{__package__}.{name}").SQL for name in OPERATORS}
    return {name: sql for name, sql in found.items() if sql}
