"""The corpus operators' queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_QUERIES = ("op1_fingerprints", "op2_simhash", "op3_mixing", "op4_repeats", "op5_secrets", "op6_html", "op7_token_output", "op8_packing", "op9_toxicity", "op10_exact_dedup")


def _module(name: str):
    return importlib.import_module(f"lumenframe.llm.queries.{name}")


def queries() -> dict:
    found = {name: _module(name).query for name in _QUERIES}
    import corpus_pipeline

    found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name in _QUERIES if (sql := _module(name).ORACLE_SQL)}
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
