"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_pii_surrogates": "pii",
    "op5_tool_calls": "toolcalls",
    "tool_calls_derived": "toolcalls",
    "op6_embedding_dedup": "rpforest",
    "op10_html_extraction": "styletree",
    "op7_language_id": "langid",
    "op9_quality": "puquality",
    "op4_ppm_score": "ppm",
    "op3_decontamination": "decontam",
    "op2_source_mixing": "mixing",
    "op8_minhash_dedup": "minhash",
}


def queries() -> dict:
    return {name: getattr(import_module(f"lagstream.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _QUERIES.items():
        short = name.split("_")[0] if name.startswith("op") else name
        sql = getattr(import_module(f"lagstream.llm.{module}"), f"{short.upper()}_SQL", None)
        if sql:
            found[name] = sql
    return found
