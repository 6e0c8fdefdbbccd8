"""The queries opN_<name> and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module that has query() and, where SQL can express it, ORACLE.
MODULES = {
    "op1_token_counts": "token_counts",
    "op2_exact_dedup": "exact_dedup",
    "op3_warc": "warc",
    "op4_sharding": "sharding",
    "op5_simhash": "simhash",
    "op6_quality_rules": "quality_rules",
    "op7_packing": "packing",
    "op8_chat_format": "chat_format",
    "op9_secret_scan": "secret_scan",
    "op10_mixing": "mixing",
}


def queries() -> dict:
    return {name: import_module(f"diffmill.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"diffmill.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
