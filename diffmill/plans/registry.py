"""All queries over the reference-style operators, with their oracle SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that each have QUERIES and ORACLE.
MODULES = ("feedback", "routing", "findings", "code", "reports", "tool_reports", "review", "events", "settings")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"diffmill.plans.{name}"), attribute)
        if clash := found.keys() & part.keys():
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
