"""All queries of the llm subpackage."""

from __future__ import annotations

from docveil.llm import canonical, language, mixing, mojibake, names, packing, personal, scans, truncated

MODULES = (canonical, language, mixing, mojibake, names, packing, personal, scans, truncated)


def queries():
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
