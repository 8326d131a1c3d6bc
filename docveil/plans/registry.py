"""All queries outside the llm subpackage."""

from __future__ import annotations

from docveil.plans import cases, catalog, detection, intervals, review, texts, workspace

MODULES = (intervals, cases, detection, catalog, texts, review, workspace)


def queries():
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
