"""The functions by name, for SQL: defined in SQL, so the optimizer sees through them."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from docveil.functions.text import FOLDED, FOLDED_AS
from docveil.operators.rules import RULES, Rule

_DIGITS = "transform(split(x, ''), c -> try_cast(c AS INT))"
FUNCTIONS = {
    "tr_fold": ("x STRING", "STRING", "lower(translate(x, 'İI', 'iı'))"),
    "fold_diacritics": ("x STRING", "STRING", f"lower(translate(x, '{FOLDED}', '{FOLDED_AS}'))"),
    "contains_folded": ("x STRING, y STRING", "BOOLEAN", f"contains(lower(translate(x, '{FOLDED}', '{FOLDED_AS}')), lower(translate(y, '{FOLDED}', '{FOLDED_AS}')))"),
    "valid_tckn": (
        "x STRING",
        "BOOLEAN",
        f"coalesce(CASE WHEN x RLIKE '^[1-9][0-9]{{10}}$' THEN transform(array({_DIGITS}), d -> d[9] = pmod((d[0] + d[2] + d[4] + d[6] + d[8]) * 7 - (d[1] + d[3] + d[5] + d[7]), 10) "
        "AND d[10] = pmod(aggregate(slice(d, 1, 10), 0, (a, v) -> a + v), 10))[0] END, false)",
    ),
    "valid_vkn": (
        "x STRING",
        "BOOLEAN",
        f"coalesce(CASE WHEN x RLIKE '^[0-9]{{10}}$' THEN transform(array({_DIGITS}), d -> d[9] = pmod(10 - pmod(aggregate(sequence(0, 8), 0, (a, i) -> a + CASE WHEN pmod(d[i] + 9 - i, 10) = 0 THEN 0 "
        "WHEN pmod(pmod(d[i] + 9 - i, 10) * shiftleft(1, 9 - i), 9) = 0 THEN 9 ELSE pmod(pmod(d[i] + 9 - i, 10) * shiftleft(1, 9 - i), 9) END), 10), 10))[0] END, false)",
    ),
}


def register_rules(spark: SparkSession, rules: tuple[Rule, ...] = RULES, name: str = "detect_spans") -> str:
    """Makes a table function of the rules known to the session: ``SELECT t.id, d.* FROM t, LATERAL detect_spans(t.text) d``
    gives ``category, risk, start, end, value`` of what ``findings`` gives in a text, courts and address starts aside. Its
    rules are those given, so a caller adds some of their own."""
    from pyspark.sql.functions import udtf

    listed = [(r.category, r.risk, re.compile(_for_python(r)), r.group) for r in rules if r.keep is None]

    @udtf(returnType="category string, risk string, start int, end int, value string")
    class Spans:
        def eval(self, text: str):
            for category, risk, pattern, group in listed:
                for m in pattern.finditer(text or ""):
                    yield category, risk, *m.span(group), m[group].strip()

    spark.udtf.register(name, Spans)
    return name


def _for_python(rule: Rule) -> str:
    """The pattern in Python's dialect, which has no separate flag for Unicode case or classes."""
    flags = "i" if "i" in rule.flags else ""
    return (f"(?{flags})" if flags else "") + rule.pattern.replace("(?iu:", "(?i:")


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return sorted(FUNCTIONS)
