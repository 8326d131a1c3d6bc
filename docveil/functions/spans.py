"""Places of pattern matches as code-point offsets, without leaving the JVM.

One scan puts a mark before and after every match; the marks part the text into what is between the matches and the
matches themselves, in turn, and a running sum of their lengths gives the offsets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\u0001", "\u0002"
SPANS = "array<struct<start:int,end:int,value:string,whole:string>>"


def quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def once(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value, which is computed once. Inside other lambdas an expression would be computed
    anew for every element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def matches_sql(text: str, pattern: str, group: int = 0, shown: str | None = None) -> str:
    """The expression of ``matches`` over columns by name, as SQL: it is parsed in one go, where the rules of a whole
    inventory would take thousands of calls to build. ``shown`` is a column as wide, from which the values are taken."""
    shown = shown or text
    # The marks themselves may stand in a text: there they are another control character while it is scanned.
    marked = f"regexp_replace(translate({text}, '{_OPEN}{_CLOSE}', '\u0003\u0003'), {quoted(pattern)}, '{_OPEN}$0{_CLOSE}')"
    step = "named_struct('at', acc.at + length(q[i - 1]) + length(q[i]), 'out', concat(acc.out, array(named_struct('s', acc.at + length(q[i - 1]), 'e', acc.at + length(q[i - 1]) + length(q[i])))))"
    places = f"aggregate(sequence(1, size(q) - 2, 2), named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRUCT<s: INT, e: INT>>)), (acc, i) -> {step}, acc -> acc.out)"
    if group:
        whole = f"substr({shown}, z.`0`.s + 1, z.`0`.e - z.`0`.s)"
        at = "z.`0`.s + IF(z.`1` = '', 0, z.`0`.e - z.`0`.s - length(z.`1`) - instr(reverse(w), reverse(z.`1`)) + 1)"
        one = once(whole, "w", f"named_struct('start', {at}, 'end', {at} + length(z.`1`), 'value', z.`1`, 'whole', w)")
        each = f"transform(arrays_zip({places}, regexp_extract_all({text}, {quoted(pattern)}, {group})), z -> {one})"
    else:
        value = f"substr({shown}, z.s + 1, z.e - z.s)"
        each = f"transform({places}, z -> named_struct('start', z.s, 'end', z.e, 'value', {value}, 'whole', {value}))"
    found = once(f"split(m, '[{_OPEN}{_CLOSE}]', -1)", "q", each)
    listed = once(marked, "m", f"IF(instr(m, '{_OPEN}') = 0, CAST(array() AS {SPANS}), {found})")
    return f"IF({text} IS NULL, NULL, {listed})"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``ARRAY<STRUCT<start, end, value, whole>>`` of all matches in a column: half-open offsets of ``group`` (its last
    place in the whole match), and both values. Empty where there is none; null for a null text. No pattern may match the
    empty string."""
    name = re.fullmatch(r"Column<'([\w.`]+)'>", str(text))
    if not name:
        raise ValueError("The text must be a column by its name.")
    return F.expr(matches_sql(name[1], pattern, group))
