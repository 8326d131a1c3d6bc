from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docveil.operators.intervals import IntervalMap, coverage

SCHEMA = "document_id long, part_name string, start_offset int, end_offset int, kind string"


def brute(rows):
    out = []
    for key in {r[:2] for r in rows}:
        spans = sorted((s, e) for a, b, s, e, _ in rows if (a, b) == key and s is not None and e is not None and e > s)
        merged: list[list[int]] = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(*key, "period", s, e) for s, e in merged]
        out += [(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out, key=repr)


def run(spark, rows, cell):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in coverage(df, F.col("document_id"), F.col("part_name"), F.col("start_offset"), F.col("end_offset"), cell).collect()), key=repr)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9))))
def test_map_matches_brute_force(spans):
    m = IntervalMap()
    for s, n in spans:
        m.insert(s, s + n)
    rows = [(1, "a", s, s + n, None) for s, n in spans]
    want = sorted((s, e) for *_, k, s, e in brute(rows) if k == "period")
    assert list(zip(m.starts, m.ends, strict=True)) == want


def test_coverage_over_cell_edges(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), rng.choice(["body", None]), (s := rng.randrange(-30, 200)), s + rng.choice([1, 2, 3, 5, 17, 40]), "x") for _ in range(90)]
    rows += rows[:10] + [(1, "body", None, 4, None), (1, "body", 4, None, None), (1, "body", 7, 7, None), (1, "body", 9, 3, None)]
    for cell in (4, 10, 65_536):
        assert run(spark, rows, cell) == brute(rows)


def test_empty(spark):
    assert run(spark, [], 10) == []
