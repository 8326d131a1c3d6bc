from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.functions.checks import valid_tckn, valid_vkn
from docveil.functions.spans import matches


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).collect()[0][0]


@pytest.mark.parametrize(
    ("digits", "ok"), [("10000000146", True), ("12345678901", False), ("01234567890", False), ("1000000014", False), ("", False), (None, False), ("1000000014x", False)]
)
def test_tckn(spark, digits, ok):
    assert one(spark, digits, valid_tckn) is ok


@pytest.mark.parametrize(("digits", "ok"), [("1234567890", True), ("1234567891", False), ("123456789", False), ("", False), (None, False), ("12345x7890", False)])
def test_vkn(spark, digits, ok):
    assert one(spark, digits, valid_vkn) is ok


def test_layout(spark):
    assert one(spark, "  a  \r\nb\x07 \t\n\n\n\nc  d\t\n", tx.normalize_layout) == "a\nb\n\nc  d"
    assert one(spark, None, tx.normalize_layout) is None


def test_folds(spark):
    assert one(spark, "İSTANBUL  IŞIK ", tx.pseudonym_key) == "istanbul ışık"
    assert one(spark, "Şüpheli ÂÎ", tx.search_fold) == "supheli ai"


@pytest.mark.parametrize(
    ("name", "version", "date"),
    [("sozlesme_v2_son.docx", "v2", None), ("Report 20240315.pdf", None, "2024-03-15"), ("15-03-2024 V1.2.docx", "v1.2", "2024-03-15"), ("2024-02-31.txt", None, "2024-02-31"), ("19990101_20240102.txt", None, None)],
)
def test_facets(spark, name, version, date):
    assert one(spark, name, tx.detect_version) == version
    if date != "skip":
        assert one(spark, name, tx.detect_date) == date


def test_language_title_size(spark):
    assert [one(spark, n, tx.detect_language) for n in ("Service Agreement.pdf", "Kira Sözleşmesi.pdf", "Sozlesme Agreement.docx", "x.txt")] == ["EN", "TR", "TR/EN", "TR"]
    assert one(spark, "a_b__c.d.pdf", tx.generate_title) == "a b c.d"
    df = spark.createDataFrame([(500,), (2048,), (3_000_000,)], "x long")
    assert [r[0] for r in df.select(tx.size_label(F.col("x"))).collect()] == ["500 B", "2 KB", "2.9 MB"]


def test_places_count_code_points(spark):
    text = "😀 a@b.co x😀y c.d@e.org"
    got = one(spark, text, lambda c: matches(c, r"(?iuU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"))
    assert [(m["start"], m["end"], m["value"]) for m in got] == [(2, 8, "a@b.co"), (13, 22, "c.d@e.org")]
    assert all(text[m["start"] : m["end"]] == m["value"] for m in got)
    assert one(spark, "nothing", lambda c: matches(c, "x@y")) == []
    assert one(spark, None, lambda c: matches(c, "x@y")) is None


def test_places_of_groups(spark):
    got = one(spark, "TC Kimlik 10000000146, 10000000146", lambda c: matches(c, r"(?iuU)\b(?:TC Kimlik )?([1-9]\d{10})\b", 1))
    assert [(m["start"], m["value"]) for m in got] == [(10, "10000000146"), (23, "10000000146")]


def test_evidence_and_replacement(spark):
    df = spark.createDataFrame([("a" * 60 + "X\nY" + "b" * 60, 60, 63, "X Y", "[PERSON_1]", "CRITICAL", "Flag for human legal review")], "t string, s int, e int, v string, p string, r string, a string")
    row = df.select(tx.evidence_context(F.col("t"), F.col("s"), F.col("e"), F.col("v")).alias("c"), tx.replacement_for(F.col("p"), F.col("r"), F.col("a")).alias("p")).collect()[0]
    assert row["c"] == "a" * 48 + "X Y" + "b" * 48
    assert row["p"] == "[PERSON_1_REDACTED]"
