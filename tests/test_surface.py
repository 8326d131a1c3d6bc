from __future__ import annotations

import json

from pyspark.sql import functions as F

from docveil.functions import sql
from docveil.functions import text as tx
from docveil.functions.checks import valid_tckn, valid_vkn
from docveil.sources.labels import gold_labels, roster
from docveil.streaming.ingest import ingest


def test_sql_functions_agree_with_the_columns(spark):
    assert sql.register(spark) == ["contains_folded", "fold_diacritics", "tr_fold", "valid_tckn", "valid_vkn"]
    df = spark.createDataFrame([("10000000146",), ("12345678901",), ("1234567890",), ("1234567891",), ("IŞIK İlk",), ("",), (None,)], "x string")
    for r in df.selectExpr("x", "valid_tckn(x) t", "valid_vkn(x) v", "tr_fold(x) f", "fold_diacritics(x) d").select("*", valid_tckn(F.col("x")).alias("t2"), valid_vkn(F.col("x")).alias("v2"), tx.tr_fold(F.col("x")).alias("f2"), tx.search_fold(F.col("x")).alias("d2")).collect():
        assert (r["t"], r["v"], r["f"], r["d"]) == (r["t2"], r["v2"], r["f2"], r["d2"])


def test_label_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"note": "", "documents": [{"id": "a", "path": "a.txt", "labels": [{"category": "c", "text": "t"}, {"category": "d", "text": "u", "required": False}]}, {"id": "b", "labels": []}]}))
    assert [tuple(r) for r in gold_labels(spark, str(tmp_path / "g.json")).orderBy("n").collect()] == [("a", "a.txt", 0, "c", "t", True), ("a", "a.txt", 1, "d", "u", False)]
    (tmp_path / "r.json").write_text(json.dumps({"clients": [{"name": "A", "aliases": ["x", "y"]}, {"name": "B"}]}))
    assert [tuple(r) for r in roster(spark, str(tmp_path / "r.json")).orderBy("client_id", "alias").collect()] == [(1, "A", "x"), (1, "A", "y"), (2, "B", None)]
    assert roster(spark, str(tmp_path / "none.json")).count() == 0


def test_ingest_takes_a_path_once(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.txt").write_text("bir")
    assert ingest(spark, str(src), out, ck).awaitTermination(120)
    (src / "b.txt").write_text("iki")
    assert ingest(spark, str(src), out, ck).awaitTermination(120)
    assert ingest(spark, str(src), out, str(tmp_path / "other")).awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["bir", "iki"]


def test_mentions(spark):
    df = spark.createDataFrame([("Gizli SAĞLIK raporu",), (None,), ("x" * 5_000 + "gizli",)], "x string")
    got = df.select(tx.mentions(F.col("x"), ("gizli", "hasta")).alias("m"), tx.count_mentions(F.col("x"), ("gizli", "rapor", "hasta")).alias("n"), tx.explain(F.lit("party_role"), {"x": "y"}).alias("e")).collect()
    assert [tuple(r) for r in got] == [(True, 2, "Party Role"), (False, 0, "Party Role"), (False, 1, "Party Role")]


def test_rules_as_a_table_function(spark):
    from docveil.functions.sql import register_rules
    from docveil.operators.rules import RULES, Rule

    own = Rule("shelf_mark", r"\bRAF-\d+\b", "LOW", "Keep", "SHELF")
    assert register_rules(spark, (*RULES, own)) == "detect_spans"
    spark.createDataFrame([(1, "a@b.co RAF-12 Yargıtay"), (2, None)], "id int, text string").createOrReplaceTempView("texts_to_scan")
    got = {tuple(r) for r in spark.sql("SELECT t.id, d.category, d.start, d.`end`, d.value FROM texts_to_scan t, LATERAL detect_spans(t.text) d").collect()}
    assert {(1, "email_address", 0, 6, "a@b.co"), (1, "shelf_mark", 7, 13, "RAF-12")} <= got and all(r[0] == 1 for r in got)


def test_redacted_documents_compare_with_their_source(spark):
    from docveil.operators import quality
    from docveil.sources import documents as d
    from test_sources import W, docx, package

    data = docx(["Ayşe Kaya geldi"], ["gitti"], **{"word/media/x.png": "x", "word/embeddings/y.bin": "y"})
    broken = package({"word/document.xml": "<x", "word/header1.xml": f'<w:hdr xmlns:w="{W}"><w:p/></w:hdr>'})
    frame = lambda rows: spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    before, after = frame([("a", data), ("b", data), ("c", b"no zip")]), frame([("a", d.redact_docx(data, [("Ayşe Kaya", "[P]")])), ("b", broken)])
    got = {(r["path"], r["part"]): (r["status"], r["presence"], r["chars_delta"], r["paragraphs_delta"]) for r in quality.compared(before, after).collect()}
    assert got == {("a", "word/document.xml"): ("pass", "both", -6, 0), ("b", "word/document.xml"): ("fail", "both", -20, -2), ("b", "word/header1.xml"): ("warn", "added", 0, 1)}
    assert {tuple(r) for r in quality.unscanned(before).collect()} == {("a", "word/embeddings/y.bin"), ("b", "word/embeddings/y.bin")}


def test_tags_of_classes(spark):
    from docveil.operators.classify import RULES, TAGS, classify

    assert len(RULES) == len(TAGS)
    df = spark.createDataFrame([(1, "nda.pdf", ""), (2, "x", "zzz")], "id long, f string, t string")
    assert {r["id"]: r["tags"] for r in classify(df, "id", "f", "t", tags=True).collect()} == {1: ["NDA", "gizlilik"], 2: []}
