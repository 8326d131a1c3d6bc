from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docveil.operators.detection import cut_identifiers, findings, placeholders
from docveil.operators.spans import clip, dedupe, render


def found(spark, text, cut=True):
    f = findings(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    f = cut_identifiers(f) if cut else f
    return sorted((r["category"], r["sample"], r["start"], r["end"]) for r in f.collect())


def samples(spark, text, category):
    return [s for c, s, *_ in found(spark, text) if c == category]


@pytest.mark.parametrize(
    ("text", "category", "want"),
    [
        ("Müşteki @zbozkurt hesabından şikayet etti.", "social_media_handle", ["@zbozkurt"]),
        ("Mail ayse@example.com adresi", "social_media_handle", []),
        ("34 ABC 123 numaralı referans kaydı", "vehicle_plate", []),
        ("plakası: 34 ABC 123 olan araç", "vehicle_plate", ["plakası: 34 ABC 123"]),
        ("Kimlik 10000000146 ve 12345678901", "turkish_national_id", ["10000000146"]),
        ("VKN: 1234567890", "tax_number", ["VKN: 1234567890"]),
        ("VKN: 1234567891", "tax_number", []),
        ("hesap no: 1234-5678901", "account_number", ["hesap no: 1234-5678901"]),
        ("sicil numarası 884411", "bar_registration_number", ["sicil numarası 884411"]),
        ("Beyoğlu 24. Noterliği'nde düzenlenmiştir.", "court_or_authority", ["24. Noterliği"]),
        ("İstanbul 11. Aile Mahkemesi Sayın Hakimliğine sunulmuştur.", "court_or_authority", ["11. Aile Mahkemesi"]),
        ("Tutar 1.250,00 TL olup", "money_amount", ["1.250,00 TL"]),
        ("Esas no: 2024/118 dosya", "case_or_investigation_number", ["Esas no: 2024/118"]),
    ],
)
def test_rules(spark, text, category, want):
    assert samples(spark, text, category) == want


def test_companies(spark):
    got = samples(spark, "Alacaklı: Kartal Lojistik Limited Şirketi ile MERKEZ İNŞAAT LİMİTED ŞİRKETİ anlaşmıştır.", "company_name")
    assert got == ["Kartal Lojistik Limited Şirketi", "MERKEZ İNŞAAT LİMİTED ŞİRKETİ"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Av. Mehmet Ali Yılmaz geldi", ["Mehmet Ali Yılmaz"]), ("tanık Ayşe Kaya dinlendi", ["Ayşe Kaya"]), ("Davalı Kartal Lojistik Limited Şirketi", []), ("Sayın Gül Sokak No: 5", []), ("davacı gelmedi", [])],
)
def test_people(spark, text, want):
    assert samples(spark, text, "natural_person_name") == want


def test_second_authority_is_found_after_a_named_court(spark):
    got = samples(spark, "İstanbul Anadolu 4. Asliye Ceza Mahkemesi kararı Kadıköy Cumhuriyet Başsavcılığı'na gönderilmiştir", "court_or_authority")
    assert "4. Asliye Ceza Mahkemesi" in got
    assert any("Cumhuriyet Başsavcılığı" in s for s in got)


def test_clause_is_cut_at_the_address(spark):
    got = found(spark, "hasta Gül Sok. 5 adresinde ikamet etmektedir")
    assert ("address", "Gül Sok", 6, 13) in got
    assert [g for g in got if g[0] == "health_data"] == [("health_data", "5 adresinde ikamet etmektedir", 15, 44), ("health_data", "hasta", 0, 5)]


def test_offsets_frame_samples(spark):
    text = "Davacı Ayşe Kaya, TCKN 10000000146, ayse@example.com; 12.03.2024 günü 500 TL ödedi. Av. Mehmet Ali Yılmaz"
    for _, s, a, b in found(spark, text, cut=False):
        assert s == text[a:b].strip()[:180]


def test_numbering_by_first_appearance(spark):
    f = placeholders(findings(spark.createDataFrame([(1, "b@x.org a@x.org B@X.org")], "id long, text string"), "id", "text"))
    got = {(r["start"], r["placeholder"]) for r in f.collect()}
    assert got == {(0, "[EMAIL_1]"), (8, "[EMAIL_2]"), (16, "[EMAIL_1]")}


def test_null_empty_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000 + "a@b.co")], "id long, text string")
    assert [(r["doc_id"], r["start"]) for r in findings(df, "id", "text").collect()] == [(3, 200_000)]
    assert findings(df.limit(0), "id", "text").count() == 0


def test_clip_keeps_what_is_not_covered(spark):
    f = spark.createDataFrame([(1, 0, 10, "A"), (1, 5, 15, "B"), (1, 12, 14, "C"), (1, 15, 18, "D")], "d long, start int, end int, r string")
    c = clip(f, ["d"], [F.col("start"), F.col("end").desc()])
    assert sorted((r["start"], r["end"], r["r"]) for r in c.collect()) == [(0, 10, "A"), (10, 15, "B"), (15, 18, "D")]
    t = spark.createDataFrame([(1, "0123456789abcdefghXYZ"), (2, "kept")], "d long, t string")
    assert {r["d"]: r["rendered"] for r in render(t, c, "d", "t", "r").collect()} == {1: "ABDXYZ", 2: "kept"}


def test_dedupe(spark):
    f = spark.createDataFrame([(1, "c", 0, 5, "f", 2), (1, "c", 0, 5, "f", 1), (1, "c", 0, 6, "f", 3)], "d long, category string, start int, end int, fingerprint string, n int")
    assert sorted(r["n"] for r in dedupe(f, "d", [F.col("n")]).collect()) == [1, 3]


def test_names_without_title_or_role(spark, tmp_path):
    from docveil.plans.detection import detect_all, redacted_previews

    text = "Sözleşme, Zehra Sena Kırçitülen tarafından imzalandı. Sayın Kerem Demir geldi.\nKatip: Selin Ak\nKerem Demir ile Oya Er arasında"
    spark.createDataFrame([(1, text), (2, None)], "id long, text string").write.parquet(f"{tmp_path}/ocr_pages.parquet")
    spark.createDataFrame([], "category string, sample string").write.parquet(f"{tmp_path}/privacy_findings.parquet")
    found = [r for r in detect_all(spark, str(tmp_path)).collect() if r["category"] == "natural_person_name"]
    want = {"Zehra Sena Kırçitülen": "[PERSON_2]", "Kerem Demir": "[PERSON_1]", "Selin Ak": "[PERSON_3]", "Oya Er": "[PERSON_4]"}
    assert {(r["sample"], r["placeholder"]) for r in found} == set(want.items())
    assert len(found) == len({(r["start"], r["end"]) for r in found}) and all(text[r["start"] : r["end"]] == r["sample"] for r in found)
    rendered = {r["doc_id"]: r["rendered"] for r in redacted_previews(spark, str(tmp_path)).collect()}
    assert set(rendered) == {1} and not any(name in rendered[1] for name in want)
