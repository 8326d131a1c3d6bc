from __future__ import annotations

import pytest

from docveil.operators.person_names import fold, names_in, person_names

GIVEN = frozenset(map(fold, ["Mehmet", "Ayşe", "Nisan", "Ali"]))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("İşbu sözleşme, Mehmet Yılmaz ile Ayşe Kaya arasında akdedilmiştir.", ["Mehmet Yılmaz", "Ayşe Kaya"]),
        ("Tanık Mehmet Ali Yılmaz dinlendi.", ["Mehmet Ali Yılmaz"]),
        ("İşbu protokol, Kerem Demir ile Selin Ak arasında yapılmıştır.", ["Kerem Demir", "Selin Ak"]),
        ("Hakim: Kerem Demir\nKatip: Selin Ak", ["Kerem Demir", "Selin Ak"]),
        ("Tanıklar:\n1) Kerem Demir\n2) Selin Ak, Can Er", ["Kerem Demir", "Selin Ak", "Can Er"]),
        ("Saygılarımla,\nKerem Demir\tSelin Ak", ["Kerem Demir"]),
        ("15 Nisan Yıldırım 2025", []),
        ("Nisan Yıldırım geldi", ["Nisan Yıldırım"]),
        ("Ayşe Kaya Limited Şirketi", []),
        ("Mehmet Mahkemesi", []),
        ("mehmet yılmaz", []),
        ("Bilirkisi: Kerem Demir\nZABIT KATİBİ: Selin Ak", ["Kerem Demir", "Selin Ak"]),
        ("Hazir bulunanlar: Kerem Demir; Selin Ak\n- Can Er", ["Kerem Demir", "Selin Ak", "Can Er"]),
        ("15 Agustos Ayse Kaya geldi, Mehmet Noterligi yok", ["Ayse Kaya"]),
        ("Kerem Demir Can ile Selin Ak arasinda", ["Kerem Demir Can", "Selin Ak"]),
        ("Ayşe Kaya aş ve Ayşe Kaya A.Ş. ile Ali Er Ltd. Şti.", ["Ayşe Kaya"]),
        ("Ali\tKaya\tMehmet\tEr", ["Ali\tKaya", "Mehmet\tEr"]),
        ("İmza\n(1) Kerem Demir\n" + "x" * 200 + "\nSelin Ak", ["Kerem Demir"]),
        ("", []),
    ],
)
def test_names(text, want):
    assert [text[a:b] for a, b in names_in(text, GIVEN)] == want


def test_frame(spark):
    df = spark.createDataFrame([(1, "Bay Ayşe  Kaya"), (2, None)], "id long, text string")
    assert [tuple(r) for r in person_names(df, "id", "text", ["AYŞE"]).collect()] == [(1, "Ayşe Kaya", 4, 14)]


def test_rare_given_names_are_joined(spark):
    from docveil.operators.person_names import given_names

    f = spark.createDataFrame([(f"{g} Kaya",) for g in ("Zülfü", "Oya", "Ece") for _ in range(3)] + [("Tek Kaya",)], "sample string")
    df = spark.createDataFrame([(1, "Dün ZÜLFÜ Er ve Zulfu Ak geldi"), (2, "Dün Oya Er geldi"), (3, "Dün Tek Er geldi"), (4, None)], "id long, text string")
    got = [{(r["doc_id"], r["value"]) for r in person_names(df, "id", "text", *given_names(f, "sample", limit=n)).collect()} for n in (10, 1)]
    assert got[0] == got[1] == {(1, "ZÜLFÜ Er"), (1, "Zulfu Ak"), (2, "Oya Er")}
    assert given_names(f, "sample", limit=1)[1] is not None and given_names(f.limit(0), "sample") == ([], None)
