"""Worked cases of the detection rules, as queries: texts, and the findings they must give.

The findings of a case are stated by hand, in the order of the text; a query's SQL lists them as values, so that a rule
that looks for the wrong thing does not agree with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.operators import spans as sp
from docveil.operators.detection import all_findings, cut_identifiers, findings
from docveil.operators.person_names import GIVEN, person_names

#: By rule: category, and the cases: a text, and the matches in it as they stand.
RULES = {
    "email": ("email_address", (("Yazın: ayse.kaya@example.com.tr, b@x", ("ayse.kaya@example.com.tr",)), ("A_B+1@X-Y.ORG geldi", ("A_B+1@X-Y.ORG",)), ("a@b ve @c.com", ()))),
    "phone": ("phone_number", (("Tel 0532 123 45 67 ya da +90 212 555 04 05", ("0532 123 45 67", "+90 212 555 04 05")), ("no: 5321234567.", (" 5321234567",)), ("Barkod 95321234567 ve 05321234567890", ()), ("312-555-04-05", ("312-555-04-05",)))),
    "national_id": ("turkish_national_id", (("TC Kimlik No: 10000000146 ve 12345678901", ("10000000146",)), ("Kimlik 01000000014, 100000001460", ()))),
    "iban": ("iban", (("IBAN TR33 0006 1005 1978 6457 8413 26 hesabı", ("TR33 0006 1005 1978 6457 8413 26",)), ("tr330006100519786457841326", ("tr330006100519786457841326",)), ("TR33 0006 1005", ()))),
    "tax_number": ("tax_number", (("VKN: 1234567890 ve vergi no 1234567891", ("VKN: 1234567890",)), ("1234567890", ()))),
    "mersis": ("mersis_number", (("MERSİS No: 0123456789012345 kaydı", ("MERSİS No: 0123456789012345", "0123456789012345")), ("mersis 123456789012345", ()))),
    "bar_number": ("bar_registration_number", (("Baro sicil 12345 ve sicil numarası 884411", ("Baro sicil 12345", "sicil numarası 884411")), ("sicil 12", ()))),
    "passport": ("passport_number", (("Pasaport no: U1234567 ile passport number AB123456", ("Pasaport no: U1234567", "passport number AB123456")), ("U1234567", ()))),
    "account": ("account_number", (("hesap no: 1234-5678901 ve hesap numarası 12", ("hesap no: 1234-5678901",)),)),
    "handle": ("social_media_handle", (("@zbozkurt yazdı, a@b.co ve x.@y", ("@zbozkurt",)), ("(@iki_2)", ("@iki_2",)))),
    "plate": ("vehicle_plate", (("plakası: 34 ABC 123 olan ve 06 AB 1234 plakalı araç", ("plakası: 34 ABC 123", "06 AB 1234 plakalı")), ("34 ABC 123 kaydı", ()))),
    "case_number": ("case_or_investigation_number", (("Esas no: 2024/118 ve Karar 2023 / 45-K", ("Esas no: 2024/118", "Karar 2023 / 45-K")), ("2024/118", ()))),
    "address": ("address", (("Adres Gül Sokak No: 5 D. 3 Kadıköy. Sonra", ("Adres Gül Sokak No: 5 D",)), ("Bağdat Caddesi 5. kat\nson", ("Bağdat Caddesi 5. kat",)), ("Kadıköy İstanbul", ()))),
    "address_start": ("address", (("hasta Gül Sok. 5 adresinde", ("Gül Sok",)), ("gizli Gül Sokak 7", ("Gül Sokak 7",)))),
    "date": ("date", (("12.03.2024 ile 2024-3-1 ve 1/2/24", ("12.03.2024", "2024-3-1", "1/2/24")), ("12.03", ()))),
    "money": ("money_amount", (("1.250,00 TL ve USD 300, 5 dolar", ("1.250,00 TL", "USD 300,", "5 dolar")), ("300", ()))),
    "health": ("health_data", (("hasta iyileşti. Yeni cümle", ("hasta iyileşti",)), ("tedavi 22.09.2025 günü T.C. sınırında Ltd. Şti. bitti. son", ("tedavi 22.09.2025 günü T.C. sınırında Ltd. Şti. bitti",)), ("hastalık a. bendi", ()))),
    "criminal": ("criminal_allegation", (("Şüpheli kaçtı\nkaldı", ("Şüpheli kaçtı",)), ("SORUŞTURMA vb. sürdü. bitti", ("SORUŞTURMA vb. sürdü",)))),
    "privileged": ("privileged_or_confidential", (("Gizli belge Av. Can Er sundu. son", ("Gizli belge Av. Can Er sundu",)), ("attorney-client note", ("attorney-client note",)))),
    "party_role": ("party_role", (("Davacı ve DAVALI geldi; davacılar yok", ("Davacı", "DAVALI")),)),
    "court_suffix": ("court_or_authority", (("Kadıköy Cumhuriyet Başsavcılığı'na gönderildi. son", ("Cumhuriyet Başsavcılığı'na gönderildi",)), ("UYAP kaydı", ("UYAP kaydı",)))),
    "court_numbered": ("court_or_authority", (("İstanbul 11. Aile Mahkemesi Sayın Hakimliğine sunulur.", ("11. Aile Mahkemesi",)),)),
    "notary": ("court_or_authority", (("Beyoğlu 24. Noterliği'nde düzenlendi.", ("24. Noterliği",)),)),
    "high_court": ("court_or_authority", (("Yargıtay kararı. son", ("Yargıtay kararı",)),)),
    "court_resume": ("court_or_authority", (("İstanbul Anadolu 4. Asliye Ceza Mahkemesi kararı Kadıköy Cumhuriyet Başsavcılığı'na gitti", ("4. Asliye Ceza Mahkemesi", "Cumhuriyet Başsavcılığı'na gitti")),)),
    "company": ("company_name", (("Alacaklı: Kartal Lojistik Limited Şirketi ile MERKEZ İNŞAAT LİMİTED ŞİRKETİ", ("Kartal Lojistik Limited Şirketi", "MERKEZ İNŞAAT LİMİTED ŞİRKETİ")), ("Belediye aş dağıttı", ()), ("Deniz Nakliyat A.Ş. borçludur", ("Deniz Nakliyat A.Ş.",)))),
    "titled_person": ("natural_person_name", (("Av. Mehmet Ali Yılmaz geldi", ("Mehmet Ali Yılmaz",)), ("Sayın Gül Sokak No: 5", ()), ("Dr. Ada Su\nBaro", ("Ada Su",)))),
    "role_person": ("natural_person_name", (("tanık Ayşe Kaya dinlendi", ("Ayşe Kaya",)), ("Davalı Kartal Lojistik Limited Şirketi", ()), ("şüpheli olan Can Er kaçtı", ("Can Er",)))),
}
#: Names without a title or role.
NAMES = {
    "given_name": (("Dün Ayşe Kaya geldi", ("Ayşe Kaya",)), ("dün ayşe kaya geldi", ())),
    "labelled_name": (("Hakim: Bergüzar Taş\nKatip: Tülin Ak", ("Bergüzar Taş", "Tülin Ak")), ("Bilirkisi - Bergüzar Taş", ("Bergüzar Taş",))),
    "between_names": (("Protokol, Bergüzar Taş ile Tülin Ak arasında yapıldı", ("Bergüzar Taş", "Tülin Ak")), ("Bergüzar Taş ile Tülin Ak yapıldı", ())),
    "listed_names": (("Tanıklar:\n1) Bergüzar Taş\n- Tülin Ak, Ökkeş Er", ("Bergüzar Taş", "Tülin Ak", "Ökkeş Er")), ("Saygılarımla,\nBergüzar Taş", ("Bergüzar Taş",))),
    "longest_name": (("Ayşe Su Kaya Demir geldi", ("Ayşe Su Kaya",)),),
    "best_run": (("Ayşe Mahkemesi Kaya Demir geldi", ("Kaya Demir",)), ("Ali Kaya\tAyşe Er", ("Ali Kaya", "Ayşe Er")), ("15 Nisan Yıldırım 2025", ()), ("Nisan Yıldırım geldi", ("Nisan Yıldırım",))),
    "rejected_names": (("Ayşe Kaya Limited Şirketi", ()), ("Mehmet Caddesi", ()), ("Ayşe geldi", ()), ("Ayşe Kaya ile Ayşe Er Ltd. Şti.", ("Ayşe Kaya",))),
    "apart_names": (("Mehmet Ali Yılmaz", ("Mehmet Ali Yılmaz",)),),
}
#: Sensitive clauses without the identifiers in them: pieces of the clause, in order.
CUTS = (
    ("hasta Gül Sok. 5 adresinde ikamet etmektedir", "health_data", ("hasta", "5 adresinde ikamet etmektedir")),
    ("hasta Ayşe Kaya (TCKN: 10000000146) kanser", "health_data", ("hasta", ") kanser")),
    ("hasta Ayşe Kaya", "health_data", ("hasta",)),
)


def _frame(spark: SparkSession, texts) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "case_id int, text string").coalesce(1)


def _rule(name: str):
    category, cases = RULES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = findings(_frame(spark, [t for t, _ in cases]), "case_id", "text").where(F.col("category") == category)
        return f.select(F.col("doc_id").alias("case_id"), "category", F.col("sample").alias("value"), F.col("start").alias("start_at"), F.col("end").alias("end_at"))

    return query


def _name(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = person_names(_frame(spark, [t for t, _ in NAMES[name]]), "case_id", "text", list(GIVEN))
        return f.select(F.col("doc_id").alias("case_id"), F.lit("natural_person_name").alias("category"), "value", F.col("start").alias("start_at"), F.col("end").alias("end_at"))

    return query


def cut_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cut_identifiers(all_findings(_frame(spark, [t for t, *_ in CUTS]), "case_id", "text", list(GIVEN)))
    f = sp.dedupe(f, "doc_id", [F.col("rule_ord"), F.col("match_ord")]).where("category = 'health_data'")
    return f.select(F.col("doc_id").alias("case_id"), "category", F.col("value"), F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def _values(rows: list[tuple[int, str, str, str, int]]) -> str:
    """``rows``: case, text, category, match as it stands, and the place from which it is sought."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    listed = [f"({i}, {q(c)}, {q(m.strip())}, {(a := t.index(m, at))}, {a + len(m)})" for i, t, c, m, at in rows]
    return f"SELECT CAST(case_id AS INT) AS case_id, category, value, CAST(start_at AS INT) AS start_at, CAST(end_at AS INT) AS end_at FROM (VALUES {', '.join(listed)}) AS v(case_id, category, value, start_at, end_at)"


def _in_order(cases, category: str) -> list[tuple[int, str, str, str, int]]:
    out = []
    for i, (text, found) in enumerate(cases):
        at = 0
        for m in found:
            out.append((i, text, category, m, at))
            at = text.index(m, at) + 1
    return out


def queries():
    return {f"case_{n}": _rule(n) for n in RULES} | {f"case_{n}": _name(n) for n in NAMES} | {"case_identifier_cuts": cut_cases}


def oracle_sql():
    rules = {f"case_{n}": _values(_in_order(cases, category)) for n, (category, cases) in RULES.items()}
    names = {f"case_{n}": _values(_in_order(cases, "natural_person_name")) for n, cases in NAMES.items()}
    return rules | names | {"case_identifier_cuts": _values([(i, t, c, m, 0) for i, (t, c, ms) in enumerate(CUTS) for m in ms])}
