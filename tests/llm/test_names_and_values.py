from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docveil.llm import names, personal


@given(st.lists(st.text("abç", min_size=1, max_size=6), max_size=30), st.text("abç", min_size=1, max_size=6))
def test_trie_equals_brute_force(words, q):
    words = sorted(set(words))
    assert sorted(names.Trie(words).neighbours(q)) == [w for w in words if names.near(w, q)]


def test_trie_join_equals_brute_force(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice(["ka", "zı", "mu", "ter", "sol"]) for _ in range(rng.randint(1, 4)))
    words = sorted({make() for _ in range(150)})

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    asked = sorted({typo(w) for w in words for _ in range(3)} | set(words))
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = {(r["q"], r["c"]) for r in names.trie_join(df(asked), df(words)).collect()}
    want = {(q, c) for q in asked for c in words if q == c or (len(c) > names.SHORTEST and len(q) >= names.SHORTEST and names.near(q, c))}
    assert got == want
    # However finely shards are split.
    assert {(r["q"], r["c"]) for r in names.trie_join(df(asked), df(words), shard=3).collect()} == want


CLIENTS = [
    (1, "Çağrı Gınkiröder", '["C. GINKIRODER"]'), (2, "Gınkiröder, Çağrı", None), (3, "Dr. CAGRI GINKIRDOER-SİYÇİGUBİY", "not json"), (4, "Ç. Gınkiröder", "[]"), (5, "Merve Gınkiröder", None), (5, "Merve Gınkiröder", None),
    (6, "Konmetöle Ambalaj A.Ş.", '["Yenibirad"]'), (7, "AMBALAJ KONMETÖLE AŞ", "null"), (8, "Konme töle Ambalaj Anonim Şirketi", ""), (9, "Konmetöle Otomotiv Ltd. Şti.", None), (10, "Konmetöle", None), (11, "Yenibirad", None), (12, None, None), (13, " ", None),
]
FINDINGS = [(100, "Çagri Ginkiröder", "natural_person_name"), (101, "M. Gınkiröder", "natural_person_name"), (102, "KONMETOLE AMB. A.S.", "company_name"), (103, None, "company_name"), (104, "Başka Birisi", "natural_person_name"), (105, "Çağrı GÄ±nkirÃ¶der", "natural_person_name"), (106, "Çağrı Gınkiröder", "address")]


def test_linked_records(spark):
    c = spark.createDataFrame(CLIENTS, "id long, name string, aliases string").withColumn("node", F.lit(1)).withColumn("kind", F.lit("x"))
    f = spark.createDataFrame(FINDINGS, "id long, sample string, category string").withColumn("word", F.lit("x"))
    groups: dict[int, set[int]] = {}
    for r in names.linked(c, f).collect():
        groups.setdefault(r["entity"], set()).add(r["rec"])
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[1, 2, 3, 4, 100, 105], [5, 101], [6, 7, 8, 11, 102]]
    assert names.linked(c.limit(0), f).count() == 0


def test_company_parts():
    assert names.company("Şenyörenu SAĞLIK HİZMETLERİ A.Ş.") == ("senyorenu", "saglik")
    assert names.company("Zuyzegepa Logistics Inc.") == ("zuyzegepa", "lojistik")
    assert names.person("Vazrureyok, Jennifer") == ["jennifer", "vazrureyok"]
    assert names.aliases_of('["a", 1, null]') == ["a"] and names.aliases_of("a; b") == ["a", "b"] and names.aliases_of("{}") == []


GIVEN = ["Ayşe", "Mehmet", "Leyla", "Zeynep", "Robert", "İbrahim"]


def spans(text):
    plain = personal.Plain(text)
    return [(text[plain.stored(a) : plain.stored(b)], k) for a, b, k in personal.Finder(GIVEN).spans(plain.text)]


def test_values_and_their_places():
    assert spans("Müvekkil Ayşe Kaya (TCKN: 963 055 196 82), Papatya Mah. 1745. Sk. No: 114 D: 16 Samsun, ayse-k @ ornek.example, ((0521) 925 9839)") == [
        ("Ayşe Kaya", "natural_person_name"), ("963 055 196 82", "identity_number"), ("Papatya Mah. 1745. Sk. No: 114 D: 16 Samsun", "address"), ("ayse-k @ ornek.example", "email_address"), ("(0521) 925 9839", "phone_number"),
    ]
    assert [k for _, k in spans("Name: R. Smithson - Address: Unit 4, 104B Ashgrove Ave., Manchester - Phone: +44 7700 900356")] == ["natural_person_name", "address", "phone_number"]
    assert spans("Les lettres envoyées au 20 avenue des Tilleuls, 43860 Nantes")[0] == ("20 avenue des Tilleuls, 43860 Nantes", "address")
    assert spans("Der Zeuge wohnt in Brückenauer Straße 79.")[0] == ("Brückenauer Straße 79", "address")
    assert spans("Le lettere spedite a Viale del Mulino Vecchio n. 157 sono tornate")[0] == ("Viale del Mulino Vecchio n. 157", "address")


def test_no_values():
    for t in ("Leyla Mobilya A.Ş. ile Zeynep Sultan Gıda Ltd. Şti. arasında", "Evrak takip no 93736134665 ile kayda alınan", "Şirketin vergi numarası 9742975616 olup", "TR00 4686 1318 7181 6905 3877 80 numaralı hesaba", "Esas No: 2013/8463", "410.955,00 TL", "", "Yazılımın 5.32.118.4 sürümünde"):
        assert spans(t) == [], t


def test_damaged_and_broken_values():
    assert spans("Tanık Meh-\nmet Yıl-\nmaz dinlendi")[0][0] == "Meh-\nmet Yıl-\nmaz"
    assert spans("Tanık A​yşe Кaya dinlendi")[0][0] == "A​yşe Кaya"
    assert spans("Tanık Ä°brahim KÃ¶se dinlendi")[0] == ("Ä°brahim KÃ¶se", "natural_person_name")


def test_redacted_keeps_the_rest(spark):
    df = spark.createDataFrame([("p", "1", None, "Tanık Ayşe Kaya ve Mehmet Can geldi, Ayşe Kaya gitti."), ("p", "2", None, None), ("p", "3", None, ""), ("q", "4", "natural_person_name", "[PERSON_Ayşe Kaya]"), ("p", "5", None, "x " * 50_000 + "a@b.example")], "src string, row_key string, category string, text string").withColumn("kinds", F.lit("x"))
    got = {r["row_key"]: r for r in personal.personal(df, GIVEN).collect()}
    assert got["1"]["redacted"] == "Tanık [PERSON_1] ve [PERSON_2] geldi, [PERSON_1] gitti."
    assert (got["4"]["kinds"], got["4"]["starts"]) == (["natural_person_name"], [8])
    assert got["5"]["starts"] == [100_000] and set(got) == {"1", "4", "5"}
    assert personal.personal(df.limit(0), GIVEN).count() == 0


def test_trie_join_meets_words_swapped_anywhere(spark):
    words = ["PDemir", "Pabcde", "CBrisa", "PDogruk"]
    asked = [w[:i] + w[i : i + 2][::-1] + w[i + 2 :] for w in words for i in range(len(w) - 1)]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = {(r["q"], r["c"]) for r in names.trie_join(df(asked), df(words)).collect()}
    assert got == {(q, c) for q in asked for c in words if names.near(q, c)}


def test_common_ends_are_split(spark):
    """A third of all words with one ending: no walk gets more than its share."""
    words = [f"P{a}{b}oğlu" for a in "abcdefghij" for b in "klmnoprstu"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r["q"], r["c"]) for r in names.trie_join(df, df, shard=7).collect()}
    assert got == {(q, c) for q in words for c in words if names.near(q, c)}


def test_given_names_and_either_order(spark):
    n = {"mehmet": 400, "mehmte": 2, "ayse": 300, "ayze": 1, "ali": 200, "veli": 190, "sukru": 90, "suko": 2, "can": 50}
    got = {(r["ga"], r["gb"]) for r in names.given_pairs(spark.createDataFrame(list(n.items()), "given string, n long")).collect() if r["ga"] < r["gb"]}
    assert got == {("mehmet", "mehmte"), ("ayse", "ayze"), ("suko", "sukru")}
    c = [(1, "Rukiye Tozkoparan", None), (2, "Tozkoparan Rukiye", None), (3, "Rukiye Su Bahçıvanlar", None), (4, "Bahçıvanlar Rukiye Su", None), (5, "A B C D E F G H I J Kestanecioğlu", None), (6, "A B C D E F G H I J Kestanecioglu", None)]
    e = {r["rec"]: r["entity"] for r in names.linked(spark.createDataFrame(c, "id long, name string, aliases string"), spark.createDataFrame([], "id long, sample string, category string")).collect()}
    assert e[1] == e[2] != e[3] == e[4] and len({e[1], e[3]}) == 2


def test_short_surnames_are_linked(spark):
    c = [(1, "Ayşe Demir", None), (2, "Ayşe Dmeir", None), (3, "Mehmet Kaya", None), (4, "Mehmet Kyaa", None), (5, "Mehmet Kara", None)]
    f = [(100 + i, f"Mehmet {s}", "natural_person_name") for i, s in enumerate(["Kaya"] * 25 + ["Kara"] * 25)]
    got = names.linked(spark.createDataFrame(c, "id long, name string, aliases string"), spark.createDataFrame(f, "id long, sample string, category string")).where("client").collect()
    e = {r["rec"]: r["entity"] for r in got}
    assert e[1] == e[2] and e[3] == e[4] and len({e[1], e[3], e[5]}) == 3


def test_values_outside_the_test_tables():
    assert spans("Witness Siobhan Okafor was heard; call (415) 555-2671 or write to " + "a" * 90 + "@host.example") == [("Siobhan Okafor", "natural_person_name"), ("(415) 555-2671", "phone_number"), ("a" * 90 + "@host.example", "email_address")]
    assert spans("SANIK Rukiye Tekin, Telefon 312 555 04 05.")[-1] == ("312 555 04 05", "phone_number")
    assert spans("Er wohnt in 20 Jahren in der Lindenallee 12, 10115 Berlin.")[0] == ("Lindenallee 12, 10115 Berlin", "address")
    assert spans("He lives at " + "x" * 300 + " 12 Long Acre Road, and Kaya, Ayşe at 7 Mill Lane.") == [("12 Long Acre Road", "address"), ("Kaya, Ayşe", "natural_person_name"), ("7 Mill Lane", "address")]
    assert spans("Ayşe Su Ela Can Deniz Yaz Kaya geldi")[0][0] == "Ayşe Su Ela Can Deniz Yaz Kaya"
    for t in ("Order 66 of the day", "WITNESS STATEMENT\n   This power", "Chapter 3 (4) of 12", "Road works"):
        assert spans(t) == [], t


def test_leaked_placeholders():
    value = lambda raw, kind: (x := personal.leaked(raw, kind)) and raw[x[0] : x[1]]
    for raw in ("[PERSON]", "[PERSON_12", "(PERSON_3)", "[person_1]", "", "[PERSON_", "[", "PERSON PERSON"):
        assert value(raw, "natural_person_name") is None, raw
    assert value("[PERSON: Y._Kaya]", "natural_person_name") == "Y._Kaya" and value("PERSON Ayşe Kaya", "natural_person_name") == "Ayşe Kaya"
    assert value("[PHONE_+90 230 248 65 57]", "phone_number") == "+90 230 248 65 57" and value("[PHONE_12]", "phone_number") is None
    assert value("[NATIONAL_ID: 98096131760]", "identity_number") == "98096131760" and value("x [at] y.example", "email_address") == "x [at] y.example"
    assert value("[ADDRESS: Gül Sokak No: 9]", "address") == "Gül Sokak No: 9" and value("[ADDRESS_3]", "address") is None


def test_rare_given_names_are_found_by_the_join(spark):
    f = spark.createDataFrame([(f"{g} {s}", "natural_person_name") for g in ("Ayşe", "Zülfü", "Oya") for s in ("Kaya", "Demir")] + [("Tek Kaya", "natural_person_name")] + [("Kaya Can", "natural_person_name")] * 2, "sample string, category string")
    names_ = personal.given_names(f)
    assert {r["given"] for r in names_.collect()} == {"Ayşe", "Zülfü", "Oya"}
    t = spark.createDataFrame([("p", "1", None, "Dün ZÜLFÜ Er ile Zulfu Ak geldi."), ("p", "2", None, "Dün Oya Er geldi."), ("p", "3", None, "Dün yağmur yağdı."), ("p", "4", None, None)], "src string, row_key string, category string, text string")
    got = [{(r["row_key"], tuple(r["starts"])) for r in personal.personal(t, *personal.split_names(names_, limit)).collect()} for limit in (10, 1)]
    assert got[0] == got[1] == {("1", (4, 17)), ("2", (4,))}
    assert personal.split_names(names_, 1)[1] is not None and personal.split_names(names_.limit(0)) == ([], None)


def test_many_values_in_one_text():
    t = " ".join(f"u{i}@host.example" for i in range(20_000))
    assert len(personal.Finder([]).spans(t)) == 20_000
