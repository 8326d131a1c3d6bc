from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from docveil.llm import canonical, lookalikes, mojibake, scans, truncated

PAGE = "src string, row_key string, text string"
CLEAN = ["Şirketin vergi numarası tutanağa geçirilmiştir ve çalışanlar görüşmüştür.", "Duruşmanın ertelenmesine, ödemenin yapılmasına karar verildi.", "The tenant shall keep the premises in good repair.", "Großer Schaden in der Straße, übliche Prüfung."] * 30


def stats_of(texts):
    import pyarrow as pa

    out = next(mojibake._pairs(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])]))).to_pydict()
    return mojibake.Statistics(np.array(out["pair"]), np.array(out["n"], float))


def repair(stats, text):
    return mojibake.repaired(mojibake.Reader(stats), [text]).get(0, (text, 0, 0))


def test_segments_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-4, 4, rng.integers(1, 30)).astype(np.float32)
        want, i = x > 0, 0
        while i < len(x):
            run, best, top, j = 0.0, 0.0, -1, i
            while j < len(x) and (run := run + float(x[j])) > 0:
                if run >= best:
                    best, top = run, j
                j += 1
            want[i : top + 1] = True
            i = j + 1
        assert (mojibake.segments(x) == want).all()


def test_natural_letters_need_the_corpus():
    stats = stats_of(CLEAN + ["Aurélie est venue, Aurélie a signé."] * 30 + ["AurÚlie"])
    assert repair(stats, "Mme AurÚlie")[0] == "Mme Aurélie"
    assert repair(stats, "Mme BerÚnice")[1:] == (0, 0)


def test_joined_letters_are_no_damage():
    stats = stats_of(CLEAN + ["tarafların iade yükümlülükleri, tarafların"] * 20)
    assert repair(stats, "taraﬂarın iade")[1:] == (0, 0)


def test_many_texts_at_once():
    stats = stats_of(CLEAN)
    texts = [*CLEAN[:4], "Ã§alÄ±ÅŸan", "", "x" * (mojibake.CHUNK + 5), "geÃ§irilmiÅŸtir " * 3]
    got = mojibake.repaired(mojibake.Reader(stats), texts)
    assert {i: r[0] for i, r in got.items()} == {4: "çalışan", 7: "geçirilmiştir " * 3}


def test_damage_is_undone():
    stats = stats_of(CLEAN)
    sound = "Şirketin çalışanlar görüşmüştür"
    for wrong in ("cp1252", "cp1254", "mac_roman", "cp437", "latin-1"):
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in sound.encode())
        assert repair(stats, bad)[0] == sound, wrong
    assert repair(stats, sound.encode("cp1254").decode("latin-1"))[1] > 0


def test_sound_texts_stay():
    stats = stats_of(CLEAN + ["Þingvellir ve Łódź limanı, 240 m² arsa, ½ pay, Kuzeyışık™, № 17, договор"] * 8)
    for t in ("Þingvellir ve Łódź limanı, 240 m² arsa, ½ pay, Kuzeyışık™, № 17, договор", *CLEAN[:4], "", "?"):
        assert repair(stats, t) == (t, 0, 0)


def test_lost_characters_count():
    stats = stats_of(CLEAN)
    assert repair(stats, "Bor�lu")[2] == 1
    assert repair(stats, "Sorular?n?z? yazabilir mi?")[2] == 1


def test_restore_edges(spark):
    df = spark.createDataFrame([("a", "1", None), ("a", "2", ""), ("a", "3", "Ã§alÄ±ÅŸan"), ("a", "3", "Ã§alÄ±ÅŸan"), *[("b", str(i), t) for i, t in enumerate(CLEAN)]], PAGE).withColumn("fixed", F.lit("clash")).withColumn("pair", F.lit(1))
    got = mojibake.restore(df).collect()
    assert [(r["src"], r["row_key"], r["restored"]) for r in got] == [("a", "3", "çalışan")]
    assert mojibake.restore(df.limit(0)).count() == 0


def brute(text):
    """Mapped character by character, then composed, letters of other scripts only among Latin ones."""
    import re

    m = lookalikes.mapping()
    out = []
    for token in re.findall(r"[^\W\d_]+|[\W\d_]", text):
        out.append("".join(m[ord(c)][0] if ord(c) in m and m[ord(c)][1] != "letter" else c for c in token))
    joined = "".join(out)

    def word(x):
        w = x[0]
        other = [c for c in w if c.isalpha() and ord(c) not in lookalikes.LETTERS and "LATIN" not in unicodedata.name(c, "")]
        return w if other else "".join(lookalikes.LETTERS.get(ord(c), c) for c in w)

    return unicodedata.normalize("NFC", re.sub(r"[^\W\d_]+", word, joined))


TEXTS = ["ｏｌａｃａｋｔıｒ．", "tes⁠pit", "ģöz̆", "Тic. Α.Ş.", "договор σύμβαση", "m² ½ № ™ ², düz", "a b　c", "taraﬂar", "x̣̂", "İ i̇ İ", "plain", "", "ẹ́", "́x", "Ｓｉｃｈеrhеit", "ab­cd", "\U0002F800 豈"]


def test_canonical_equals_brute_force(spark):
    df = spark.createDataFrame([("s", str(i), 0, t) for i, t in enumerate(TEXTS)] + [("s", "n", 0, None), ("s", "0", 0, TEXTS[0])], "src string, row_key string, label_no long, text string").withColumn("kind", F.lit("clash")).withColumn("ch", F.lit("x"))
    got = {r["row_key"]: r["canonical"] for r in canonical.canonical(df).collect()}
    want = {str(i): brute(t) for i, t in enumerate(TEXTS) if brute(t) != t}
    assert got == want
    assert canonical.canonical(df.limit(0)).count() == 0


def test_kinds(spark):
    df = spark.createDataFrame([("s", str(i), 0, t) for i, t in enumerate(TEXTS)], "src string, row_key string, label_no long, text string")
    kinds = {TEXTS[int(r["row_key"])]: r["kinds"] for r in canonical.canonical(df).collect()}
    assert kinds["Тic. Α.Ş."] == ["letter"] and kinds["taraﬂar"] == ["joined"] and kinds["tes⁠pit"] == ["invisible"] and "договор σύμβαση" not in kinds


def scanned(spark, pages):
    rows = [("ocr_pages", str(i), "1", i, t) for i, t in enumerate(pages, 1)]
    fill = [("ocr_pages", f"f{i}", f"d{i}", 1, "Mahkemece verilen karar ile taraflara tebliğ edilmiştir.\nÖn-inceleme duruşması yapılmıştır.") for i in range(80)]
    return spark.createDataFrame(rows + fill, "src string, row_key string, doc string, page long, text string")


def test_defects(spark):
    one = "DOSYA NO: 2020/5    GİZLİ\n\nMahkemece verilen karar ile taraf-\nlara tebliğ edilmiştir. Bu ön-\ninceleme duruşması yapılmış¬\ntır.\n- 1 -"
    two = "DOSYA NO: 2020/5    GİZLI\n\nMahkemece verilen korar ile tebliğ edilmiştir. Tutar 2O5 liradır.\n- 2 -"
    got = {(r["row_key"], r["line_no"], r["defect"]) for r in scans.defects(scanned(spark, [one, two, None, "", one])).collect() if not r["row_key"].startswith("f")}
    assert got == {
        ("1", 1, "header"), ("2", 1, "header"), ("5", 1, "header"), ("1", 3, "hyphen"), ("1", 5, "hyphen"), ("5", 3, "hyphen"), ("5", 5, "hyphen"),
        ("1", 7, "page_number"), ("2", 4, "page_number"), ("5", 7, "page_number"), ("2", 3, "misread"),
    }


def test_repaired_paragraphs(spark):
    page = "DOSYA NO: 2020/5    GİZLİ\n\nMahkemece verilen korar ile taraf-\nlara tebliğ edilmiştir.\n\n   Ön-inceleme duruşması\nyapılmıştır.\n- 1 -"
    got = {r["row_key"]: r["repaired"] for r in scans.repaired(scanned(spark, [page, page.replace("1 -", "2 -")])).collect()}
    assert got["1"] == got["2"] == "Mahkemece verilen karar ile taraflara tebliğ edilmiştir.\n\nÖn-inceleme duruşması yapılmıştır."


def test_anagram_hash_finds_what_brute_force_finds(spark):
    words = {"karar": 60, "korar": 1, "taraf": 50, "farat": 2, "dava": 40, "clava": 1, "duruşma": 30, "durumşa": 1, "ye": 90, "kalmak": 45, "kalrnak": 2, "yeni": 1}
    v = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r["word"], r["correction"]) for r in scans.misreadings(spark, v).collect()}
    want = set()
    for w, n in words.items():
        best = [(m, x) for x, m in words.items() for seen, meant in scans.CONFUSIONS for i in range(len(w)) if len(w) >= scans.SHORTEST and m >= scans.FREQUENT and m >= scans.RATIO * n and w[i : i + len(seen)] == seen and w[:i] + meant + w[i + len(seen) :] == x]
        if best:
            want.add((w, max(best)[1]))
    assert got == want == {("korar", "karar"), ("clava", "dava"), ("kalrnak", "kalmak")}


def test_truncated(spark):
    body = "Davacı Ayşe Kaya dilekçesinde kira ilişkisinin sona erdiğini beyan etmiştir. Mahkemece tarafların dinlenmesine karar verilmiştir."
    rows = [(i, "s", f"{body} {body}") for i in range(60)]
    rows += [(100, "s", f"{body} Davacı Ayşe Kaya dilekçesinde kira"), (101, "s", f"{body} Davacı Ayşe Kaya dilekçesinde kira iliş"), (102, None, f"{body} Mahkemece tarafların [...]"), (103, "s", None), (104, "s", " "), (100, "s", f"{body} Davacı Ayşe Kaya dilekçesinde kira")]
    rows += [(200 + i, "s", f"{body}\n\nEKLER: 1) Tutanak") for i in range(5)] + [(300 + i, "s", f"{body} Diğer talepler vb...") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("z", F.lit("x"))
    got = {r["doc_id"]: r["kind"] for r in truncated.truncated(df).collect()}
    assert got == {100: "sentence", 101: "word", 102: "omission"}
    assert truncated.truncated(df.limit(0)).count() == 0


def test_word_filter_keeps_all_that_may_match(spark):
    words = spark.createDataFrame([(i, f"w{i}") for i in range(3000)], "k long, word string")
    keep = words.where("k % 7 = 0").select("word", F.lit("x").alias("correction"))
    got = scans._filtered(words, keep, keep.count())
    assert got.columns == ["k", "word"]
    assert got.join(keep, "word").count() == keep.count() and got.count() < 500


def test_two_places_of_a_word_are_misread(spark):
    words = {"hakkında": 60, "hakklncla": 1, "olarak": 50, "oloralc": 2, "raised": 20, "roisecl": 1, "tarihinde": 40, "torihiride": 1, "anlaşılmıştır": 30, "arilaşılmışfır": 1, "papa": 90, "pqpz": 1, "bundle": 14, "biinclle": 1, "ilk": 900, "lik": 1}
    v = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r["word"], r["correction"]) for r in scans.misread_twice(spark, v, scans.misreadings(spark, v)).collect()}
    undone = lambda w, at=0: [(i + len(meant), w[:i] + meant + w[i + len(seen) :]) for seen, meant in scans.CONFUSIONS for i in range(at, len(w)) if w[i:].startswith(seen)]
    want = {(w, x) for w, n in words.items() if len(w) >= scans.TWICE_FROM for at, once in undone(w) for _, x in undone(once, at) if words.get(x, 0) >= scans.RATIO * n}
    assert got == want == {("hakklncla", "hakkında"), ("oloralc", "olarak"), ("roisecl", "raised"), ("torihiride", "tarihinde"), ("arilaşılmışfır", "anlaşılmıştır")}


def test_defects_of_words_misread_twice(spark):
    got = [(r["row_key"], r["word"], r["correction"]) for r in scans.defects(scanned(spark, ["Mahkemece verilen karar ile toroflara tebliğ edilmiştir."])).collect() if r["defect"] == "misread"]
    assert got == [("1", "toroflara", "taraflara")]


def test_rows_delivered_twice_count_once(spark):
    rows = [("ocr_pages", str(i), f"d{i}", 1, "Tarafların beyanları dinlenmiştir.") for i in range(20)]
    rows += [("ocr_pages", "x", "dx", 1, "Tanıkların beyanları dinlcnmiştir.")] * 2
    df = spark.createDataFrame(rows, "src string, row_key string, doc string, page long, text string")
    assert [(r["row_key"], r["word"], r["correction"]) for r in scans.defects(df).collect() if r["word"] == "dinlcnmiştir"] == [("x", "dinlcnmiştir", "dinlenmiştir")]


def test_both_ways_of_meeting_misread_words_agree(spark):
    page = "Mahkemece verilen korar ile taraflara tebliğ edilmiştir. Tutar 2O5 liradır, say1n tarafa."
    df = scanned(spark, [page, page.replace("korar", "toroflara")])
    rows = [sorted(map(tuple, scans.defects(df, n).select("row_key", "line_no", "defect", "word", "correction").collect()), key=repr) for n in (1000, 0)]
    assert rows[0] == rows[1] and len(rows[0]) >= 4


def test_shapes_of_misread_numbers_and_words(spark):
    words = {"2024": 900, "118": 600, "20": 500, "2o24": 2, "2o2o": 1, "l18": 1, "say1n": 1, "sayın": 300, "kerem": 300, "k3rem": 40, "12b": 4000, "x9": 1, "u123": 1}
    v = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r["shape"], r["number"]) for r in scans.shapes(v).collect()}
    assert {("9o99", True), ("9o9o", True), ("l99", True), ("aaa9a", False)} <= got
    assert not {("99b", True), ("x9", True), ("a999", True)} & got
    found = scans.misshapen(v.select("word"), scans.shapes(v)).where("correction is not null").collect()
    assert {("2o24", "2024"), ("2o2o", "2020"), ("l18", "118")} <= {tuple(r) for r in found}


def test_repair_keeps_the_case_and_joins_misread_words(spark):
    page = "Korar verildi. KORAR ve korar. Tutar 2O5 liradır, ko-\nrar edildi."
    got = {r["row_key"]: r["repaired"] for r in scans.repaired(scanned(spark, [page, "Karar 205 305 405 505 605", *["karar 205 306"] * 40])).collect()}
    assert got["1"] == "Karar verildi. KARAR ve karar. Tutar 205 liradır, karar edildi."


def test_long_words_are_corrected_too(spark):
    long_ = "gerekçelendirilemeyenlerden" * 2
    v = spark.createDataFrame([(long_, 60), (long_.replace("n", "ri", 1), 1)], "word string, n long")
    assert [r["correction"] for r in scans.misreadings(spark, v).collect()] == [long_]
