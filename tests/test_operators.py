from __future__ import annotations

from pyspark.sql import functions as F

from docveil.operators import ocr, redaction, sinks
from docveil.operators.attribution import attribute
from docveil.operators.classify import classify
from docveil.operators.scoring import scores
from docveil.operators.spans import enclosing, overlap_ids, subtract, trusted


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_subtract(spark):
    spans = spark.createDataFrame([(1, 10, 0, 20), (1, 11, 30, 35), (2, 12, 0, 5)], "d long, id long, start int, end int")
    cuts = spark.createDataFrame([(1, 5, 8), (1, 7, 10), (1, 20, 40), (2, 0, 5)], "d long, start int, end int")
    assert rows(subtract(spans, cuts, "d", "id")) == [(1, 10, 0, 5), (1, 10, 10, 20)]


def test_enclosing_is_strict_and_narrowest(spark):
    p = spark.createDataFrame([(1, 5), (1, 0)], "d long, x int")
    n = spark.createDataFrame([(1, 0, 20), (1, 2, 9), (1, 5, 8)], "d long, start int, end int")
    assert rows(enclosing(p, n, "d", "x")) == [(1, 0, None), (1, 5, 9)]


def test_overlap_ids(spark):
    s = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 9)], "d long, s long, start int, end int")
    f = spark.createDataFrame([(1, 0, 3, 20), (1, 4, 6, 3), (1, 9, 12, 7)], "d long, start int, end int, id long")
    assert rows(overlap_ids(s, f, "d", "s", "id")) == [(1, 1, "3,20"), (1, 2, "3")]


def test_trusted_places(spark):
    df = spark.createDataFrame([(1, "abc def abc", "abc", 8, 11), (2, "abc def", "def", 0, 3), (3, "abc", "zzz", 0, 3), (4, "abc", "c", None, None), (5, "abc", "", 0, 1)], "id long, text string, sample string, start_offset int, end_offset int")
    assert rows(trusted(df).select("id", "at", "until")) == [(1, 8, 11), (2, 4, 7), (4, 2, 3)]


def test_overlapping_targets_are_clipped(spark):
    t = spark.createDataFrame([(1, "Yuklenici ACIK KADIR YILMAZ imzaladi."), (2, "none"), (3, None)], "id long, text string")
    g = spark.createDataFrame([(1, 1, "AÇIK KADIR", "[MISC_1]"), (1, 2, "KADIR YILMAZ", "[PERSON_1]"), (1, 3, "", "[X]")], "id long, target long, needle string, replacement string")
    apart = redaction.regions(t, g, "id", "text")
    s = redaction.segments(t, apart, "id", "text").orderBy("id", "n").collect()
    assert "".join(r["shown"] for r in s if r["id"] == 1) == "Yuklenici [MISC_1][PERSON_1] imzaladi."
    assert "".join(r["source"] for r in s if r["id"] == 1) == "Yuklenici ACIK KADIR YILMAZ imzaladi."
    assert [r["shown"] for r in s if r["id"] == 2] == ["none"]


def test_regions_widen_to_words_and_quote_patterns(spark):
    t = spark.createDataFrame([(1, "ab+c xab+cy ab+c")], "id long, text string")
    g = spark.createDataFrame([(1, 1, "B+C", "#")], "id long, target long, needle string, replacement string")
    assert [(r["start"], r["end"]) for r in redaction.regions(t, g, "id", "text").orderBy("start").collect()] == [(0, 4), (5, 11), (12, 16)]


TSV = "level\tpage_num\n" + "\n".join("\t".join(map(str, r)) for r in [
    (5, 1, 1, 1, 1, 1, 10, 10, 40, 10, 95.0, "Ayşe"), (5, 1, 1, 1, 1, 2, 60, 10, 50, 10, -1, "Kaya,"), (4, 1, 1, 1, 2, 0, 0, 0, 0, 0, 9, "no"), (5, 1, 1, 1, 2, 1, 190, 20, 40, 10, 80, "geldi."), (5, 1, "x", 1, 2, 1, 1, 1, 1, 1, 1, "bad"),
]) + "\nshort\trow"


def test_recogniser_output(spark):
    pages = spark.createDataFrame([(1, TSV, 200, 100), (2, None, 1, 1)], "id long, tsv string, w int, h int")
    w = ocr.tokens(pages, "id", "tsv", "w", "h")
    assert [(r["word"], r["confidence"]) for r in w.orderBy("n").collect()] == [("Ayşe", 0.95), ("Kaya,", None), ("geldi.", 0.8)]
    assert rows(ocr.text_of(w, "id")) == [(1, "Ayşe Kaya,\ngeldi.")]
    assert w.where("word = 'geldi.'").select("x0", "x1").collect()[0] == (0.95, 1.0)
    s = spark.createDataFrame([(1, 7, "ayşe"), (1, 8, "(Ayşe  Kaya)"), (1, 9, "")], "id long, f long, sample string")
    (box,) = ocr.regions(w, s, "id", "f", "sample").collect()
    assert (box["f"], box["first"], box["x0"], box["x1"], box["confidence"]) == (8, 0, 0.05, 0.55, 0.95)


def test_scores(spark):
    labels = spark.createDataFrame([(1, "p", "a", "Ayşe Kaya"), (1, "p", "b", "Veli"), (1, "p", "c", "")], "d long, category string, label_id string, label string")
    found = spark.createDataFrame([(1, "p", "x", "AYŞE  KAYA geldi"), (1, "p", "y", "Zeki"), (2, "q", "z", "Veli")], "d long, category string, finding_id string, sample string")
    assert rows(scores(labels, found, "d")) == [("p", 3, 1, 2, 1, 0.3333, 0.5), ("q", 0, 0, 1, 0, 0.0, 0.0)]


def test_attribution_takes_the_least_client(spark):
    t = spark.createDataFrame([(1, "x ACME LOJİSTİK A.Ş. ve Beta Ltd"), (2, "nobody here"), (3, None), (4, "Beta Ltd")], "id long, t string")
    n = spark.createDataFrame([(9, "Acme Lojistik"), (4, "beta ltd"), (1, "Ab"), (2, None)], "client_id long, name string")
    for broadcast_rows in (100, 0):
        assert rows(attribute(t, n, "id", "t", broadcast_rows)) == [(1, 4), (4, 4)]
    assert rows(attribute(t, n.limit(0), "id", "t")) == rows(attribute(t.limit(0), n, "id", "t")) == []


def test_attribution_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab İI") for _ in range(rng.randrange(30))) for _ in range(60)]
    names = ["".join(rng.choice("ab İI") for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    low = lambda x: x.replace("İ", "i").replace("I", "ı").lower()
    want = {(i, min(hits)) for i, t in enumerate(texts) if (hits := [j for j, n in enumerate(names) if low(n).strip() and low(n).strip() in low(t)])}
    t, n = spark.createDataFrame(list(enumerate(texts)), "id long, t string"), spark.createDataFrame(list(enumerate(names)), "client_id long, name string")
    for broadcast_rows in (100, 0):
        assert {tuple(r) for r in attribute(t, n, "id", "t", broadcast_rows).collect()} == want


def test_classes_in_order(spark):
    df = spark.createDataFrame([(1, "x.pdf", "Şikayet ve mahkemesi"), (2, "nda.pdf", ""), (3, "a", "zzz"), (4, None, None)], "id long, f string, t string")
    assert rows(classify(df, "id", "f", "t")) == [(1, "litigation", "criminal_complaint"), (2, "intellectual_property", "nda"), (3, "other", "miscellaneous"), (4, "other", "miscellaneous")]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0), (3, "d", 0), (1, "z", 0)], "k long, v string, t int")
    assert rows(sinks.only_new(new, old, ["k"]).select("k")) == [(3,)]
    assert rows(sinks.upserted(old, new, ["k"], [F.col("t")]).select("k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "index")
    sinks.append_index(old, path, ["k"])
    sinks.append_index(new, path, ["k"], spark.read.parquet(path))
    assert rows(spark.read.parquet(path).select("k")) == [(1,), (2,), (3,)]


def test_attribution_by_alias_and_short_name(spark, tmp_path):
    from docveil.plans.review import attributed_pages

    texts = ["Ödeme Kartal Lojistik adına yapıldı.", "Ödeme ARÇ hesabına yapıldı.", "KÖY adına", "Beko ve Kartal Lojistik", "Zuhal Gıda geldi", "kimse yok", "", None, "o"]
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.parquet(f"{tmp_path}/ocr_pages.parquet")
    clients = [(1, "Uzun Adlı Anonim Şirketi", '["Kartal Lojistik", "", "Arç", null]'), (2, "Köy", None), (3, "Beko", ""), (4, "Başka Birisi", "Zuhal Gıda; Yok Olan"), (5, None, '["kimse"]'), (6, " ", "{}"), (7, "Ad Soyad", "null")]
    spark.createDataFrame(clients, "id long, name string, aliases string").write.parquet(f"{tmp_path}/clients.parquet")
    assert {tuple(r) for r in attributed_pages(spark, str(tmp_path)).select("id", "client_id").collect()} == {(0, 1), (1, 1), (2, 2), (3, 1), (4, 4), (5, 5)}


def brute_merge(rows):
    out = []
    for d in sorted({r[0] for r in rows}):
        own = []
        for s, e in sorted(r[1:3] for r in rows if r[0] == d):
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        out += [(d, s, e) for s, e in own]
    return out


def test_cells_change_nothing(spark):
    """Merging, clipping, meeting and subtracting equal brute force for cells of any size."""
    import random

    from docveil.operators.spans import clip, merge_spans, overlapping

    rng = random.Random(4)
    spans = [(rng.randrange(3), (s := rng.randrange(60)), s + rng.choice([1, 2, 7, 25]), i) for i in range(60)]
    a = spark.createDataFrame(spans, "d int, start int, end int, id int")
    b = a.select("d", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("id").alias("id2"))
    clipped = []
    for d in range(3):
        last = 0
        for _, s, e, i in sorted((x for x in spans if x[0] == d), key=lambda x: (x[1], -x[2], x[3])):
            if e > last:
                clipped.append((d, max(s, last), e, i))
                last = e
    for cell in (1, 5, 16, 8192):
        assert rows(merge_spans(a, ["d"], cell)) == sorted(brute_merge(spans), key=repr)
        assert rows(overlapping(a, b, ["d"], ("start", "end"), ("s2", "e2"), cell).select("id", "id2")) == sorted(((x[3], y[3]) for x in spans for y in spans if x[0] == y[0] and y[1] < x[2] and x[1] < y[2]), key=repr)
        assert rows(clip(a, ["d"], [F.col("start"), F.col("end").desc(), F.col("id")], cell)) == sorted(clipped, key=repr)


def test_one_document_with_very_many_findings(spark):
    from docveil.operators.detection import placeholders
    from docveil.operators.spans import clip, merge_spans, overlap_ids

    n = 100_000
    f = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 9).alias("end"), "id")
    assert [tuple(r) for r in merge_spans(f, ["doc_id"]).collect()] == [(1, 0, 7 * (n - 1) + 9)]
    assert clip(f, ["doc_id"], [F.col("start")]).agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).collect()[0] == (n, 7 * (n - 1) + 9)
    ids = overlap_ids(f.select("doc_id", F.col("id").alias("seg"), "start", "end"), f, "doc_id", "seg", "id")
    assert ids.count() == n and ids.where("seg = 5").collect()[0]["ids"] == "4,5,6"
    p = placeholders(spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("P").alias("prefix"), F.lit(0).alias("rule_ord"), F.col("id").cast("int").alias("match_ord"), F.concat(F.lit("v"), (F.col("id") % 50_000).cast("string")).alias("value")))
    got = p.agg(F.count_distinct("placeholder"), F.max(F.when(F.col("match_ord") == 77_777, F.col("placeholder")))).collect()[0]
    assert tuple(got) == (50_000, "[P_27778]")


def test_containment_equals_brute_force_however_large_a_group_is(spark):
    import random

    from docveil.operators.containment import held

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [(i, rng.choice([1, 2, None]), word(rng.randrange(40))) for i in range(50)] + [(99, 1, None)]
    needles = [(i, rng.choice([1, 2, None]), word(rng.choice([0, 1, 3, 9, 18]))) for i in range(80)] + [(99, 1, None)]
    want = {(i, j) for i, d, t in texts for j, e, n in needles if d == e is not None and t is not None and n and n in t}
    t, n = spark.createDataFrame(texts, "id int, d int, t string"), spark.createDataFrame(needles, "k int, d int, n string")
    for pairs, broadcast_rows in ((10**6, 10), (0, 1000), (0, 0), (600, 0)):
        assert {(r["id"], r["k"]) for r in held(t, "id", n, ["d"], broadcast_rows, pairs).collect()} == want
