from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docveil.llm import language, mixing, packing

SAMPLE = {
    "tr": ["Mahkemece tarafların dinlenmesine ve dosyanın incelenmesine karar verilmiştir.", "Davacı kira bedelinin ödenmediğini ileri sürmüştür.", "Taşınmazın yüzölçümü keşif sırasında tespit edilmiştir."],
    "en": ["The tribunal found that the letters did not amount to a variation of the contract.", "Either party may terminate this agreement upon written notice.", "The tenant shall keep the premises in good repair."],
    "de": ["Der Kläger verlangt Schadensersatz wegen verspäteter Lieferung der Geräte.", "Die Beklagte bestreitet, dass die Lieferung vollständig erfolgt sei.", "Bei Fragen zur Akte genügt eine Nachricht an die Kanzlei."],
    "fr": ["Le présent contrat peut être résilié moyennant un préavis de trois mois.", "Les lettres envoyées au locataire ont été retournées le lendemain.", "La société soutient que la livraison était conforme au contrat."],
    "it": ["Il conduttore deve restituire i locali in buono stato alla scadenza.", "La relazione tiene conto di tutte le fatture scambiate tra gli interessati.", "Ogni comunicazione dovrà essere inviata per posta elettronica."],
}


def test_sentences():
    text = "DAVA DİLEKÇESİ\n\nTanık Av. Ayşe Kaya duruşmada bunu ifade etti. Ödeme 7. ayda ya-\npılmıştır ve dosya kapan-\nmıştır.\n- 1 -\nRiservato - Bozza 727"
    assert language.sentences(text) == ["Tanık Av. Ayşe Kaya duruşmada bunu ifade etti.", "Ödeme 7. ayda yapılmıştır ve dosya kapanmıştır."]
    assert language.sentences("") == [] and language.sentences("Sayfa 1") == []


def test_gradients():
    net = language.ByteNetwork(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, _ = language.windows(["Mahkemece karar", "The tribunal found"])
    y = np.array([0, 1])
    g = net._gradients(x, y)
    loss = lambda: -np.log(np.exp(z := net.features(x) @ net.p["out"] + net.p["bias"]) / np.exp(z).sum(1, keepdims=True))[np.arange(2), y].mean()
    for k in ("out", "w3", "b4", "embed"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-5
        up = loss()
        net.p[k][i] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[k][i]) < 1e-4 + 1e-2 * abs(g[k][i])
        net.p[k][i] = old


def test_held_out_accuracy():
    """Trained on pages of which some carry the wrong label; tested on sentences not seen."""
    import itertools

    rng = np.random.default_rng(2)
    words = {k: sorted({w for s in v for w in s.rstrip(".").split()}) for k, v in SAMPLE.items()}
    make = lambda k: " ".join(rng.choice(words[k], 9)).capitalize() + "."
    pages = [(k if rng.random() > 0.1 else "tr", " ".join(make(k) for _ in range(6))) for k in itertools.islice(itertools.cycle(SAMPLE), 400)]
    net = language.fit(pages)
    test = [(i, s) for i, k in enumerate(language.LANGUAGES) for s in SAMPLE[k]]
    got = language.sentence_scores(net, [s for _, s in test])
    right = got.argmax(1) == [i for i, _ in test]
    assert right.mean() >= 0.9
    sure = net.confidence(got)
    assert np.allclose(sure.sum(1), 1) and net.temperature in language.TEMPERATURES


@given(st.lists(st.lists(st.floats(-9, 0), min_size=3, max_size=3), min_size=2, max_size=7))
@settings(deadline=None)
def test_decoding_equals_brute_force(rows):
    import itertools

    lp = np.array(rows)

    def value(path):
        runs = [len(list(g)) for _, g in itertools.groupby(path)]
        return -np.inf if min(runs) < 2 else sum(lp[i, k] for i, k in enumerate(path)) - 3.0 * (len(runs) - 1)

    best = max(value(p) for p in itertools.product(range(3), repeat=len(lp)))
    assert abs(value(tuple(language.decode(lp, 3.0))) - best) < 1e-9


@given(st.lists(st.lists(st.floats(-9, 0), min_size=3, max_size=3), min_size=1, max_size=6))
@settings(deadline=None)
def test_decoding_with_single_sentences_equals_brute_force(rows):
    import itertools

    lp = np.array(rows)
    value = lambda path: sum(lp[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    best = max(value(p) for p in itertools.product(range(3), repeat=len(lp)))
    assert abs(value(tuple(language.decode(lp, 2.0, alone=True))) - best) < 1e-9


def test_masked():
    assert language.masked("Anwesend waren Dieter Sengimeruy, Şıla Kaya und Björn Çelik.") == "Anwesend waren , und"
    assert language.masked("Ayşe Kaya.") == "Ayşe Kaya."


def test_segments(spark):
    net = language.ByteNetwork()
    df = spark.createDataFrame([("p", "1", None), ("p", "2", " "), ("p", "3", "Tek bir cümle var burada yalnız.")], "src string, row_key string, text string").withColumn("lang", F.lit("x"))
    assert language.segments(df, net).count() == 0
    got = {r["row_key"]: r for r in language.languages(df.union(spark.createDataFrame([("p", "4", "12 / 34", "x"), ("p", "5", "Sayın", "x")], df.schema)), net).collect()}
    assert set(got) == {"3", "4", "5"} and (got["4"]["lang"], got["4"]["confidence"]) == (None, 0.0) and 0 < got["5"]["confidence"] < 1


@given(st.lists(st.integers(1, 99), min_size=1, max_size=40))
def test_packing_is_whole(sizes):
    windows = packing.pack(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= 100 for w in windows)


def test_differencing_levels_windows():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 500, 200).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 8)]
    assert len(sums) == 8 and max(sums) - min(sums) <= 5
    assert len(packing.pack(sizes, 4096)) <= -(-sum(sizes) // 4096) + 1


def docs(spark):
    rows = [(i, f"s{i % 3}", "kira sözleşmesi " * (1 + i * 7 % 90)) for i in range(300)] + [(900, "s0", None), (901, None, "x"), (902, "s1", ""), (903, "s1", "uzun metin " * 900), (1, "s1", "kira")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash")).withColumn("window", F.lit(0))


def test_packed(spark):
    caps = spark.createDataFrame([("small", 128), ("large", 1024), ("none", 0), (None, 5)], "container string, capacity_tokens int")
    p = packing.packed(docs(spark), caps).toPandas()
    used = p.groupby(["container", "shard", "window"])["tokens"].sum()
    assert used.groupby("container").max().to_dict() == {"large": 1024, "small": 128}
    whole = p.groupby("container")["tokens"].sum()
    assert whole["small"] == whole["large"] > 0
    long_ = p[(p.doc_id == 903) & (p.container == "large")].sort_values("piece")
    assert long_["first_token"].tolist() == [1024 * i for i in range(len(long_))] and (long_["tokens"][:-1] == 1024).all()
    assert (p[p.doc_id == 13].groupby("container").size() == 1).all() and not p.doc_id.isin([900, 902]).any()
    fill = used.sum() / (used.groupby("container").size() * used.index.get_level_values(0).unique().map({"large": 1024, "small": 128})).sum()
    assert fill > 0.7
    assert packing.packed(docs(spark).limit(0), caps).count() == 0


def test_rows_of_one_id_have_windows_of_their_own(spark):
    df = spark.createDataFrame([(1, "uzun metin " * 900)] * 3 + [(2, "kira")] * 2, "doc_id long, text string")
    p = packing.packed(df, spark.createDataFrame([("c", 64)], "container string, capacity_tokens int")).toPandas()
    assert p.groupby(["shard", "window"])["tokens"].sum().max() <= 64
    assert p[p.doc_id == 1].groupby("piece").size().eq(3).all() and (p.doc_id == 2).sum() == 2


def test_shards_are_bounded_by_items_too(spark):
    df = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("a").alias("text"))
    p = packing.packed(df, spark.createDataFrame([("c", 10_000)], "container string, capacity_tokens int"), items=50).toPandas()
    assert len(p) == 500 and 5 < p.shard.nunique() <= 10 and p.groupby("shard").size().max() < 150


def test_mixed(spark):
    targets = spark.createDataFrame([("s0", 0.5, 4), ("s1", 0.3, 2), ("s2", 0.2, 1), ("absent", 0.4, 1), (None, 0.1, 1), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixed(docs(spark), targets, block=512)
    s = {r["source"]: r for r in mixing.shares(m, targets.where("target_share is not null and source is not null")).collect()}
    for k, share, most in (("s0", 0.5, 4), ("s1", 0.3, 2), ("s2", 0.2, 1)):
        assert abs(s[k]["actual_share"] - share) < 0.04 and 1 <= s[k]["most_repeats"] <= most
    assert s["absent"]["uses"] == 0
    assert m.groupBy("doc_id", "source", "pass").count().where("count > 1 and doc_id <> 1").count() == 0
    assert mixing.mixed(docs(spark).limit(0), targets).count() == 0


def test_schedule_follows_the_weights(spark):
    w = [("a", 0.5), ("b", 0.3), ("c", 0.2)]
    rows = mixing.schedule(spark, 20_000, w).toPandas()
    assert sorted(rows.slot) == list(range(20_000))
    for src, share in w:
        own = rows[rows.source == src].sort_values("slot")
        assert own.turn.tolist() == list(range(len(own)))
        for upto in (100, 1000, 20_000):
            assert abs((own.slot < upto).sum() - share * upto) < 6


def test_points_keep_their_digits(spark):
    """As fractions of whole-number products, also far out."""
    for n in (1, 10**6, 10**12 + 7):
        got = spark.range(n - 1, n).selectExpr(f"CAST((CAST(id + 1 AS DECIMAL(18, 0)) * CAST({mixing.GOLDEN} AS DECIMAL(20, 0))) % CAST({mixing.UNIT} AS DECIMAL(20, 0)) AS DOUBLE) / {float(mixing.UNIT)!r}D").collect()[0][0]
        assert abs(got - n * mixing.GOLDEN % mixing.UNIT / mixing.UNIT) < 1e-15
