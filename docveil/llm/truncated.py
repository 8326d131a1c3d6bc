"""Text cut off by field limits (problem 10).

Word trigrams are counted over all texts, and those that end a text apart. A trigram met often inside texts and almost
never at an end marks the text it ends as cut. A last word that is only the beginning of words following the same two
words marks a cut within the word. All of it is SQL; nothing but trigrams and their counts is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.operators.lineage import checkpointed
from docveil.sources.tables import table

#: A trigram is frequent from this many occurrences inside texts; one that closes a sentence needs more, since most
#: sentences end inside a text too.
FREQUENT, FREQUENT_STOP = 12, 150
#: It is almost never terminal when, besides the text at hand, it ends at most this share of its occurrences.
TERMINAL, TERMINAL_STOP = 0.02, 0.002
#: Fixed value: what ends a sentence.
STOP = r"[.!?][\"'”»)\]]*$"
#: Next to nothing: an end unseen inside texts, or rarely seen for chance, is one seen at most at this share of what
#: stands in its place. As a share it means the same at every size of the corpus.
UNSEEN = 0.001
#: Longer words seen in the place of a last word that is their beginning must occur this often.
CONTINUED = 3
#: Classes of words; what is keyed by them alone is a large share of all texts, and spread over so many keys.
CLASSES, SPREAD = ("", "N", "9", "E"), 64
#: Ends of at least one in so many texts are common: so many of them there are at most.
COMMON = 1000
#: Marks put where something was left out; the last is left by a cut within a character's bytes.
OMISSION = r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…|�)\s*$"
#: Capitalised words within a sentence: names, mostly. One that ends in a point stays as it is. The pattern begins with
#: the blank before the word, so that nothing is tried elsewhere.
NAME = r" (?<=[^.!?:\s⏎]⏎? )(?:\p{Lu}\. )?\p{Lu}[\p{L}\p{M}'’-]*+(?!\.)"


def words(text: Column) -> Column:
    """Words of a text: digits as 9, names and other capitals within a sentence as N; a line end stays on the word
    before it."""
    t = F.replace(text, F.lit("\n"), F.lit("⏎ "))
    t = F.regexp_replace(t, r"\d+", "9")
    t = F.regexp_replace(t, NAME, " N")
    return F.split(t, " ")


def _address(word: str) -> Column:
    return F.when(F.col(word).contains("@"), "E").otherwise(F.col(word)).alias(word)


def stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \n\r\t"))


def _tail(text: Column) -> Column:
    """The last words: those of a final mark, three more, and one that their form depends on, with some to spare."""
    return F.substring_index(stripped(text), " ", -16)


def _end(tail: Column) -> Column:
    """The last three words before a mark of omission."""
    return F.slice(F.concat(F.array(F.lit(""), F.lit("")), words(stripped(F.regexp_replace(tail, OMISSION, "")))), -3, 3)


def trigrams(docs: DataFrame) -> DataFrame:
    """``a, b, c, n``: every trigram of all texts and how often it occurs. Two empty words stand before each text."""
    w = docs.select(words(stripped(F.col("text"))).alias("w"))
    rows = w.select(F.inline(F.arrays_zip(F.concat(F.array(F.lit(""), F.lit("")), F.col("w")).alias("a"), F.concat(F.array(F.lit("")), F.col("w")).alias("b"), F.col("w").alias("c"))))
    return rows.toDF("a", "b", "c").where("c is not null").select(*map(_address, "abc")).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def _goes_on(word: Column, prefix: Column) -> Column:
    """The word goes on after the prefix with a letter or digit, not just with punctuation."""
    return F.substr(word, F.length(prefix) + 1).rlike(r"^[.,/@_-]?[\p{L}\p{N}]")


def _beginnings(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, z, longer``: how often words that go on after ``z`` stand in its place. Words are exploded to their
    beginnings, so that last words are met by equality."""
    cut = df.select(*keys, "c", "n", F.explode(F.expr("transform(sequence(1, length(c)), i -> left(c, i))")).alias("z"))
    return cut.where(_goes_on(F.col("c"), F.col("z"))).groupBy(*keys, "z").agg(F.sum("n").alias("longer"))


def _looked_up(ends: DataFrame, counts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``ends`` with the ``counts`` of their keys. Keys of classes alone are few and common: their counts are copied to
    ``SPREAD`` keys, and the ends spread over these."""
    hot = F.lit(True)
    for k in keys:
        hot = hot & F.col(k).isin(*CLASSES)
    left = ends.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*ends.columns), F.lit(SPREAD))).otherwise(F.lit(0).cast("long")))
    right = counts.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def truncated(docs: DataFrame) -> DataFrame:
    """Texts of ``doc_id, source, text`` that were cut off before their end.

    Columns out: ``doc_id, source, kind ('omission' | 'word' | 'sentence')``. Null and blank texts are not cut. Equal
    texts under several ids are judged alike and count as one end; a doc_id given twice comes out once. A mark of
    omission alone is no cut: what stands before it must not be a proper end.
    """
    docs = docs.where("trim(text) <> ''").select("doc_id", "source", "text")
    tail = _tail(F.col("text"))
    last = docs.select("doc_id", "source", tail.alias("tail"), F.xxhash64("text").alias("whole")).select(
        "doc_id", "source", F.col("tail").rlike(OMISSION).alias("omitted"), F.col("tail").rlike("�$").alias("bytes"), _end(F.col("tail")).alias("e"), "whole",
        F.regexp_replace(F.regexp_extract(stripped(F.regexp_replace("tail", OMISSION, "")), r"(\S*)$", 1), r"\d+", "9").alias("raw"),
    )
    last = checkpointed(last.select("doc_id", "source", "omitted", "bytes", "whole", "raw", *(F.col("e")[i].alias(c) for i, c in enumerate("abz"))).withColumn("z", F.when(F.col("z").contains("@"), "E").otherwise(F.col("z"))))
    all_ = checkpointed(trigrams(docs))
    # Ends are counted once per text; in texts with a mark, the words before it are not the last ones counted.
    ended = lambda *keys: last.groupBy(*keys).agg(F.count_distinct("whole").alias("terminal"), F.count("*").alias("texts"), F.count_if(~F.col("omitted")).alias("bare"))
    ends = ended("a", "b", "z")
    three = ends.join(all_.withColumnRenamed("c", "z"), ["a", "b", "z"], "left").select("a", "b", "z", "terminal", "texts", (F.coalesce("n", F.lit(0)) - F.col("bare")).alias("inside3"))
    two = ended("a", "b").join(all_.groupBy("a", "b").agg(F.sum("n").alias("n")), ["a", "b"], "left").select("a", "b", F.col("terminal").alias("terminal_ab"), (F.coalesce("n", F.lit(0)) - F.col("bare")).alias("inside_ab"))
    after = ended("b", "z").join(all_.groupBy("b", F.col("c").alias("z")).agg(F.sum("n").alias("n")), ["b", "z"], "left").select("b", "z", (F.coalesce("n", F.lit(0)) - F.col("bare")).alias("inside_bz"))
    before = ended("b").join(all_.groupBy("b").agg(F.sum("n").alias("n")), "b", "left").select("b", F.col("terminal").alias("terminal_b"), (F.coalesce("n", F.lit(0)) - F.col("bare")).alias("inside_b"))
    vocabulary = all_.groupBy("c").agg(F.sum("n").alias("n"))
    one = ended("z").join(vocabulary.withColumnRenamed("c", "z"), "z", "left").select("z", F.col("terminal").alias("terminal1"), F.col("texts").alias("texts1"), (F.coalesce("n", F.lit(0)) - F.col("bare")).alias("inside1"))
    # Longer words in the last one's place: after the same two words, and anywhere.
    raw = last.where(~F.col("raw").rlike(STOP)).select("a", "b", "raw").distinct()
    longer3 = _beginnings(all_.join(raw.select("a", "b").distinct(), ["a", "b"], "left_semi"), ["a", "b"]).join(raw.withColumnRenamed("raw", "z"), ["a", "b", "z"], "left_semi").select("a", "b", F.col("z").alias("raw"), F.col("longer").alias("longer3"))
    longer1 = _beginnings(vocabulary, []).join(last.select("z").distinct(), "z", "left_semi").select("z", F.col("longer").alias("longer1"))

    rare = lambda t, inside, share: F.col(t) - 1 <= share * F.col(inside)
    unseen = lambda n, instead: F.col(n) <= UNSEEN * F.col(instead)
    stop, plain = F.col("z").rlike(STOP), ~F.col("z").isin("N", "9", "E")
    few = lambda instead: F.col("terminal") <= F.greatest(F.lit(2), UNSEEN * F.col(instead))
    letter = F.col("z").rlike(r"[\p{L}\p{N}]")
    sentence = (
        ((F.col("inside3") >= FREQUENT) & ~stop & rare("terminal", "inside3", TERMINAL))
        | ((F.col("inside3") >= FREQUENT_STOP) & stop & rare("terminal", "inside3", TERMINAL_STOP))
        # Too rare a trigram, and no end that recurs: judged by the last word itself,
        | ((F.col("inside3") < FREQUENT) & (F.col("terminal") <= 2) & ~stop & plain & (F.col("inside1") >= 4 * FREQUENT) & rare("terminal1", "inside1", TERMINAL))
        # by the two words before it, after which it never stands and texts do not end,
        | (unseen("inside3", "inside_ab") & few("inside_ab") & ~stop & (F.col("inside_ab") >= 2 * FREQUENT) & (F.col("terminal_ab") <= TERMINAL * F.col("inside_ab")) & letter)
        # or by the one before it.
        | (unseen("inside3", "inside_b") & unseen("inside_bz", "inside_b") & few("inside_b") & ~stop & ~F.col("b").isin("", "N", "9") & (F.col("inside_b") >= 8 * FREQUENT) & (F.col("terminal_b") <= TERMINAL * F.col("inside_b")) & letter)
    )
    word = ~stop & (
        ((F.col("longer3") >= CONTINUED) & (F.col("longer3") > 4 * F.col("inside3")) & (F.col("terminal") <= 0.1 * F.col("longer3") + 1))
        | (plain & unseen("inside3", "longer1") & few("longer1") & (F.col("longer1") >= 4 * CONTINUED) & (F.col("longer1") > 20 * F.col("inside1")))
    )
    proper = ~stop & (((F.col("texts") > 2) & (F.col("inside3") <= TERMINAL * F.col("texts"))) | ((F.col("texts1") > 2) & (F.col("inside1") <= TERMINAL * F.col("texts1"))))
    yes = lambda c: F.coalesce(c, F.lit(False))
    # Ends are judged once each, however many texts have them.
    keys = ["a", "b", "z", "raw"]
    own = last.groupBy(*keys).agg(F.count("*").alias("rows"))
    judged = _looked_up(_looked_up(own, three, ["a", "b", "z"]), two, ["a", "b"])
    judged = _looked_up(_looked_up(_looked_up(judged, after, ["b", "z"]), before, ["b"]), one, ["z"])
    judged = judged.join(longer3, ["a", "b", "raw"], "left").join(longer1, "z", "left")
    judged = judged.withColumns({"longer3": F.coalesce("longer3", F.lit(0)), "longer1": F.coalesce("longer1", F.lit(0))})
    judged = judged.select(*keys, "rows", yes(word).alias("word"), yes(sentence).alias("sentence"), yes(proper).alias("proper"), F.coalesce(stop, F.lit(False)).alias("stop"))
    omission = F.col("omitted") & ~F.col("proper") & (F.col("word") | F.col("sentence") | ~F.col("stop"))
    kind = F.when(F.col("bytes"), "omission").when(omission, "omission").when(F.col("word"), "word").when(F.col("sentence"), "sentence")
    # Ends of many texts are few and go to where the texts are; only texts with other ends are shuffled.
    judged = checkpointed(judged)
    texts = last.count()
    common = judged.where(F.col("rows") >= max(2.0, texts / COMMON)).drop("rows")
    here = last.join(F.broadcast(common), keys, "left")
    there = here.where("word is null").select(*last.columns).join(judged.drop("rows"), keys)
    cols = ["doc_id", "source", kind.alias("kind")]
    return here.where("word is not null").select(*cols).union(there.select(*cols)).where("kind is not null").dropDuplicates(["doc_id"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = truncated(docs).groupBy("source").agg(F.count("*").alias("cut"))
    total = docs.groupBy("source").agg(F.count("*").alias("texts"))
    return total.join(cut, total["source"].eqNullSafe(cut["source"]), "left").select(total["source"], "texts", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("texts"), 6).alias("rate"))


def queries():
    return {"p10_found": p10_found, "p10_rates": p10_rates}


def oracle_sql():
    return {}
