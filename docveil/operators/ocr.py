"""Words of scanned pages and their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions.checks import unit

# Fixed value: signs taken off a word's ends before words are compared.
EDGES = r"^[.,;:!?()\[\]{}<>\"']+|[.,;:!?()\[\]{}<>\"']+$"


def tokens(pages: DataFrame, page: str, tsv: str, width: str, height: str) -> DataFrame:
    """Words of recogniser output (12 tab-separated columns, level 5 is a word): ``page, n, line, word, x0, y0, x1, y1,
    confidence``; boxes as shares of the page within 0..1, a negative confidence is unknown. Rows that do not parse are
    left out."""
    rows = pages.select(page, F.col(width).alias("w"), F.col(height).alias("h"), F.posexplode(F.split(tsv, r"\r?\n")).alias("n", "row")).where("n > 0").withColumn("c", F.split("row", "\t"))
    num = lambda i: F.get("c", F.lit(i)).try_cast("int")
    word = F.trim(F.get("c", F.lit(11)))
    conf = F.get("c", F.lit(10)).try_cast("double")
    good = (F.size("c") >= 12) & (num(0) == 5) & (word != "") & conf.isNotNull()
    for i in (2, 3, 4, 6, 7, 8, 9):
        good = good & num(i).isNotNull()
    return rows.where(good).select(
        page, "n", F.struct(num(2).alias("block"), num(3).alias("par"), num(4).alias("line")).alias("line"), word.alias("word"), unit(num(6) / F.col("w")).alias("x0"), unit(num(7) / F.col("h")).alias("y0"),
        unit((num(6) + num(8)) / F.col("w")).alias("x1"), unit((num(7) + num(9)) / F.col("h")).alias("y1"), F.when(conf >= 0, conf / 100).alias("confidence"),
    )


def text_of(words: DataFrame, page: str) -> DataFrame:
    """``page, text``: words of a line by blanks, lines in the order of block, paragraph and line."""
    lines = words.groupBy(page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), " ").alias("t"))
    return lines.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def regions(words: DataFrame, samples: DataFrame, page: str, sample_id: str, sample: str, pages: DataFrame | None = None, doc: str | None = None) -> DataFrame:
    """Boxes of each sample's occurrences on its page: ``page, sample_id, first, x0, y0, x1, y1, confidence``.

    The sample's words must follow each other on the page, edges aside. Samples belong to a page, or to a document
    (``doc``) of which ``pages`` (``page, doc``) are the pages. They are met on their first two words, or their only one;
    the rest is compared in the page's words, which are one row per page. Overlapping occurrences all count."""
    bare = lambda c: F.regexp_replace(c, EDGES, "")
    of = doc or page
    listed = words.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("n", bare(F.col("word")).alias("w"), "x0", "y0", "x1", "y1", "confidence"))).alias("ws")).withColumn("words", F.transform("ws", lambda x: x["w"]))
    s = samples.select(of, sample_id, F.filter(F.transform(F.split(F.trim(sample), r"(?U)\s+"), bare), lambda w: w != "").alias("sw")).where(F.size("sw") > 0)
    s = s.withColumn("met", F.array_join(F.slice("sw", 1, 2), "\u0001"))
    at = listed.select(page, F.posexplode("words").alias("at", "w"), "words").select(page, "at", F.explode(F.array_distinct(F.array(F.col("w"), F.concat_ws("\u0001", "w", F.get("words", F.col("at") + 1))))).alias("met"))
    at = at.join(pages.select(page, of), page) if doc else at
    hits = at.join(s, [of, "met"]).groupBy(page).agg(F.collect_list(F.struct("at", sample_id, "sw")).alias("hits"))
    same = lambda x: F.slice("words", x["at"] + 1, F.size(x["sw"])) == x["sw"]
    j = listed.join(hits, page).select(page, "ws", F.explode(F.filter("hits", same)).alias("x")).select(page, F.col(f"x.{sample_id}").alias(sample_id), F.col("x.at").alias("at"), F.slice("ws", F.col("x.at") + 1, F.size("x.sw")).alias("box"))
    part = lambda f, c: f(F.transform("box", lambda x: x[c]))
    return j.select(page, sample_id, F.col("at").alias("first"), part(F.array_min, "x0").alias("x0"), part(F.array_min, "y0").alias("y0"), part(F.array_max, "x1").alias("x1"), part(F.array_max, "y1").alias("y1"), part(F.array_min, "confidence").alias("confidence"))
