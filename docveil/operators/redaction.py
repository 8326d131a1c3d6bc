"""Targets to regions to segments: what a redacted text consists of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions.text import search_fold
from docveil.operators.spans import clip


def regions(texts: DataFrame, targets: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, start, end, replacement, target``: places of the targets (``doc, target, needle, replacement``), apart.

    A target is found whatever its case and diacritics, at every place where it does not overlap itself, and widened to
    the words it begins and ends in. Wider regions come first, then wider matches, then the earlier target; what a
    region covers is cut off the next."""
    j = texts.select(doc, F.col(text).alias("t"), search_fold(F.col(text)).alias("hay")).join(targets, doc).withColumn("n", search_fold(F.col("needle"))).where("n <> '' and contains(hay, n)")
    parts = j.withColumn("gaps", F.expr("split(hay, concat('\\\\Q', replace(n, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), -1)"))
    places = parts.select(doc, "t", "target", "replacement", F.length("n").alias("size"), F.posexplode(F.expr("transform(slice(gaps, 1, size(gaps) - 1), (g, i) -> aggregate(slice(gaps, 1, i + 1), 0, (a, x) -> a + length(x)) + i * length(n))")).alias("_", "s"))
    left = F.length(F.regexp_extract(F.left("t", F.col("s")), r"(?U)\w*$", 0))
    right = F.length(F.regexp_extract(F.substr("t", F.col("s") + F.col("size") + 1), r"(?U)^\w*", 0))
    r = places.select(doc, "target", "replacement", "size", (F.col("s") - left).alias("start"), (F.col("s") + F.col("size") + right).alias("end"))
    return clip(r, [doc], [F.col("start"), (F.col("start") - F.col("end")), F.col("size").desc(), F.col("target")]).select(doc, "start", "end", "replacement", "target")


def segments(texts: DataFrame, apart: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, n, kind, source, shown``: the text cut at its regions, plain and redacted in turn; sources put together
    are the text."""
    rows = apart.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("r"))
    j = texts.where(F.col(text).isNotNull()).select(doc, F.col(text).alias("t")).join(rows, doc, "left").withColumn("r", F.coalesce("r", F.expr("cast(array() as array<struct<start:int,end:int,replacement:string>>)")))
    piece = F.expr(
        "flatten(transform(r, (x, i) -> array(struct('text' AS kind, substring(t, IF(i = 0, 0, r[i - 1].end) + 1, x.start - IF(i = 0, 0, r[i - 1].end)) AS source, string(null) AS shown), "
        "struct('redacted' AS kind, substring(t, x.start + 1, x.end - x.start) AS source, x.replacement AS shown))))"
    )
    tail = F.expr("array(struct('text' AS kind, substring(t, IF(size(r) = 0, 0, element_at(r, -1).end) + 1) AS source, string(null) AS shown))")
    out = j.select(doc, F.posexplode(F.filter(F.concat(piece, tail), lambda x: x["source"] != "")).alias("n", "x"))
    return out.select(doc, "n", "x.kind", "x.source", F.coalesce("x.shown", "x.source").alias("shown"))
