"""Algebra of spans: half-open offsets within a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


#: Offsets of one cell. Spans meet, and are put in order, within cells, so that a document with a tenth of all spans is
#: the work of as many tasks as it has cells; only what touches a cell's edge, or sums up a cell, is seen per document.
CELL = 8192


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are the same, nulls included."""
    own = right.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)))
    return left.join(own, same).drop(*(f"_r{i}" for i in range(len(keys))))


def _cells(start: str, end: str, cell: int) -> Column:
    """The cells a span touches; an empty span is in the cell it stands in."""
    return F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / cell)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], of_left: tuple[str, str], of_right: tuple[str, str], cell: int = CELL) -> DataFrame:
    """Pairs of rows of equal keys whose spans overlap, each once; columns must have different names, keys aside."""
    (a, b), (c, d) = of_left, of_right
    j = left.withColumn("_cell", _cells(a, b, cell)).join(right.withColumn("_cell", _cells(c, d, cell)), [*keys, "_cell"])
    # A pair that meets in several cells counts in the one in which it begins to overlap.
    return j.where((F.col(c) < F.col(b)) & (F.col(a) < F.col(d)) & (F.col("_cell") == F.floor(F.greatest(a, c) / cell))).drop("_cell")


def merge_spans(df: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """``keys, start, end``: overlapping and touching spans of each key joined."""
    base = df.where("end > start").select(*keys, F.col("start").cast("long"), F.col("end").cast("long"))
    parts = base.withColumn("_cell", _cells("start", "end", cell)).select(*keys, "_cell", F.greatest(F.col("start"), F.col("_cell") * cell).alias("start"), F.least(F.col("end"), (F.col("_cell") + 1) * cell).alias("end"))

    def joined(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start", "end")
        before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")

    islands = joined(parts, [*keys, "_cell"])
    edge = (F.col("start") == F.col("_cell") * cell) | (F.col("end") == (F.col("_cell") + 1) * cell)
    cols = [*keys, "start", "end"]
    kinds = dict(df.dtypes)
    out = islands.where(~edge).select(*cols).unionByName(joined(islands.where(edge).select(*cols), keys).select(*cols))
    return out.select(*keys, F.col("start").cast(kinds["start"]), F.col("end").cast(kinds["end"]))


def subtract(spans: DataFrame, cuts: DataFrame, key: str, span_id: str) -> DataFrame:
    """What is left of each span without the cuts of the same key: ``key, span_id, start, end``, empty pieces left out."""
    own = cuts.select(key, F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    hit = overlapping(spans.select(key, span_id, F.col("start").alias("s"), F.col("end").alias("e")), own, [key], ("s", "e"), ("c_start", "c_end")).select(key, span_id, "s", "e", F.greatest("c_start", "s").alias("start"), F.least("c_end", "e").alias("end"))
    merged = merge_spans(hit, [key, span_id, "s", "e"])
    w = Window.partitionBy(key, span_id).orderBy("start")
    gaps = merged.select(key, span_id, F.coalesce(F.lag("end").over(w), "s").alias("start0"), F.col("start").alias("end0"))
    tail = merged.groupBy(key, span_id).agg(F.max("end").alias("start0"), F.max("e").alias("end0"))
    whole = spans.join(hit.select(key, span_id).distinct(), [key, span_id], "left_anti").select(key, span_id, F.col("start").alias("start0"), F.col("end").alias("end0"))
    return gaps.union(tail).union(whole).where("start0 < end0").toDF(key, span_id, "start", "end")


def enclosing(points: DataFrame, named: DataFrame, key: str, point: str) -> DataFrame:
    """Each point with the least end of the spans strictly around it (null if none)."""
    n = named.select(key, F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    inside = overlapping(points.select(key, point), n, [key], (point, point), ("n_start", "n_end")).groupBy(key, point).agg(F.min("n_end").alias("enclosing_end"))
    return points.join(inside, [key, point], "left")


def dedupe(f: DataFrame, doc: str, order: list[Column]) -> DataFrame:
    """One finding per category, place and fingerprint: the first in the given order."""
    w = Window.partitionBy(doc, "category", "start", "end", "fingerprint").orderBy(*order)
    return f.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clip(f: DataFrame, keys: list[str], order: list[Column], cell: int = CELL) -> DataFrame:
    """Spans apart: in the given order (the start first), what an earlier one covers is cut off, and what it covers
    whole is dropped. A dropped span ends before the running maximum, so that equals the last chosen one's end.

    The maximum of the cells before a span's own is one row a cell; the rest is its own cell's."""
    f = f.withColumn("_cell", F.floor(F.col("start") / cell))
    w = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = f.groupBy(*keys, "_cell").agg(F.max("end").alias("_most")).withColumn("_past", F.max("_most").over(w)).drop("_most")
    own = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.max("end").over(own), "_past")
    return beside(f, cells, [*keys, "_cell"]).withColumn("_before", before).where("end > coalesce(_before, 0)").withColumn("start", F.greatest("start", F.coalesce("_before", F.lit(0)))).drop("_before", "_past", "_cell")


def render(texts: DataFrame, clipped: DataFrame, doc: str, text: str, replacement: str, limit: int | None = None) -> DataFrame:
    """``doc, rendered``: the texts with the clipped spans replaced. The text itself is joined once."""
    w = Window.partitionBy(doc).orderBy("start")
    parts = clipped.select(doc, "start", "end", replacement, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("from"))
    rows = parts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", "from", F.col(replacement).alias("r")))).alias("p"))
    j = texts.select(doc, text).join(rows, doc, "left")
    body = F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, F.substr(F.col(text), x["from"] + 1, x["start"] - x["from"]), x["r"]))
    out = F.when(F.col("p").isNull(), F.col(text)).otherwise(F.concat(body, F.substr(F.col(text), F.element_at("p", -1)["end"] + 1)))
    return j.select(doc, (F.substring(out, 1, limit) if limit else out).alias("rendered"))


def trusted(findings: DataFrame, text: str = "text") -> DataFrame:
    """Findings with a place in ``text``: the recorded one where it frames the sample, else the sample's first
    occurrence, else none. Adds ``at, until``; rows without a place are left out."""
    framed = (F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset")) & F.substr(F.col(text), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")).startswith(F.col("sample"))
    at = F.when(framed, F.col("start_offset")).otherwise(F.nullif(F.expr(f"position(sample, {text})"), F.lit(0)) - 1)
    return findings.where("sample <> ''").withColumn("at", at).withColumn("until", F.when(framed, F.col("end_offset")).otherwise(F.col("at") + F.length("sample"))).where("at is not null")


def overlap_ids(segments: DataFrame, findings: DataFrame, key: str, segment: str, finding: str) -> DataFrame:
    """``key, segment, ids``: the findings that overlap each segment, as text in ascending order."""
    f = findings.select(key, F.col("start").alias("f_start"), F.col("end").alias("f_end"), finding)
    hit = overlapping(segments.select(key, segment, "start", "end"), f, [key], ("start", "end"), ("f_start", "f_end"))
    return hit.groupBy(key, segment).agg(F.array_join(F.transform(F.array_sort(F.collect_list(finding)), lambda x: x.cast("string")), ",").alias("ids"))
