"""Which of many short texts occur in which texts, without comparing all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.operators.lineage import checkpointed

#: Lengths of anchors: a needle's anchor is as many of its first characters as the longest of these that it has, so the
#: anchor covers more than half of a needle, up to the last length.
ANCHORS = (1, 2, 4, 8, 16)
#: Needles that are broadcast, at most (some 10 MB); beyond it stretches and anchors meet by a shuffle.
BROADCAST_ROWS = 200_000


#: Pairs of texts and needles with equal columns that are simply compared; a group of more goes by anchors.
PAIRS = 4096


def held(texts: DataFrame, text_id: str, needles: DataFrame, by: list[str], broadcast_rows: int = BROADCAST_ROWS, pairs: int = PAIRS) -> DataFrame:
    """``text_id`` and the columns of ``needles`` of each needle (``n``) that is a part of the text (``t``), both having
    equal columns ``by``. Empty needles and nulls are in no text.

    The few texts and needles of most groups are compared one with the other; groups of many, and all where there are no
    columns ``by``, go by anchors."""
    t, n = texts.select(text_id, *by, "t").where("t is not null"), needles.where("n <> ''")
    if not by:
        return _by_anchors(t, text_id, n, by, broadcast_rows)
    size = t.groupBy(*by).agg(F.count("*").alias("_t")).join(n.groupBy(*by).agg(F.count("*").alias("_n")), by)
    many = checkpointed(size.where(F.col("_t") * F.col("_n") > pairs).select(*by))
    few = t.join(many, by, "left_anti").join(n, by).where(F.contains("t", "n")).select(text_id, *needles.columns)
    if many.isEmpty():
        return few
    return few.union(_by_anchors(t.join(many, by, "left_semi"), text_id, n.join(many, by, "left_semi"), by, broadcast_rows).select(*few.columns))


def _by_anchors(t: DataFrame, text_id: str, needles: DataFrame, by: list[str], broadcast_rows: int) -> DataFrame:
    """Texts are exploded to the stretches as long as some needle's anchor, which meet the anchors by equality; then the
    whole needle is looked up in place. What meets is in proportion to what is found, however many texts and needles
    have equal columns ``by``."""
    size = F.lit(0)
    for k in ANCHORS:
        size = F.when(F.length("n") >= k, k).otherwise(size)
    n = checkpointed(needles.withColumn("_anchor", F.left("n", size)))
    # As many rows as there are lengths.
    sizes = sorted(r[0] for r in n.select(F.length("_anchor")).distinct().collect())
    listed = ", ".join(f"IF(length(t) >= {k}, transform(sequence(1, length(t) - {k - 1}), i -> substr(t, i, {k})), array())" for k in sizes)
    stretches = F.expr(f"array_distinct(flatten(array({listed})))" if sizes else "CAST(array() AS array<string>)")
    keys, cols = [*by, "_anchor"], [text_id, *needles.columns]
    if n.count() <= broadcast_rows:
        return t.withColumn("_anchor", F.explode(stretches)).join(F.broadcast(n), keys).where(F.contains("t", "n")).select(*cols)
    # A shuffled row carries no text: the text meets the few needles that may be in it.
    met = t.select(text_id, *by, F.explode(stretches).alias("_anchor")).join(n, keys).select(*cols)
    return met.join(t.select(text_id, "t"), text_id).where(F.contains("t", "n")).select(*cols)
