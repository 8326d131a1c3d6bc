"""Overlapping and gapped intervals.

Coverage of integer offsets is decomposed by position: every entity's axis is cut into cells of ``CELL``
offsets, each interval is clipped to the cells it meets, and an ordered disjoint-interval map is kept in keyed
state for one (entity, cell) at a time. A cell holds at most ``CELL / 2`` disjoint periods, so the state is
bounded however many rows one entity has, and a hot entity spreads over as many tasks as it has cells. What can
reach over a cell's edge is only its first and last period; these are stitched in one window whose rows are
bounded by the number of cells.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets in one cell.
CELL = 65_536


class IntervalMap:
    """Disjoint half-open intervals in order; touching ones are joined."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or []), list(ends or [])

    def insert(self, start: int, end: int) -> None:
        """Binary search finds the neighbours that overlap or touch; they become one interval."""
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def gaps(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.ends, self.starts[1:], strict=False)


_CELLS = "entity_a long, entity_b string, cell long, kind string, start_offset long, end_offset long"


def _merge_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by entity and cell, so one map is alive at a time."""
    key, state, out = None, IntervalMap(), []

    def close() -> None:
        last = len(state.starts) - 1
        for i, (s, e) in enumerate(zip(state.starts, state.ends, strict=True)):
            out.append((*key, ("first" if i == 0 else "last" if i == last else "period"), s, e))
        out.extend((*key, "gap", s, e) for s, e in state.gaps())

    def rows(chunk: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["entity_a", "entity_b", "cell", "kind", "start_offset", "end_offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for a, b, cell, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b, cell) != key:
                if key is not None:
                    close()
                key, state = (a, b, cell), IntervalMap()
            state.insert(start, end)
        if len(out) > 20_000:
            yield rows(out)
            out.clear()
    if key is not None:
        close()
    if out:
        yield rows(out)


def coverage(df: DataFrame, entity_a: Column, entity_b: Column, start: Column, end: Column, cell: int = CELL) -> DataFrame:
    """Continuous periods and the gaps between neighbouring periods of each entity.

    Columns out: ``entity_a BIGINT, entity_b STRING, kind STRING ('period' | 'gap'), start_offset, end_offset BIGINT``.
    Intervals with a null bound or ``end <= start`` cover nothing and are left out; repeated rows change nothing;
    a null in the entity is an entity of its own; an empty table gives an empty result. Touching intervals join.
    Other columns of ``df`` are ignored, whatever their names.
    """
    base = df.select(entity_a.cast("long").alias("entity_a"), entity_b.cast("string").alias("entity_b"), start.cast("long").alias("s"), end.cast("long").alias("e")).where("e > s")
    # Equal starts collapse before the shuffle: only the longest can matter.
    longest = base.groupBy("entity_a", "entity_b", (F.floor(F.col("s") / cell)).alias("cell0"), "s").agg(F.max("e").alias("e"))
    pieces = longest.select("entity_a", "entity_b", F.explode(F.sequence(F.col("cell0"), F.floor((F.col("e") - 1) / cell))).alias("cell"), "s", "e").select(
        "entity_a", "entity_b", "cell", F.greatest(F.col("s"), F.col("cell") * cell).alias("s"), F.least(F.col("e"), (F.col("cell") + 1) * cell).alias("e")
    )
    cells = pieces.repartition("entity_a", "entity_b", "cell").sortWithinPartitions("entity_a", "entity_b", "cell").mapInArrow(_merge_cells, _CELLS)

    inner = cells.where("kind in ('period', 'gap')").select("entity_a", "entity_b", "kind", "start_offset", "end_offset")
    w = Window.partitionBy("entity_a", "entity_b").orderBy("start_offset")
    edge = (
        cells.where("kind in ('first', 'last')")
        .withColumn("before", F.lag("end_offset").over(w))
        .withColumn("joined", F.coalesce((F.col("kind") == "first") & (F.col("before") == F.col("start_offset")), F.lit(False)))
        .withColumn("island", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(w))
        .groupBy("entity_a", "entity_b", "island")
        .agg(
            F.min("start_offset").alias("s"),
            F.max("end_offset").alias("e"),
            # The gap before the island, unless the cell's own map has listed it already.
            F.max(F.when((F.col("kind") == "first") & ~F.col("joined"), F.col("before"))).alias("g"),
        )
    )
    row = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), F.col(s).alias("start_offset"), F.col(e).alias("end_offset"))
    stitched = edge.select("entity_a", "entity_b", F.explode(F.when(F.col("g").isNull(), F.array(row("period", "s", "e"))).otherwise(F.array(row("period", "s", "e"), row("gap", "g", "s")))).alias("x")).select(
        "entity_a", "entity_b", "x.*"
    )
    return inner.unionByName(stitched)
