"""The interval map of an entity as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docveil.operators.intervals import CELL, IntervalMap

OUT = "document_id long, part_name string, cell long, start_offset long, end_offset long, periods long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    before = (list(m.starts), list(m.ends))
    for pdf in batches:
        for s, e in zip(pdf["s"], pdf["e"], strict=True):
            m.insert(int(s), int(e))
    if (m.starts, m.ends) != before:
        state.update((m.starts, m.ends))
        yield pd.DataFrame({"document_id": key[0], "part_name": key[1], "cell": key[2], "start_offset": m.starts, "end_offset": m.ends, "periods": len(m.starts)})


def periods(findings: DataFrame, cell: int = CELL) -> DataFrame:
    """All periods of a cell of an entity's axis each time they change; late rows are inserted like any other.

    The state is one map of disjoint periods per entity and cell, found by binary search: of bounded size, and an entity
    with a large share of all rows is as many keys as it has cells. A period over a cell's edge is two that touch there.
    Rows with a null bound or ``end <= start`` cover nothing."""
    f = findings.select("document_id", "part_name", F.col("start_offset").cast("long").alias("s"), F.col("end_offset").cast("long").alias("e")).where("e > s")
    f = f.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor((F.col("e") - 1) / cell))))
    f = f.select("document_id", "part_name", "cell", F.greatest(F.col("s"), F.col("cell") * cell).alias("s"), F.least(F.col("e"), (F.col("cell") + 1) * cell).alias("e"))
    return f.groupBy("document_id", "part_name", "cell").applyInPandasWithState(_update, OUT, "starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)
