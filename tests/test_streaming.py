from __future__ import annotations

import datetime as dt

from docveil.streaming.intervals import periods
from docveil.streaming.throttle import locked_accounts


def test_locked_accounts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(i, t0 + dt.timedelta(seconds=60 * i), 7, "error") for i in range(6)] + [(10 + i, t0 + dt.timedelta(seconds=400 * i), 8, "error") for i in range(6)] + [(99, t0 + dt.timedelta(days=1), 9, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    q = locked_accounts(s).writeStream.format("memory").queryName("locked").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.sql("select user_id, max(failures) from locked group by user_id").collect()
    assert [tuple(r) for r in got] == [(7, 6)]


def test_periods_of_a_stream(spark, tmp_path):
    schema = "document_id long, part_name string, start_offset int, end_offset int"
    for n, rows in enumerate(([(1, "body", 0, 5), (1, "body", 9, 12)], [(1, "body", 5, 9), (2, "x", 3, 3), (1, "body", None, 4)], [(1, "body", 2, 7), (3, "x", 65_530, 65_540)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(n)))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = periods(s).writeStream.format("memory").queryName("periods").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [tuple(r) for r in spark.sql("select document_id, start_offset, end_offset, periods from periods").collect()]
    # What changes nothing is not told again; cells part what runs over their edge.
    assert got.count((1, 0, 12, 1)) == 1 and {(3, 65_530, 65_536, 1), (3, 65_536, 65_540, 1)} <= set(got) and all(r[0] != 2 for r in got)
