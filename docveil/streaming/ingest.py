"""Files as they arrive: extracted, and appended if their path is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docveil.operators.sinks import only_new
from docveil.sources.documents import extracted

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Reads what lies in ``folder`` into the parquet table at ``table`` and ends when all is read; call it again for
    what came since. A path is taken once: batches are checked against the table, so a batch that is run again after a
    failure adds nothing twice."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)

    def append(batch: DataFrame, _: int) -> None:
        rows = extracted(batch.dropDuplicates(["path"]))
        try:
            rows = only_new(rows, batch.sparkSession.read.parquet(table), ["path"])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(table)

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
