"""Writing: append what is new, latest rows of keys, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only_new(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, each key once."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upserted(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing and new rows, of which the last per key in the given order stays; new rows win ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def append_index(rows: DataFrame, path: str, keys: list[str], existing: DataFrame | None = None) -> None:
    """Appends the new rows to a parquet table."""
    (rows.dropDuplicates(keys) if existing is None else only_new(rows, existing, keys)).write.mode("append").parquet(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
