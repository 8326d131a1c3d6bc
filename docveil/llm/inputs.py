"""The text columns the problems name, as one relation ``src, row_key, text``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.sources.tables import table


def rows_of(spark: SparkSession, sf_dir: str, name: str, src: str, key: str, text: str, *more: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, name).where(where).select(F.lit(src).alias("src"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"), *more)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
