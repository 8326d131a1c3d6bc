"""Problem 6: periods covered by findings, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.operators.intervals import coverage
from docveil.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "privacy_findings")
    return coverage(f, F.col("document_id"), F.col("part_name"), F.col("start_offset"), F.col("end_offset")).select(
        F.col("entity_a").alias("document_id"), F.col("entity_b").alias("part_name"), "kind", "start_offset", "end_offset"
    )


P6_FOUND = """
WITH f AS (
  SELECT DISTINCT document_id, part_name, CAST(start_offset AS BIGINT) AS s, CAST(end_offset AS BIGINT) AS e
  FROM privacy_findings WHERE start_offset IS NOT NULL AND end_offset > start_offset
), r AS (
  SELECT *, max(e) OVER (PARTITION BY document_id, part_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f
), i AS (
  SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, part_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r
), p AS (
  SELECT document_id, part_name, min(s) AS start_offset, max(e) AS end_offset FROM i GROUP BY document_id, part_name, island
), g AS (
  SELECT document_id, part_name, lag(end_offset) OVER (PARTITION BY document_id, part_name ORDER BY start_offset) AS start_offset, start_offset AS end_offset FROM p
)
SELECT document_id, part_name, 'period' AS kind, start_offset, end_offset FROM p
UNION ALL
SELECT document_id, part_name, 'gap' AS kind, start_offset, end_offset FROM g WHERE start_offset IS NOT NULL
"""


def queries():
    return {"p6_found": p6_found}


def oracle_sql():
    return {"p6_found": P6_FOUND}
