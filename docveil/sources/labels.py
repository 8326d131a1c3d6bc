"""Label and roster files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "note string, documents array<struct<id:string, path:string, expected_residual_risk:string, expected_residual_risk_note:string, labels:array<struct<category:string, text:string, required:boolean>>, ocr_text:string>>"
ROSTER = "clients array<struct<name:string, aliases:array<string>>>"


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """``id, path, n, category, text, required`` of a labelled set; a label is required unless it says otherwise."""
    d = spark.read.schema(LABELS).option("multiLine", True).json(path).select(F.explode("documents").alias("d"))
    return d.select("d.id", "d.path", F.posexplode("d.labels").alias("n", "l")).select("id", "path", "n", "l.category", "l.text", F.coalesce("l.required", F.lit(True)).alias("required"))


def roster(spark: SparkSession, path: str) -> DataFrame:
    """``client_id, name, alias``: clients in the file's order, numbered from 1; one row per alias, at least one. No
    file, no rows."""
    try:
        d = spark.read.schema(ROSTER).option("multiLine", True).json(path)
        d.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        d = spark.createDataFrame([], ROSTER)
    c = d.select(F.posexplode("clients").alias("i", "c")).where("c.name is not null")
    return c.select((F.col("i") + 1).cast("long").alias("client_id"), "c.name", F.explode_outer("c.aliases").alias("alias"))
