"""How findings compare with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions.checks import safe_divide
from docveil.functions.text import audit_key


def matched(labels: DataFrame, findings: DataFrame, doc: str) -> DataFrame:
    """``doc, label_id, finding_id`` of pairs of one document and category of which one text holds the other, case and
    blanks aside. An empty label matches nothing."""
    a = labels.select(doc, "category", "label_id", audit_key(F.col("label")).alias("l")).where("l <> ''")
    b = findings.select(doc, "category", "finding_id", audit_key(F.col("sample")).alias("s"))
    return a.join(b, [doc, "category"]).where(F.col("s").contains(F.col("l")) | F.col("l").contains(F.col("s"))).select(doc, "label_id", "finding_id")


def scores(labels: DataFrame, findings: DataFrame, doc: str) -> DataFrame:
    """Per category: labels, labels found, findings, findings with a label, recall and precision. A label is found if
    any finding matches it, a finding is right if any label does."""
    m = matched(labels, findings, doc)
    hit = m.select("label_id").distinct().withColumn("hit", F.lit(1))
    right = m.select("finding_id").distinct().withColumn("right", F.lit(1))
    a = labels.join(hit, "label_id", "left").groupBy("category").agg(F.count("*").alias("labels"), F.count("hit").alias("found"))
    b = findings.join(right, "finding_id", "left").groupBy("category").agg(F.count("*").alias("findings"), F.count("right").alias("right"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = a.join(b, "category", "full").select("category", z("labels"), z("found"), z("findings"), z("right"))
    return out.withColumn("recall", safe_divide(F.col("found"), F.col("labels"))).withColumn("precision", safe_divide(F.col("right"), F.col("findings")))
