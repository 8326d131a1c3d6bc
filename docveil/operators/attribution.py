"""Which client a text belongs to: the first whose name or alias occurs in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.operators.containment import BROADCAST_ROWS, held

def attribute(texts: DataFrame, names: DataFrame, text_id: str, text: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``text_id, client_id``: the least client any of whose names (``client_id, name``; a row per name or alias) is in
    the text, case aside. Blank names, and texts without a name, give no row. A name borne by many clients is one name,
    the least of them its client."""
    low = lambda c: F.lower(F.translate(c, "İI", "iı"))
    n = names.select("client_id", F.trim(low("name")).alias("n")).groupBy("n").agg(F.min("client_id").alias("client_id"))
    return held(texts.select(text_id, low(text).alias("t")), text_id, n, [], broadcast_rows).groupBy(text_id).agg(F.min("client_id").alias("client_id"))


def named(clients: DataFrame) -> DataFrame:
    """``client_id, name``: a row per name and alias of ``id, name, aliases``. Aliases are a JSON array, or plain text
    parted by semicolons or bars."""
    array = F.from_json("aliases", "array<string>")
    plain = F.when(~F.trim("aliases").rlike(r"^(?:[\[{].*|null)$"), F.split("aliases", "[;|]"))
    each = F.concat(F.array("name"), F.coalesce(F.when(F.trim("aliases").startswith("["), array), plain, F.array().cast("array<string>")))
    return clients.select(F.col("id").alias("client_id"), F.explode(each).alias("name")).where("name is not null").distinct()
