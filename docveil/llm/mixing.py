"""Mixing sources to target weights (problem 9).

Each source's texts are shuffled by a hash and laid end to end, as often as the source may be repeated, and cut into
blocks of equal tokens. A golden-ratio sequence, put through the cumulative weights, names the source of each slot of
the mixture; the n-th slot of a source takes its n-th block. The length of the mixture is the longest for which no
source runs out, so shares hold over any stretch of it, not just over the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.llm.tokens import token_counts
from docveil.operators.lineage import checkpointed
from docveil.sources.tables import table

#: Tokens of a block.
BLOCK = 4096
#: Fractional part of the golden ratio in units of 2 ** -64, and that unit's inverse.
GOLDEN, UNIT = 11400714819323198485, 1 << 64
#: Hash ranges each source is split into, so that no task lays out a whole source.
RANGES = 256


def shuffled(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``source, doc_id, pass, begin, tokens``: where each use of a text begins in its source's stream; ``targets`` name
    the ``passes`` over each ``source``.

    Prefix sums are taken in two steps: over the ranges of a source (a bounded number of rows), then within a range,
    so a source with a third of all rows is RANGES tasks' work.
    """
    keyed = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("r", F.pmod(F.shiftright("h", 7), F.lit(RANGES)))
    part = keyed.groupBy("source", "r").agg(F.sum("tokens").alias("t"))
    before = part.withColumn("base", F.sum("t").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).select("source", "r", "base")
    total = part.groupBy("source").agg(F.sum("t").alias("stock"))
    w = Window.partitionBy("source", "r").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = keyed.join(before, ["source", "r"]).withColumn("at", F.col("base") + F.sum("tokens").over(w) - F.col("tokens"))
    return laid.join(F.broadcast(total.join(targets, "source")), "source").select("source", "doc_id", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"), "at", "stock", "tokens").select(
        "source", "doc_id", "pass", (F.col("at") + F.col("pass") * F.col("stock")).alias("begin"), "tokens"
    )


def schedule(spark: SparkSession, slots: int, weights: list[tuple[str, float]]) -> DataFrame:
    """``slot, source, turn``: the source of each slot, and the how-manieth of its slots it is."""
    low, rows = 0.0, []
    for source, share in weights:
        rows.append((source, low, low + share))
        low += share
    bounds = F.broadcast(spark.createDataFrame([(s, a, b if i < len(rows) - 1 else 1.0) for i, (s, a, b) in enumerate(rows)], "source string, low double, high double"))
    # Whole numbers, as a double would lose the point's own digits where slots are counted in billions.
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"CAST((CAST(id + 1 AS DECIMAL(18, 0)) * CAST({GOLDEN} AS DECIMAL(20, 0))) % CAST({UNIT} AS DECIMAL(20, 0)) AS DOUBLE) / {float(UNIT)!r}D").alias("x"))
    drawn = points.join(bounds, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("slot", "source").withColumn("stretch", F.floor(F.col("slot") / 8192))
    # Ranks per source in two steps: slots of the stretches before, then within the stretch.
    counts = drawn.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("source", "stretch", "base")
    w = Window.partitionBy("source", "stretch").orderBy("slot")
    return drawn.join(base, ["source", "stretch"]).select("slot", "source", (F.col("base") + F.row_number().over(w) - 1).alias("turn"))


def mixed(docs: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """Uses of texts of ``doc_id, source, text`` in the order of the mixture.

    Columns out: ``slot BIGINT, source, doc_id, pass INT, tokens BIGINT``. A text belongs to the block in which it
    begins, so blocks are equal but for the last text's overhang, which evens out over a source's stream. Every use of
    a text has its own ``pass``, at most ``max_repeats`` of them. Texts without tokens, with a null source or one that
    has no target are left out, as are targets that are null, not positive or have no texts; the shares of the rest
    are scaled to 1. No text, no row.

    The mixture ends where the first source is used up: a source of 1 million tokens, to be taken twice, with a share
    of a half allows 4 million tokens in all, however much the others hold. ``shares`` shows what each one gave.
    """
    spark = docs.sparkSession
    goal = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = checkpointed(token_counts(docs.where("source is not null"), "doc_id", "source").where("tokens > 0").join(F.broadcast(goal.select("source")), "source", "left_semi"))
    # One row per source: as many as there are targets.
    stock = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("tokens").alias("stock")).join(F.broadcast(goal), "source").collect()}
    scale = sum(r["target_share"] for r in stock.values()) or 1.0
    weights = [(s, stock[s]["target_share"] / scale) for s in sorted(stock)]
    room = min((stock[s]["stock"] * stock[s]["max_repeats"] / share for s, share in weights), default=0.0)
    # The discrepancy of the sequence may give a source a few slots more than its share.
    slots = int(room // block)
    # Passes the schedule may ask for, a few slots more than the share included; no more are laid out.
    passes = [(s, int(min(stock[s]["max_repeats"], (slots * share + 64) * block // stock[s]["stock"] + 1))) for s, share in weights]
    uses = shuffled(sized, F.broadcast(spark.createDataFrame(passes, "source string, passes int")), seed).withColumn("turn", F.floor(F.col("begin") / block))
    return uses.join(schedule(spark, slots, weights), ["source", "turn"]).select("slot", "source", "doc_id", F.col("pass").cast("int").alias("pass"), "tokens")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, uses, most_repeats`` of each target."""
    per = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("uses"), F.max("n").alias("most_repeats"))
    whole = Window.partitionBy()
    return (
        targets.select("source", "target_share")
        .join(per, "source", "left")
        .withColumn("actual_share", F.round(F.coalesce(F.col("tokens") / F.sum("tokens").over(whole), F.lit(0.0)), 6))
        .select("source", "target_share", "actual_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    )


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "mix_targets")
    return shares(mixed(table(spark, sf_dir, "documents"), t), t)


def queries():
    return {"p9_mixed": p9_mixed, "p9_shares": p9_shares}


def oracle_sql():
    return {}
