"""Visually identical text with different characters (problem 5).

Texts that hold a mapped character are cut into words and the stretches between them; those that hold one are exploded
to positioned code points and joined with the broadcast mapping (decompositions and look-alikes, bounded by Unicode).
Combining marks are put in order by their class, letters recomposed, and the strings rebuilt.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.llm import lookalikes, mojibake
from docveil.llm.inputs import rows_of, union
from docveil.sources.tables import table

KEYS = ("src", "row_key", "label_no")
#: The blocks of accents that are put over Latin letters.
ACCENTS = (*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100))


def _java_class(cps: list[int]) -> str:
    out, cps = [], sorted(cps)
    i = 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:X}}}" + (f"-\\x{{{cps[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


def _mapped() -> str:
    return f"[{_java_class([*lookalikes.mapping(), *(m for m in lookalikes.marks() if m in ACCENTS)])}]"


def holds_mapped(text: Column) -> Column:
    """Whether a text holds a mapped character. Most texts have none beyond the usual letters, which a small class
    tells; in the others, only characters that it does not hold are tried with the class of many ranges."""
    usual = f"[^\\x00-\\x7F{mojibake.NATURAL}]"
    return text.rlike(usual) & text.rlike(f"(?={usual}){_mapped()}")


def candidates(texts: DataFrame) -> DataFrame:
    return texts.where(holds_mapped(F.col("text"))).dropDuplicates(list(KEYS))


def mapping_frame(spark: SparkSession) -> DataFrame:
    """``ch, kind, units ARRAY<STRUCT<s, ccc>>``: what each character stands for, fully decomposed."""
    marks, kinds = lookalikes.marks(), {chr(k): v for k, v in lookalikes.mapping().items()}
    rows = []
    chars = set(kinds) | {chr(m) for m in marks} | {c for c in map(chr, range(0xC0, 0x2FA20)) if (d := unicodedata.decomposition(c)) and not d.startswith("<")}
    for ch in sorted(chars):
        to, kind = kinds.get(ch, (ch, "accent" if ord(ch) in ACCENTS and ord(ch) in marks else None))
        rows.append((ch, kind, [(c, marks.get(ord(c), 0)) for c in unicodedata.normalize("NFD", to)]))
    return spark.createDataFrame(rows, "ch string, kind string, units array<struct<s:string, ccc:int>>")


def _compositions() -> Column:
    entries = [{"k": a + b, "v": v} for (a, b), v in sorted(lookalikes.compositions().items())]
    return F.map_from_entries(F.from_json(F.lit(json.dumps(entries)), "array<struct<k:string,v:string>>"))


def canonical(texts: DataFrame) -> DataFrame:
    """Changed texts of ``src, row_key, label_no, text`` in one form.

    Columns out: ``src, row_key, label_no, canonical, kinds ARRAY<STRING>`` (the kinds of difference found: width, space,
    invisible, joined, letter, accent). Texts already in that form give no row, nor do nulls and empty texts; rows with
    equal keys come out once. A letter of another script is changed only in a word all of whose other letters are Latin
    or look so; words really written in another script stay, as do signs that look different from their plain form.
    """
    spark = texts.sparkSession
    base = candidates(texts)
    tokens = base.select(*KEYS, F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{Cf}]+|[^\p{L}\p{M}\p{Cf}]+"), F.lit(0))).alias("at", "token"))
    hit = holds_mapped(F.col("token"))
    points = (
        tokens.where(hit)
        .select(*KEYS, "at", F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
        .join(F.broadcast(mapping_frame(spark)), "ch", "left")
        .withColumn("foreign", F.col("ch").rlike(r"^\p{L}$") & ~F.col("ch").rlike(r"^\p{IsLatin}$") & F.coalesce(F.col("kind"), F.lit("")).isin("letter", "width", "joined").__invert__())
    )
    word = Window.partitionBy(*KEYS, "at")
    plain = F.array(F.struct(F.col("ch").alias("s"), F.lit(0).alias("ccc")))
    units = (
        points.withColumn("other", F.max("foreign").over(word))
        .withColumn("kept", F.col("other") & F.col("kind").isin("letter", "accent"))
        .withColumn("kind", F.when(F.col("kept"), None).otherwise(F.col("kind")))
        .select(*KEYS, "at", "pos", "ch", "kind", F.posexplode_outer(F.when(F.col("kept") & (F.col("kind").isNull()) & F.col("ch").rlike(r"^\p{L}$"), plain).otherwise(F.coalesce("units", plain))).alias("sub", "unit"))
        .select(*KEYS, "at", "pos", "ch", "kind", "sub", "unit.s", "unit.ccc")
        .withColumn("starter", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(word.orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)))
    )
    rebuilt = units.groupBy(*KEYS, "at").agg(
        F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("starter", "ccc", "pos", "sub", "s")))).alias("u"),
        F.array_distinct(F.collect_list("kind")).alias("kinds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("sub", F.lit(0)) == 0, F.struct("pos", "ch")))), lambda x: x["ch"]), "").alias("before"),
    )
    table_ = _compositions()
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        composed = F.try_element_at(table_, F.concat(acc["base"], x["s"]))
        free = (x["ccc"] > acc["last"]) | (acc["rest"] == "")
        mark = F.when(free & composed.isNotNull(), F.struct(acc["done"].alias("done"), composed.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["done"].alias("done"), acc["base"].alias("base"), F.concat(acc["rest"], x["s"]).alias("rest"), x["ccc"].alias("last"))
        )
        return F.when(x["ccc"] == 0, F.struct(F.concat(acc["done"], acc["base"], acc["rest"]).alias("done"), x["s"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))).otherwise(mark)

    rebuilt = rebuilt.withColumn("token", F.aggregate("u", empty, step, lambda a: F.concat(a["done"], a["base"], a["rest"])))
    # What is in that form already has no kinds.
    none = F.array().cast("array<string>")
    rebuilt = rebuilt.select(*KEYS, "at", F.when(F.col("token") == F.col("before"), none).otherwise(F.col("kinds")).alias("kinds"), "token")
    whole = tokens.where(~hit).select(*KEYS, "at", none.alias("kinds"), "token").unionByName(rebuilt)
    return (
        whole.groupBy(*KEYS)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "").alias("canonical"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
        .where(F.size("kinds") > 0)
        .withColumn("kinds", F.array_sort("kinds"))
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("long").alias("label_no")
    gold = table(spark, sf_dir, "gold_labels").select(F.lit("gold_labels").alias("src"), F.col("id").cast("string").alias("row_key"), F.posexplode("labels").alias("i", "label"))
    return union(
        rows_of(spark, sf_dir, "ocr_pages", "ocr_pages", "id", "text", zero),
        rows_of(spark, sf_dir, "privacy_findings", "privacy_findings", "id", "sample", zero),
        gold.select("src", "row_key", F.col("label.text").alias("text"), (F.col("i") + 1).cast("long").alias("label_no")),
    )


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(inputs(spark, sf_dir)).withColumn("kinds", F.array_join("kinds", ","))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = inputs(spark, sf_dir)
    # Records of problem 7 are no cases: what is found is put to its test, with the statistics of all its texts.
    found = canonical(texts).select(*KEYS).join(candidates(texts), list(KEYS))
    gold = F.col("src") == "gold_labels"
    sound = mojibake.sound_rows(found.select(*KEYS, F.when(~gold, F.col("text")).alias("text")), mojibake.inputs(spark, sf_dir), *KEYS)
    return sound.select(*KEYS)


def queries():
    return {"p5_found": p5_found, "p5_canonical": p5_canonical}


def oracle_sql():
    return {}
