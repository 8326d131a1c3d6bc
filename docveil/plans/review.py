"""Queries that compare and rebuild texts: attribution, scoring against labels, redaction segments, recogniser output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions.spans import matches
from docveil.functions.text import search_fold
from docveil.operators import ocr, redaction
from docveil.operators.attribution import attribute, named
from docveil.operators.containment import held
from docveil.operators.rules import RULES
from docveil.operators.scoring import scores
from docveil.sources.tables import table

EMAIL = next(r.pattern for r in RULES if r.category == "email_address")


def attributed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "ocr_pages").where("text is not null").dropDuplicates(["id"])
    return attribute(pages, named(table(spark, sf_dir, "clients")), "id", "text")


def attributed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client that a finding's sample names."""
    f = table(spark, sf_dir, "privacy_findings").where("sample is not null").dropDuplicates(["id"])
    return attribute(f, named(table(spark, sf_dir, "clients")), "id", "sample")


_LOW = "lower(translate({0}, 'İI', 'iı'))"
#: Names and aliases of all clients, each compared with each text.
_NAMES_SQL = r"""(SELECT id, trim(lower(translate(x, 'İI', 'iı'))) AS n FROM (SELECT DISTINCT id, name AS x FROM clients UNION
  SELECT id, unnest(CASE WHEN json_valid(aliases) AND json_type(aliases) = 'ARRAY' THEN CAST(json(aliases) AS VARCHAR[]) WHEN NOT regexp_full_match(trim(aliases), '[\[{].*|null') THEN string_split_regex(aliases, '[;|]') END) AS x FROM clients) WHERE trim(x) <> '')"""


def _attributed_sql(name: str, text: str) -> str:
    return f"SELECT p.id, min(c.id) AS client_id FROM (SELECT DISTINCT id, {_LOW.format(text)} AS t FROM {name} WHERE {text} IS NOT NULL) p JOIN {_NAMES_SQL} c ON contains(p.t, c.n) GROUP BY p.id"


def email_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail rule on the gold texts, against their labels."""
    g = table(spark, sf_dir, "gold_labels").where("ocr_text is not null")
    labels = g.select("id", F.posexplode("labels").alias("i", "x")).where("x.category = 'email_address'").select("id", F.lit("email_address").alias("category"), F.concat_ws("/", "id", F.col("i").cast("string")).alias("label_id"), F.col("x.text").alias("label"))
    found = g.select("id", F.posexplode(matches(F.col("ocr_text"), "(?iuU)" + EMAIL)).alias("i", "m")).select("id", F.lit("email_address").alias("category"), F.concat_ws("/", "id", F.col("i").cast("string")).alias("finding_id"), F.col("m.value").alias("sample"))
    return scores(labels, found, "id")


_KEY = "trim(lower(regexp_replace({0}, '\\s+', ' ', 'g')))"
SCORING = f"""
WITH g AS (SELECT id, labels, ocr_text FROM gold_labels WHERE ocr_text IS NOT NULL),
l AS (SELECT id, i, labels[i].text AS label FROM (SELECT id, labels, unnest(range(1, len(labels) + 1)) AS i FROM g) WHERE labels[i].category = 'email_address'),
f AS (SELECT id, i, v[i] AS sample FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT id, regexp_extract_all(ocr_text, '{EMAIL}', 0, 'i') AS v FROM g))),
m AS (SELECT l.id, l.i AS li, f.i AS fi FROM l JOIN f USING (id) WHERE {_KEY.format('label')} <> '' AND (contains({_KEY.format('sample')}, {_KEY.format('label')}) OR contains({_KEY.format('label')}, {_KEY.format('sample')}))),
c AS (SELECT (SELECT count(*) FROM l) AS labels, (SELECT count(*) FROM (SELECT DISTINCT id, li FROM m)) AS found, (SELECT count(*) FROM f) AS findings, (SELECT count(*) FROM (SELECT DISTINCT id, fi FROM m)) AS r)
SELECT 'email_address' AS category, labels, found, findings, r AS "right", coalesce(round(found / nullif(labels, 0), 4), 0) AS recall, coalesce(round(r / nullif(findings, 0), 4), 0) AS precision FROM c
"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "privacy_findings").where("review_status in ('approved', 'added_by_reviewer') and sample <> ''")
    r = F.coalesce(F.nullif("replacement_text", F.lit("")), F.nullif("placeholder", F.lit("")), F.lit("[REDACTED]"))
    return f.groupBy("document_id", F.col("sample").alias("needle")).agg(F.min("id").alias("target"), F.min_by(r, "id").alias("replacement"))


def redaction_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages cut at the approved samples of their document."""
    pages = table(spark, sf_dir, "ocr_pages").where("text is not null").dropDuplicates(["id"]).select("id", "document_id", "text")
    targets = _targets(spark, sf_dir).withColumn("n", search_fold(F.col("needle")))
    own = held(pages.select("id", "document_id", search_fold(F.col("text")).alias("t")), "id", targets, ["document_id"]).select("id", "target", "needle", "replacement")
    apart = redaction.regions(pages, own, "id", "text")
    return redaction.segments(pages, apart, "id", "text")


def segment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments' sources put together, which must be the text."""
    s = redaction_segments(spark, sf_dir)
    t = s.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda x: x["source"]), "").alias("t"))
    return t.select("id", F.sha2("t", 256).alias("digest"))


SEGMENT_CHECK = "SELECT DISTINCT id, sha256(text) AS digest FROM ocr_pages WHERE text IS NOT NULL AND text <> ''"


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as recogniser output: a word a row, lines as in the text, boxes on a grid."""
    p = table(spark, sf_dir, "ocr_pages").where("text is not null").dropDuplicates(["id"]).select("id", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    w = p.select("id", "l", F.posexplode(F.split(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")), " ")).alias("k", "word")).where("word <> ''")
    num = lambda c: c.cast("string")
    row = F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), num(F.col("l")), num(F.col("k")), num(F.col("k") * 40), num(F.col("l") * 20), F.lit("36"), F.lit("16"), F.when(F.col("k") == 0, "-1").otherwise("91.5"), F.col("word"))
    return w.groupBy("id").agg(F.concat(F.lit("level\tpage\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "k", row.alias("r")))), lambda x: x["r"]), "\n")).alias("tsv")).select("id", "tsv", F.lit(800).alias("w"), F.lit(1000).alias("h"))


def recognised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ocr.text_of(ocr.tokens(_recognised(spark, sf_dir), "id", "tsv", "w", "h"), "id")
    return t.select("id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


_BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
RECOGNISED = rf"""
WITH p AS (SELECT DISTINCT id, text FROM ocr_pages WHERE text IS NOT NULL),
l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{_BLANK}', ' ', 'g'))), lambda x: x <> '') AS ls FROM p)
SELECT id, length(t) AS chars, sha256(t) AS digest FROM (SELECT id, list_aggregate(ls, 'string_agg', chr(10)) AS t FROM l WHERE len(ls) > 0)
"""


def sample_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of recorded samples on the pages of their document."""
    pages = table(spark, sf_dir, "ocr_pages").where("text is not null").select("id", "document_id").dropDuplicates(["id"])
    s = table(spark, sf_dir, "privacy_findings").where("sample is not null").select("document_id", F.col("id").alias("finding_id"), "sample").dropDuplicates(["finding_id"])
    return ocr.regions(ocr.tokens(_recognised(spark, sf_dir), "id", "tsv", "w", "h"), s, "id", "finding_id", "sample", pages, "document_id")


QUERIES = {
    "attributed_pages": (attributed_pages, _attributed_sql("ocr_pages", "text")), "attributed_findings": (attributed_findings, _attributed_sql("privacy_findings", "sample")), "email_scoring": (email_scoring, SCORING), "redaction_segments": (redaction_segments, None), "segment_check": (segment_check, SEGMENT_CHECK),
    "recognised_text": (recognised_text, RECOGNISED), "sample_boxes": (sample_boxes, None),
}


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the scanned pages; the given names are those of the recorded findings."""
    from docveil.operators import person_names as pn

    known = pn.given_names(table(spark, sf_dir, "privacy_findings").where("category = 'natural_person_name'"), "sample")
    pages = table(spark, sf_dir, "ocr_pages").select("id", "text").dropDuplicates(["id"])
    return pn.person_names(pages, "id", "text", *known)


def part_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a document's parts by the detector against those of reviewers: a full outer join on the part."""
    f = table(spark, sf_dir, "privacy_findings").dropDuplicates(["id"])
    by = lambda where, name: f.where(where).groupBy("document_id", "part_name").agg(F.count("*").alias(name), F.count_distinct("category").alias(f"{name}_categories"))
    j = by("source in ('detector', 'ocr')", "detected").join(by("source = 'manual'", "reviewed"), ["document_id", "part_name"], "full")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("document_id", "part_name", z("detected"), z("reviewed"), z("detected_categories"), z("reviewed_categories"), (F.coalesce("detected", F.lit(0)) - F.coalesce("reviewed", F.lit(0))).alias("difference"))


PARTS = """
WITH f AS (SELECT DISTINCT * FROM privacy_findings),
d AS (SELECT document_id, part_name, count(*) AS detected, count(DISTINCT category) AS detected_categories FROM f WHERE source IN ('detector', 'ocr') GROUP BY ALL),
r AS (SELECT document_id, part_name, count(*) AS reviewed, count(DISTINCT category) AS reviewed_categories FROM f WHERE source = 'manual' GROUP BY ALL)
SELECT document_id, part_name, coalesce(detected, 0) AS detected, coalesce(reviewed, 0) AS reviewed, coalesce(detected_categories, 0) AS detected_categories, coalesce(reviewed_categories, 0) AS reviewed_categories,
  coalesce(detected, 0) - coalesce(reviewed, 0) AS difference
FROM d FULL OUTER JOIN r USING (document_id, part_name)
"""

QUERIES |= {"person_names": (person_names, None), "part_coverage": (part_coverage, PARTS)}

def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: s for k, (_, s) in QUERIES.items() if s}
