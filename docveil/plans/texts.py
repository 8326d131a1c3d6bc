"""Queries of the scalar text functions over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.operators.classify import RULES, TAGS, classify
from docveil.sources.tables import table


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "ocr_pages").where("text is not null").dropDuplicates(["id"])
    n = tx.normalize_layout(F.col("text"))
    return p.select("id", F.length(n).cast("long").alias("chars"), F.sha2(n, 256).alias("digest"))


LAYOUT = r"""
WITH p AS (SELECT DISTINCT id, text FROM ocr_pages WHERE text IS NOT NULL),
n AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM p),
s AS (SELECT id, regexp_replace(regexp_replace(t, '^[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''), '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') AS t FROM n)
SELECT id, length(t) AS chars, sha256(t) AS digest FROM s
"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded fingerprint against the sample's; they agree unless the sample was cut."""
    f = table(spark, sf_dir, "privacy_findings").where("sample is not null").dropDuplicates(["id"])
    return f.select("id", tx.fingerprint(F.col("sample")).alias("own"), (tx.fingerprint(F.col("sample")) == F.col("fingerprint")).alias("same"))


FINGERPRINTS = "SELECT id, own, own = fingerprint AS same FROM (SELECT DISTINCT id, fingerprint, substr(sha256(lower(replace(sample, 'İ', 'i̇'))), 1, 12) AS own FROM privacy_findings WHERE sample IS NOT NULL)"


def filename_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "case_documents").dropDuplicates(["id"])
    n = F.col("filename")
    return d.select("id", tx.generate_title(n).alias("title"), tx.extension(n).alias("extension"), tx.detect_language(n).alias("language"), tx.detect_version(n).alias("version"), tx.detect_date(n).alias("date"), tx.safe_stem(n).alias("stem"), tx.supported(n).alias("supported"), tx.skipped(n).alias("skipped"))


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(filename), '{w.lower()}')" for w in words) + ")"


def _date(pattern: str, year_first: bool) -> str:
    y, m, d = (f"regexp_extract(filename, '{pattern}', {g})" for g in ((1, 2, 3) if year_first else (3, 2, 1)))
    return f"CASE WHEN try_cast({y} AS INT) BETWEEN 2020 AND 2035 AND try_cast({m} AS INT) BETWEEN 1 AND 12 AND try_cast({d} AS INT) BETWEEN 1 AND 31 THEN {y} || '-' || {m} || '-' || {d} END"


_VERSION = ", ".join(f"'v' || nullif(regexp_extract(filename, '{p}', 1, 'i'), '')" for p in tx.VERSIONS)
_EXT = ", ".join(f"'{e}'" for e in tx.EXTENSIONS)
FACETS = f"""
WITH d AS (SELECT DISTINCT id, filename, regexp_replace(filename, '\\.[^.]*$', '') AS s FROM case_documents)
SELECT id, trim(regexp_replace(replace(s, '_', ' '), '\\s+', ' ', 'g')) AS title, lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS extension,
  CASE WHEN {_any(tx.ENGLISH)} AND {_any(tx.TURKISH)} THEN 'TR/EN' WHEN {_any(tx.ENGLISH)} THEN 'EN' ELSE 'TR' END AS language,
  coalesce({_VERSION}) AS version, coalesce({', '.join(_date(*p) for p in tx.DATES)}) AS date,
  left(regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS stem,
  lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) IN ({_EXT}) AS supported, (contains(filename, '.DS_Store') OR contains(filename, '~$') OR contains(filename, '.git')) AS skipped
FROM d
"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of scanned pages with what stands around their recorded place."""
    f = table(spark, sf_dir, "privacy_findings").where("part_name like 'ocr_page_%' and sample is not null").dropDuplicates(["id"]).withColumn("page_number", F.regexp_extract("part_name", r"(\d+)$", 1).try_cast("int"))
    p = table(spark, sf_dir, "ocr_pages").where("text is not null").groupBy("document_id", "page_number").agg(F.min_by("text", "id").alias("text"))
    j = f.join(p, ["document_id", "page_number"], "left")
    return j.select("id", tx.evidence_context(F.col("text"), F.col("start_offset"), F.col("end_offset"), F.col("sample")).alias("context"))


_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
EVIDENCE = rf"""
WITH f AS (SELECT DISTINCT id, document_id, CAST(regexp_extract(part_name, '(\d+)$', 1) AS INT) AS page_number, start_offset AS s, end_offset AS e, sample FROM privacy_findings WHERE part_name LIKE 'ocr_page_%' AND sample IS NOT NULL),
p AS (SELECT document_id, page_number, arg_min(text, id) AS text FROM ocr_pages WHERE text IS NOT NULL GROUP BY ALL)
SELECT f.id, CASE WHEN text IS NOT NULL AND s IS NOT NULL AND e > s AND s >= 0
  THEN regexp_replace(regexp_replace(replace(substr(text, greatest(s - 48, 0) + 1, e + 48 - greatest(s - 48, 0)), chr(10), ' '), '^{_WS}', ''), '{_WS}$', '') ELSE left(sample, 160) END AS context
FROM f LEFT JOIN p ON p.document_id = f.document_id AND p.page_number = f.page_number
"""


def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "privacy_findings").where("placeholder is not null").dropDuplicates(["id"])
    return f.select("id", tx.replacement_for(F.col("placeholder"), F.col("risk"), F.coalesce("recommended_action", F.lit(""))).alias("replacement"), tx.drop_unsafe(F.col("sample")).alias("safe"))


REPLACEMENTS = "SELECT DISTINCT id, CASE WHEN risk = 'CRITICAL' AND contains(lower(coalesce(recommended_action, '')), 'review') AND NOT ends_with(placeholder, '_REDACTED]') THEN regexp_replace(placeholder, '\\]$', '_REDACTED]') ELSE placeholder END AS replacement, translate(sample, '\"''<>', '') AS safe FROM privacy_findings WHERE placeholder IS NOT NULL"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return classify(d.withColumn("filename", F.coalesce("doc_type", F.lit(""))), "doc_id", "filename", "text")


def _case(field: int) -> str:
    when = " ".join("WHEN " + " OR ".join(f"contains(h, '{k}')" for k in keys) + f" THEN '{(category, sub)[field]}'" for keys, category, sub in RULES)
    return f"CASE {when} ELSE '{('other', 'miscellaneous')[field]}' END"


CLASSIFIED = f"WITH d AS (SELECT doc_id, lower(replace(coalesce(doc_type, '') || chr(10) || left(text, 4000), 'İ', 'i̇')) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_case(0)} AS category, {_case(1)} AS subcategory FROM d"

def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the catalog's documents, by their names and titles."""
    d = table(spark, sf_dir, "case_documents").dropDuplicates(["id"])
    return classify(d, "id", "filename", "title", tags=True).select("id", F.explode("tags").alias("tag"))


_TAG_CASE = " ".join("WHEN " + " OR ".join(f"contains(h, '{k}')" for k in keys) + f" THEN [{', '.join(repr(t) for t in tags)}]" for (keys, *_), tags in zip(RULES, TAGS, strict=True))
TAGGED = f"WITH d AS (SELECT DISTINCT id, lower(replace(concat_ws(chr(10), filename, left(title, 4000)), 'İ', 'i̇')) AS h FROM case_documents) SELECT id, unnest(CASE {_TAG_CASE} ELSE [] END) AS tag FROM d"

QUERIES = {"tagged": (tagged, TAGGED), "layout": (layout, LAYOUT), "fingerprints": (fingerprints, FINGERPRINTS), "filename_facets": (filename_facets, FACETS), "evidence": (evidence, EVIDENCE), "replacements": (replacements, REPLACEMENTS), "classified": (classified, CLASSIFIED)}


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: s for k, (_, s) in QUERIES.items()}
