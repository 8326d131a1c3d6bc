"""Queries of the detection rules, of pseudonyms and of span algebra, over the catalog's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions.checks import valid_tckn, valid_vkn
from docveil.functions.spans import matches
from docveil.functions.text import pseudonym_key
from docveil.operators import spans as sp
from docveil.operators.detection import all_findings, cut_identifiers, findings, named_courts_sql, numbers, placeholders
from docveil.operators.person_names import GIVEN, given_names
from docveil.operators.rules import DIRECT, RULES
from docveil.operators.lineage import checkpointed
from docveil.sources.tables import table

PATTERNS = {r.category: r.pattern for r in reversed(RULES)}
#: Rules that both regular-expression dialects read alike.
PLAIN = ("email_address", "iban", "mersis_number", "bar_registration_number", "passport_number", "account_number", "case_or_investigation_number", "date", "money_amount")


def _places(category: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").where("text is not null")
        m = matches(F.col("text"), "(?iuU)" + PATTERNS[category])
        return d.select("doc_id", F.explode(m).alias("m")).select("doc_id", F.col("m.value").alias("value"), F.col("m.start").cast("long").alias("start_at"), F.col("m.end").cast("long").alias("end_at"))

    return query


def _places_sql(category: str) -> str:
    p = PATTERNS[category].replace("'", "''")
    return f"""
WITH m AS (
  SELECT doc_id, regexp_extract_all(text, '{p}', 0, 'i') AS v, string_split_regex(text, '{p}', 'i') AS g FROM documents WHERE text IS NOT NULL
), e AS (
  SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS i FROM m
), s AS (
  SELECT doc_id, v[i] AS value, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_at FROM e
)
SELECT doc_id, value, start_at, start_at + length(value) AS end_at FROM s
"""


def _spread(pages: DataFrame, key: str) -> DataFrame:
    """Pages, each once, over as many partitions as the session shuffles to. Rules take a thousand times as long on a text
    as reading it does, so partitions are not merged for being small."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(n, key).dropDuplicates([key])


def _page_findings(spark: SparkSession, sf_dir: str, pages: DataFrame, doc_id: str) -> DataFrame:
    """Findings with placeholders; known given names are the common ones and those of the recorded findings."""
    recorded, rare = given_names(table(spark, sf_dir, "privacy_findings").where("category = 'natural_person_name'"), "sample")
    # Read several times by numbering and cutting; the rules run once.
    return placeholders(checkpointed(all_findings(pages, doc_id, "text", [*GIVEN, *recorded], rare)))


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of all rules and all names over the scanned pages, cut, deduplicated and with placeholders."""
    pages = _spread(table(spark, sf_dir, "ocr_pages").select("id", "text"), "id")
    f = checkpointed(_page_findings(spark, sf_dir, pages, "id"))
    f = sp.dedupe(cut_identifiers(f), "doc_id", [F.col("rule_ord"), F.col("match_ord")])
    return f.select("doc_id", "category", "sample", "risk", "action", "placeholder", "start", "end", "fingerprint")


def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in RULES if r.category in ("email_address", "date", "money_amount"))
    f = findings(table(spark, sf_dir, "documents"), "doc_id", "text", rules)
    return f.groupBy("category", "risk").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("texts"))


def redacted_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the clipped findings replaced, cut to 12,000 characters."""
    pages = _spread(table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("doc_id"), "text"), "doc_id")
    f = _page_findings(spark, sf_dir, pages, "doc_id")
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sp.RISK.items() for x in kv)), F.col("risk")), F.lit(5))
    c = sp.clip(f, ["doc_id"], [F.col("start"), rank.desc(), (F.col("start") - F.col("end")), F.col("rule_ord"), F.col("match_ord")])
    return sp.render(pages.where("text is not null"), c, "doc_id", "text", "placeholder", 12_000)


def court_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(F.expr(named_courts_sql("text"))).alias("m")).select("doc_id", F.col("m.value").alias("value"), F.col("m.start").alias("start_at"), F.col("m.end").alias("end_at"))


def numbered_notaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[0-9]{1,2}\.\s*Noterli[ğg]i"), F.lit(0))).cast("long").alias("n")).where("n > 0")


NOTARIES = r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,2}\.\s*Noterli[ğg]i')) AS n FROM documents WHERE text IS NOT NULL AND n > 0"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded findings with both offsets, once each, as spans of their document's part."""
    f = table(spark, sf_dir, "privacy_findings").where("start_offset is not null and end_offset > start_offset").dropDuplicates(["id"])
    return f.select(F.concat_ws("/", F.col("document_id").cast("string"), "part_name").alias("part"), "id", "category", "risk", F.col("start_offset").cast("long").alias("start"), F.col("end_offset").cast("long").alias("end"), "fingerprint", "placeholder", "document_id", "sample")


_RECORDED = "SELECT DISTINCT document_id || '/' || part_name AS part, id, category, risk, CAST(start_offset AS BIGINT) AS s, CAST(end_offset AS BIGINT) AS e, fingerprint, placeholder, document_id, sample FROM privacy_findings WHERE start_offset IS NOT NULL AND end_offset > start_offset"


def clipped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sp.RISK.items() for x in kv)), F.col("risk")), F.lit(5))
    c = sp.clip(_recorded(spark, sf_dir), ["part"], [F.col("start"), rank.desc(), F.col("end").desc(), F.col("id")])
    return c.select("part", "id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


CLIPPED = f"""
WITH f AS ({_RECORDED}), r AS (SELECT *, CASE risk WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 5 END AS k FROM f),
b AS (SELECT *, coalesce(max(e) OVER (PARTITION BY part ORDER BY s, k DESC, e DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT part, id, greatest(s, before) AS start_at, e AS end_at FROM b WHERE e > before
"""


def merged_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _recorded(spark, sf_dir).where(F.col("category").isin(*DIRECT))
    return sp.merge_spans(f, ["part"]).select("part", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


_DIRECT_SQL = ", ".join(f"'{c}'" for c in DIRECT)
_CLAUSES = "('health_data', 'criminal_allegation', 'privileged_or_confidential')"
MERGED = f"""
WITH f AS ({_RECORDED}), d AS (SELECT * FROM f WHERE category IN ({_DIRECT_SQL})),
b AS (SELECT *, max(e) OVER (PARTITION BY part ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
i AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY part ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT part, min(s) AS start_at, max(e) AS end_at FROM i GROUP BY part, island
"""


def subtracted_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What direct identifiers leave of the sensitive clauses."""
    f = _recorded(spark, sf_dir)
    clauses = f.where(f"category in {_CLAUSES}").select("part", "id", "start", "end")
    cuts = f.where(F.col("category").isin(*DIRECT)).select("part", "start", "end")
    return sp.subtract(clauses, cuts, "part", "id").select("part", "id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


SUBTRACTED = f"""
WITH f AS ({_RECORDED}), c AS (SELECT part, id, s, e FROM f WHERE category IN {_CLAUSES}), d AS (SELECT part, s AS ds, e AS de FROM f WHERE category IN ({_DIRECT_SQL})),
h AS (SELECT c.part, c.id, c.s, c.e, greatest(ds, s) AS a, least(de, e) AS b FROM c JOIN d ON c.part = d.part AND ds < e AND s < de),
r AS (SELECT *, max(b) OVER (PARTITION BY part, id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
g AS (SELECT part, id, coalesce(before, s) AS start_at, a AS end_at FROM r UNION ALL SELECT part, id, max(b), max(e) FROM h GROUP BY part, id UNION ALL SELECT part, id, s, e FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.part = c.part AND h.id = c.id))
SELECT part, id, start_at, end_at FROM g WHERE start_at < end_at
"""


def deduped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.dedupe(_recorded(spark, sf_dir), "part", [F.col("id")]).select("part", "id", "category", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


DEDUPED = f"WITH f AS ({_RECORDED}) SELECT part, min(id) AS id, category, s AS start_at, e AS end_at FROM f GROUP BY part, category, s, e, fingerprint"


def overlapping_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct identifiers in each sensitive clause."""
    f = _recorded(spark, sf_dir)
    clauses = f.where(f"category in {_CLAUSES}").select("part", F.col("id").alias("clause_id"), "start", "end")
    return sp.overlap_ids(clauses, f.where(F.col("category").isin(*DIRECT)), "part", "clause_id", "id")


OVERLAPS = f"""
WITH f AS ({_RECORDED}), c AS (SELECT part, id AS clause_id, s, e FROM f WHERE category IN {_CLAUSES}), d AS (SELECT part, id, s AS ds, e AS de FROM f WHERE category IN ({_DIRECT_SQL}))
SELECT c.part, clause_id, string_agg(CAST(d.id AS VARCHAR), ',' ORDER BY d.id) AS ids FROM c JOIN d ON c.part = d.part AND ds < e AND s < de GROUP BY c.part, clause_id
"""


def enclosing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts that stand strictly within a clause, with the narrowest clause's end."""
    f = _recorded(spark, sf_dir)
    courts = f.where("category = 'court_or_authority'").select("part", F.col("start").alias("point")).distinct()
    return sp.enclosing(courts, f.where(f"category in {_CLAUSES}"), "part", "point")


ENCLOSING = f"""
WITH f AS ({_RECORDED}), p AS (SELECT DISTINCT part, s AS point FROM f WHERE category = 'court_or_authority'), n AS (SELECT part, s, e FROM f WHERE category IN {_CLAUSES})
SELECT p.part, p.point, min(n.e) AS enclosing_end FROM p LEFT JOIN n ON n.part = p.part AND n.s < p.point AND p.point < n.e GROUP BY p.part, p.point
"""


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of recorded values by first appearance, per document and category."""
    f = _recorded(spark, sf_dir).where("sample is not null").withColumn("key", pseudonym_key(F.col("sample")))
    keys = ["document_id", "category", "key"]
    first = f.groupBy(*keys).agg(F.min("id").alias("first"))
    n = numbers(first.withColumn("stretch", F.floor(F.col("first") / 65_536)), ["document_id", "category"], "stretch", "first")
    return f.select("id", *keys).join(n.select(*keys, "number"), keys).select("id", "document_id", "category", F.col("number").cast("long").alias("number"))


_FOLD_SQL = "trim(replace(lower(translate(regexp_replace({0}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), 'İI', 'iı')), 'ς', 'ς'), ' ')"
PSEUDONYMS = f"""
WITH f AS ({_RECORDED}), k AS (SELECT *, {_FOLD_SQL.format('sample')} AS key FROM f WHERE sample IS NOT NULL), m AS (SELECT *, min(id) OVER (PARTITION BY document_id, category, key) AS first FROM k)
SELECT id, document_id, category, dense_rank() OVER (PARTITION BY document_id, category ORDER BY first) AS number FROM m
"""


def checked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "privacy_findings").where("category in ('turkish_national_id', 'tax_number')").dropDuplicates(["id"]).withColumn("digits", F.regexp_replace("sample", "[^0-9]", ""))
    return f.select("id", "digits", valid_tckn(F.col("digits")).alias("tckn"), valid_vkn(F.col("digits")).alias("vkn"))


def _d(i: int) -> str:
    return f"CAST(substr(digits, {i}, 1) AS INT)"


_VKN_TERMS = " + ".join(f"(CASE WHEN ({_d(i)} + {10 - i}) % 10 = 0 THEN 0 WHEN (({_d(i)} + {10 - i}) % 10 * {1 << (10 - i)}) % 9 = 0 THEN 9 ELSE (({_d(i)} + {10 - i}) % 10 * {1 << (10 - i)}) % 9 END)" for i in range(1, 10))
_ODD, _EVEN = " + ".join(_d(i) for i in (1, 3, 5, 7, 9)), " + ".join(_d(i) for i in (2, 4, 6, 8))
CHECKED = f"""
WITH f AS (SELECT DISTINCT id, regexp_replace(sample, '[^0-9]', '', 'g') AS digits FROM privacy_findings WHERE category IN ('turkish_national_id', 'tax_number'))
SELECT id, digits,
  coalesce(CASE WHEN regexp_matches(digits, '^[1-9][0-9]{{10}}$') THEN {_d(10)} = ((({_ODD}) * 7 - ({_EVEN})) % 10 + 10) % 10 AND {_d(11)} = (({_ODD}) + ({_EVEN}) + {_d(10)}) % 10 END, false) AS tckn,
  coalesce(CASE WHEN regexp_matches(digits, '^[0-9]{{10}}$') THEN (10 - ({_VKN_TERMS}) % 10) % 10 = {_d(10)} END, false) AS vkn
FROM f
"""

BY_CATEGORY = " UNION ALL ".join(
    f"SELECT '{c}' AS category, '{'HIGH' if c == 'email_address' else 'MEDIUM'}' AS risk, CAST(sum(n) AS BIGINT) AS findings, count(*) AS texts FROM (SELECT doc_id, len(regexp_extract_all(text, '{PATTERNS[c]}', 0, 'i')) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0"
    for c in ("email_address", "date", "money_amount")
)


def queries():
    q = {f"detect_{c}": _places(c) for c in PLAIN}
    return q | {
        "detect_all": detect_all, "findings_by_category": findings_by_category, "redacted_previews": redacted_previews, "court_spans": court_spans, "numbered_notaries": numbered_notaries,
        "clipped_findings": clipped_findings, "merged_cuts": merged_cuts, "subtracted_cuts": subtracted_cuts, "deduped_findings": deduped_findings, "overlapping_ids": overlapping_ids,
        "enclosing_spans": enclosing_spans, "pseudonyms": pseudonyms, "checked_ids": checked_ids,
    }


def oracle_sql():
    return {f"detect_{c}": _places_sql(c) for c in PLAIN} | {
        "findings_by_category": BY_CATEGORY, "numbered_notaries": NOTARIES, "clipped_findings": CLIPPED, "merged_cuts": MERGED, "subtracted_cuts": SUBTRACTED, "deduped_findings": DEDUPED,
        "overlapping_ids": OVERLAPS, "enclosing_spans": ENCLOSING, "pseudonyms": PSEUDONYMS, "checked_ids": CHECKED,
    }
