"""Queries of matters, pages, reviews and logs around the catalog.

What the test tables do not have is derived from them: a matter is a client's category of documents (documents without a
client are in the matter "Unassigned"), an artifact is a scanned page, the audit log is ``events`` (user_id the account,
the value of ``props.k`` the address, event_type the action).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.functions.checks import RESIDUAL, rank_of, safe_divide
from docveil.functions.spans import matches_sql
from docveil.operators import sinks
from docveil.operators.detection import numbers
from docveil.operators.rules import RULES
from docveil.operators.scoring import matched
from docveil.plans.catalog import PENDING, C, D, FI, _clients, _docs, _findings
from docveil.plans.detection import PATTERNS, PLAIN
from docveil.sources.tables import table

#: What categories are called.
LABELS = {
    "litigation": "Dava", "corporate_law": "Şirketler Hukuku", "contract_law": "Sözleşmeler", "intellectual_property": "Fikri Mülkiyet", "data_privacy": "Kişisel Veriler", "regulatory_compliance": "Uyum", "labor_law": "İş Hukuku",
    "reports_presentations": "Raporlar", "other": "Diğer",
}
_DIM = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LABELS.items()) + ") AS g(category, label)"
_PAGES = "(SELECT DISTINCT * FROM ocr_pages)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_pages").dropDuplicates(["id"])


def _dimension(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(LABELS.items()), "category string, label string"))


def _matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, matter, created_at, category, residual_risk``: each document and its matter."""
    d = _docs(spark, sf_dir)
    return d.withColumn("matter", F.when(F.col("client_id").isNull(), "Unassigned").otherwise(F.concat_ws("/", F.col("client_id").cast("string"), "category")))


_M = f"(SELECT *, CASE WHEN client_id IS NULL THEN 'Unassigned' ELSE concat_ws('/', CAST(client_id AS VARCHAR), category) END AS matter FROM {D})"


def listing_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with all its dimensions: client, label of the category (the fallback's for unknown ones), matter, counts
    of findings and of pages; each fact is added up before it is joined."""
    f = _findings(spark, sf_dir).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("findings"))
    p = _pages(spark, sf_dir).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("pages"))
    d = _matters(spark, sf_dir).join(_dimension(spark), "category", "left").join(_clients(spark, sf_dir).select(F.col("id").alias("client_id"), F.col("name").alias("client")), "client_id", "left").join(f, "id", "left").join(p, "id", "left")
    return d.select("id", "filename", "client", F.coalesce("label", F.lit(LABELS["other"])).alias("label"), "matter", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("pages", F.lit(0)).alias("pages"))


LISTING = f"""
SELECT d.id, d.filename, c.name AS client, coalesce(g.label, '{LABELS["other"]}') AS label, d.matter, coalesce(f.n, 0) AS findings, coalesce(p.n, 0) AS pages
FROM {_M} d LEFT JOIN {C} c ON c.id = d.client_id LEFT JOIN {_DIM} ON g.category = d.category LEFT JOIN (SELECT document_id, count(*) AS n FROM {FI} GROUP BY 1) f ON f.document_id = d.id
LEFT JOIN (SELECT document_id, count(*) AS n FROM {_PAGES} GROUP BY 1) p ON p.document_id = d.id
"""


def matter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of matters that have more than one, with the matter's number of documents."""
    m = _matters(spark, sf_dir)
    size = m.groupBy("matter").agg(F.count("*").alias("documents")).where("documents > 1")
    return m.select("id", "matter").join(size, "matter").select("id", "matter", "documents")


MATTER_DOCUMENTS = f"SELECT d.id, d.matter, m.documents FROM {_M} d JOIN (SELECT matter, count(*) AS documents FROM {_M} GROUP BY matter HAVING count(*) > 1) m ON m.matter = d.matter"


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the findings in its part, none for most."""
    f = _findings(spark, sf_dir).where("part_name like 'ocr_page_%'").select("document_id", F.regexp_extract("part_name", r"(\d+)$", 1).try_cast("int").alias("page_number"), "id", "risk").groupBy("document_id", "page_number").agg(F.count("id").alias("findings"), F.count_if(F.col("risk") == "CRITICAL").alias("critical"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _pages(spark, sf_dir).select("id", "document_id", "page_number").join(f, ["document_id", "page_number"], "left").select("id", z("findings"), z("critical"))


PAGE_FINDINGS = rf"""
SELECT p.id, coalesce(f.n, 0) AS findings, coalesce(f.c, 0) AS critical FROM {_PAGES} p LEFT JOIN (SELECT document_id, try_cast(regexp_extract(part_name, '(\d+)$', 1) AS INT) AS page_number, count(*) AS n, count(*) FILTER (risk = 'CRITICAL') AS c
FROM {FI} WHERE part_name LIKE 'ocr_page_%' GROUP BY ALL) f ON f.document_id = p.document_id AND f.page_number = p.page_number
"""


def review_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings still open with their document, matter and the document's latest reviewed page; ``place`` is the row's in
    its document (risk as text, falling, then the id)."""
    f = _findings(spark, sf_dir).where(PENDING).select("id", "document_id", "category", "risk")
    latest = _pages(spark, sf_dir).where("reviewed_at is not null").groupBy("document_id").agg(F.max_by("id", F.struct("reviewed_at", "id")).alias("page_id"))
    # Ranks by two steps: a document's risks are few, and ids within a risk go by stretches.
    f = numbers(f.withColumn("stretch", F.struct((-F.ascii("risk")).alias("r"), F.col("risk"), F.floor(F.col("id") / 65_536).alias("i"))).withColumn("o", F.col("id")), ["document_id"], "stretch", "o")
    j = f.join(_matters(spark, sf_dir).select(F.col("id").alias("document_id"), "filename", "matter"), "document_id").join(latest, "document_id", "left")
    return j.select("id", "filename", "matter", "category", "risk", "page_id", F.col("number").cast("long").alias("place"))


MATRIX = f"""
SELECT f.id, d.filename, d.matter, f.category, f.risk, p.page_id, row_number() OVER (PARTITION BY f.document_id ORDER BY ascii(f.risk) DESC, f.risk, f.id) AS place
FROM (SELECT * FROM {FI} WHERE {PENDING}) f JOIN {_M} d ON d.id = f.document_id
LEFT JOIN (SELECT document_id, id AS page_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY reviewed_at DESC, id DESC) AS n FROM {_PAGES} WHERE reviewed_at IS NOT NULL) WHERE n = 1) p ON p.document_id = f.document_id
"""


def seeded_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of no client put into the one matter there is for them: a cross join with one row."""
    one = spark.createDataFrame([("Unassigned",)], "matter string")
    return _docs(spark, sf_dir).where("client_id is null").select("id").crossJoin(F.broadcast(one))


SEEDED = f"SELECT id, 'Unassigned' AS matter FROM {D} WHERE client_id IS NULL"


def latest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page a finding stands on; of pages scanned again the last one."""
    p = _pages(spark, sf_dir).groupBy("document_id", "page_number").agg(F.max_by("id", F.struct("created_at", "id")).alias("page_id"))
    f = _findings(spark, sf_dir).where("part_name like 'ocr_page_%'").withColumn("page_number", F.regexp_extract("part_name", r"(\d+)$", 1).try_cast("int"))
    return f.join(p, ["document_id", "page_number"], "left").select("id", "page_id")


EVIDENCE = rf"SELECT f.id, p.page_id FROM (SELECT *, try_cast(regexp_extract(part_name, '(\d+)$', 1) AS INT) AS n FROM {FI} WHERE part_name LIKE 'ocr_page_%') f LEFT JOIN (SELECT document_id, page_number, arg_max(id, (created_at, id)) AS page_id FROM {_PAGES} GROUP BY ALL) p ON p.document_id = f.document_id AND p.page_number = f.n"


def matter_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and pages of each matter, added up before they are joined; beside them what joining first would count,
    every finding of a document once for each of its pages."""
    m = _matters(spark, sf_dir).select("id", "matter")
    f = _findings(spark, sf_dir).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("f"))
    p = _pages(spark, sf_dir).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("p"))
    j = m.join(f, "id", "left").join(p, "id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.groupBy("matter").agg(F.sum(z("f")).alias("findings"), F.sum(z("p")).alias("pages"), F.sum(z("f") * F.greatest(z("p"), F.lit(1))).alias("findings_fanout"))


DETAIL = f"""
SELECT d.matter, CAST(sum(coalesce(f.n, 0)) AS BIGINT) AS findings, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS pages, CAST(sum(coalesce(f.n, 0) * greatest(coalesce(p.n, 0), 1)) AS BIGINT) AS findings_fanout
FROM {_M} d LEFT JOIN (SELECT document_id, count(*) AS n FROM {FI} GROUP BY 1) f ON f.document_id = d.id LEFT JOIN (SELECT document_id, count(*) AS n FROM {_PAGES} GROUP BY 1) p ON p.document_id = d.id GROUP BY d.matter
"""


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document by status, and by source."""
    by = lambda c, v, n: F.count_if(F.col(c) == v).alias(n)
    return _pages(spark, sf_dir).groupBy("document_id").agg(by("status", "completed", "completed"), by("status", "accepted", "accepted"), by("status", "failed", "failed"), by("source", "local", "local"), by("source", "reviewer_supplied", "supplied"))


PAGE_SUMMARY = "SELECT document_id, " + ", ".join(f"count(*) FILTER ({c} = '{v}') AS {n}" for c, v, n in (("status", "completed", "completed"), ("status", "accepted", "accepted"), ("status", "failed", "failed"), ("source", "local", "local"), ("source", "reviewer_supplied", "supplied"))) + f" FROM {_PAGES} GROUP BY document_id"


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan found: documents by risk and by state of extraction, and all of them, in one pass."""
    d = _docs(spark, sf_dir)
    return d.cube("residual_risk", "extraction_status").agg(F.count("*").alias("documents"), F.grouping_id().alias("g")).where("g > 0").select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "risk").otherwise("extraction").alias("by"), F.coalesce("residual_risk", "extraction_status").alias("value"), "documents")


SCAN_REPORT = f"SELECT 'all' AS \"by\", NULL AS value, count(*) AS documents FROM {D} UNION ALL SELECT 'risk', residual_risk, count(*) FROM {D} GROUP BY residual_risk UNION ALL SELECT 'extraction', extraction_status, count(*) FROM {D} GROUP BY extraction_status"


def canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the documents whose name is like one pattern have findings of the kinds expected of them."""
    d = _docs(spark, sf_dir).where("filename ilike 'dosya_2020_%'").select("id")
    f = _findings(spark, sf_dir).join(d.withColumnRenamed("id", "document_id"), "document_id", "left_semi").agg(F.count("*").alias("findings"), F.count_if(F.col("risk") == "CRITICAL").alias("critical"), F.count_if(F.col("category") == "natural_person_name").alias("people"))
    return f.select("findings", "critical", "people", ((F.col("critical") > 0) & (F.col("people") > 0)).alias("passed"))


CANARY = f"SELECT count(*) AS findings, count(*) FILTER (risk = 'CRITICAL') AS critical, count(*) FILTER (category = 'natural_person_name') AS people, count(*) FILTER (risk = 'CRITICAL') > 0 AND count(*) FILTER (category = 'natural_person_name') > 0 AS passed FROM {FI} WHERE document_id IN (SELECT id FROM {D} WHERE filename ILIKE 'dosya_2020_%')"


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels of the gold texts in the categories whose rules both dialects read alike, and what these rules find."""
    g = table(spark, sf_dir, "gold_labels")
    labels = g.select("id", F.posexplode("labels").alias("i", "x")).where(F.col("x.category").isin(*PLAIN)).select("id", "x.category", F.concat_ws("/", "id", F.col("i").cast("string")).alias("label_id"), F.col("x.text").alias("label"), F.coalesce("x.required", F.lit(True)).alias("required"))
    each = [f"transform({matches_sql('ocr_text', '(?iuU)' + PATTERNS[c])}, m -> named_struct('category', '{c}', 'value', m.value))" for c in PLAIN]
    found = g.where("ocr_text is not null").select("id", F.posexplode(F.expr(f"concat({', '.join(each)})")).alias("i", "x")).select("id", "x.category", F.concat_ws("/", "id", F.col("i").cast("string")).alias("finding_id"), F.col("x.value").alias("sample"))
    return labels, found


def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision over all gold texts, of required labels and of all findings; labels missed; and texts of which
    labels are missed."""
    labels, found = _gold(spark, sf_dir)
    m = matched(labels, found, "id")
    required = labels.where("required")
    hit = required.join(m.select("label_id").distinct().withColumn("hit", F.lit(1)), "label_id", "left").agg(F.count("*").alias("labels"), F.count("hit").alias("found"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("id"))).alias("texts_missed"))
    right = found.join(m.select("finding_id").distinct().withColumn("right", F.lit(1)), "finding_id", "left").agg(F.count("*").alias("findings"), F.count("right").alias("right"))
    return hit.crossJoin(right).select("labels", "found", (F.col("labels") - F.col("found")).alias("missed"), "texts_missed", "findings", (F.col("findings") - F.col("right")).alias("false_positives"), safe_divide(F.col("found"), F.col("labels")).alias("recall"), safe_divide(F.col("right"), F.col("findings")).alias("precision"))


_KEY = "trim(lower(regexp_replace({0}, '\\s+', ' ', 'g')))"
_FOUND = " UNION ALL ".join("SELECT id, '{0}' AS category, i, v[i] AS sample FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT id, regexp_extract_all(ocr_text, '{1}', 0, 'i') AS v FROM gold_labels WHERE ocr_text IS NOT NULL))".format(c, PATTERNS[c].replace("'", "''")) for c in PLAIN)
METRICS = f"""
WITH l AS (SELECT id, i, labels[i].category AS category, labels[i].text AS label, coalesce(labels[i].required, true) AS required FROM (SELECT id, labels, unnest(range(1, len(labels) + 1)) AS i FROM gold_labels) WHERE labels[i].category IN ({', '.join(f"'{c}'" for c in PLAIN)})),
f AS ({_FOUND}),
m AS (SELECT l.id, l.i AS li, f.category, f.i AS fi FROM l JOIN f ON l.id = f.id AND l.category = f.category WHERE {_KEY.format('label')} <> '' AND (contains({_KEY.format('sample')}, {_KEY.format('label')}) OR contains({_KEY.format('label')}, {_KEY.format('sample')}))),
h AS (SELECT l.*, EXISTS (SELECT 1 FROM m WHERE m.id = l.id AND m.li = l.i) AS hit FROM l WHERE required),
c AS (SELECT (SELECT count(*) FROM h) AS labels, (SELECT count(*) FROM h WHERE hit) AS found, (SELECT count(DISTINCT id) FROM h WHERE NOT hit) AS texts_missed, (SELECT count(*) FROM f) AS findings, (SELECT count(*) FROM (SELECT DISTINCT id, category, fi FROM m)) AS r)
SELECT labels, found, labels - found AS missed, texts_missed, findings, findings - r AS false_positives, coalesce(round(found / nullif(labels, 0), 4), 0) AS recall, coalesce(round(r / nullif(findings, 0), 4), 0) AS "precision" FROM c
"""


def risk_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold texts whose risk as found (critical or high identifiers make it High, any other finding Medium) is below the
    one expected."""
    labels, found = _gold(spark, sf_dir)
    high = F.col("category").isin(*(r.category for r in RULES if r.risk in ("HIGH", "CRITICAL")))
    got = found.groupBy("id").agg(F.max(F.when(high, 3).otherwise(2)).alias("got"))
    want = table(spark, sf_dir, "gold_labels").where("ocr_text is not null").select("id", rank_of(F.col("expected_residual_risk"), RESIDUAL, 0).alias("want"))
    return want.join(got, "id", "left").select("id", "want", F.coalesce("got", F.lit(1)).alias("got")).where("got < want and want < 4")


_HIGH = ", ".join(sorted({f"'{r.category}'" for r in RULES if r.risk in ("HIGH", "CRITICAL")}))
SHORTFALL = f"""
WITH f AS ({_FOUND}), g AS (SELECT id, max(CASE WHEN category IN ({_HIGH}) THEN 3 ELSE 2 END) AS got FROM f GROUP BY id),
w AS (SELECT id, CASE expected_residual_risk WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Unknown' THEN 4 ELSE 0 END AS want FROM gold_labels WHERE ocr_text IS NOT NULL)
SELECT w.id, want, coalesce(got, 1) AS got FROM w LEFT JOIN g ON g.id = w.id WHERE coalesce(got, 1) < want AND want < 4
"""


def pipeline_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings a document and characters a page over the whole catalog."""
    f = _findings(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("documents"), F.sum("n").alias("findings"), F.round(F.sum("n") / F.count("*"), 4).alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"))
    p = _pages(spark, sf_dir).where("text is not null").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
    return f.crossJoin(p)


FIGURES = f"WITH f AS (SELECT document_id, count(*) AS n FROM {FI} GROUP BY 1), p AS (SELECT count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM {_PAGES} WHERE text IS NOT NULL) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS findings, round(sum(n) / count(*), 4) AS mean, median(n) AS median, max(n) AS most, any_value(pages) AS pages, any_value(chars) AS chars FROM f, p"


def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest risk of each document, and whether any finding is critical."""
    rank = rank_of(F.col("risk"), ("LOW", "MEDIUM", "HIGH", "CRITICAL"), 0)
    return _findings(spark, sf_dir).groupBy("document_id").agg(F.max(rank).alias("highest"), F.bool_or(F.col("risk") == "CRITICAL").alias("any_critical"), F.count_if(F.col("review_status") == "retained").alias("retained"))


FLAGS = f"SELECT document_id, max(CASE risk WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END) AS highest, bool_or(risk = 'CRITICAL') AS any_critical, count(*) FILTER (review_status = 'retained') AS retained FROM {FI} GROUP BY document_id"

#: Seconds in which failures are counted here, as those of the test table lie far apart; failures allowed of an account at
#: one address, and of an address.
WINDOW, PAIR, ADDRESS = 5 * 86_400, 2, 20


def login_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that reach the cap of their account at one address, or of their address, within the window."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("address"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    over = lambda *keys: Window.partitionBy(*keys).orderBy("at").rangeBetween(-WINDOW, 0)
    r = e.withColumn("pair", F.count("*").over(over("user_id", "address"))).withColumn("of_address", F.count("*").over(over("address"))).withColumn("first", F.min("at").over(over("user_id", "address")))
    return r.where((F.col("pair") >= PAIR) | (F.col("of_address") >= ADDRESS)).select("event_id", "pair", "of_address", F.greatest(F.lit(0), WINDOW - (F.col("at") - F.col("first"))).cast("long").alias("remaining"))


CAPS = f"""
WITH e AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS address, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE event_type = 'error'),
r AS (SELECT *, count(*) OVER p AS pair, min(sec) OVER p AS earliest, count(*) OVER (PARTITION BY address ORDER BY sec RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW) AS of_address FROM e WINDOW p AS (PARTITION BY user_id, address ORDER BY sec RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW))
SELECT event_id, pair, of_address, CAST(greatest(0, {WINDOW} - (sec - earliest)) AS BIGINT) AS remaining FROM r WHERE pair >= {PAIR} OR of_address >= {ADDRESS}
"""


def supplied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as reviewers send them, a JSON array a document, read back; blank ones are dropped."""
    p = _pages(spark, sf_dir).where("source = 'reviewer_supplied'")
    sent = p.groupBy("document_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("page_number").alias("page"), F.col("text"))))).alias("body"))
    read = sent.select("document_id", F.explode(F.from_json("body", "array<struct<id:bigint,page:int,text:string>>")).alias("x")).select("document_id", "x.*")
    return read.where("trim(text) <> ''").select("id", "document_id", "page", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


SUPPLIED = f"SELECT id, document_id, page_number AS page, length(text) AS chars, sha256(text) AS digest FROM {_PAGES} WHERE source = 'reviewer_supplied' AND trim(text) <> ''"


def text_or_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text: its accepted pages in order, or else what was extracted from the file (here its title)."""
    t = _pages(spark, sf_dir).where("status = 'accepted' and text is not null").groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "id", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    return _docs(spark, sf_dir).select("id", "title").join(t, "id", "left").select("id", F.col("t").isNotNull().alias("scanned"), F.sha2(F.coalesce("t", "title"), 256).alias("digest"))


TEXTS = f"SELECT d.id, t IS NOT NULL AS scanned, sha256(coalesce(t, title)) AS digest FROM {D} d LEFT JOIN (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number, id) AS t FROM {_PAGES} WHERE status = 'accepted' AND text IS NOT NULL GROUP BY document_id) p ON p.document_id = d.id"


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's findings after it is scanned again: the detector's are gone but for what reviewers added, and what the
    e-mail rule finds in its pages now is there, pending."""
    kept = _findings(spark, sf_dir).where("coalesce(source, '') not in ('detector', 'ocr')").select("document_id", "category", "sample", "review_status")
    new = _pages(spark, sf_dir).where("text is not null").select("document_id", F.explode(F.expr(matches_sql("text", "(?iuU)" + PATTERNS["email_address"]))).alias("m")).select("document_id", F.lit("email_address").alias("category"), F.col("m.value").alias("sample"), F.lit("pending").alias("review_status"))
    return kept.unionByName(new).groupBy("document_id", "category", "review_status").agg(F.count("*").alias("findings"), F.count_distinct("sample").alias("samples"))


REPLACED = f"""
SELECT document_id, category, review_status, count(*) AS findings, count(DISTINCT sample) AS samples FROM (SELECT document_id, category, sample, review_status FROM {FI} WHERE coalesce(source, '') NOT IN ('detector', 'ocr')
UNION ALL SELECT document_id, 'email_address', unnest(regexp_extract_all(text, '{PATTERNS["email_address"]}', 0, 'i')), 'pending' FROM {_PAGES} WHERE text IS NOT NULL) GROUP BY ALL
"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matters after some documents were given to others: the assignment made last stays, the new one on a tie."""
    old = _matters(spark, sf_dir).select("id", "matter", F.col("created_at").alias("at"))
    new = _docs(spark, sf_dir).where("reviewed_at is not null").select("id", F.lit("Reviewed").alias("matter"), F.col("reviewed_at").alias("at"))
    return sinks.upserted(old, new, ["id"], [F.col("at")]).select("id", "matter")


ASSIGNED = f"SELECT id, CASE WHEN reviewed_at >= created_at THEN 'Reviewed' ELSE matter END AS matter FROM {_M}"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upload writes: the document, its assignment and its first artifact, each path once."""
    d = _matters(spark, sf_dir).groupBy("filepath").agg(F.min("id").alias("id"), F.min_by("matter", "id").alias("matter"))
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"))
    return d.select("id", F.inline(F.array(row("document", "filepath"), row("matter", "matter"), row("original_upload", "filepath"))))


UPLOADS = f"WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY id) AS n FROM {_M}) WHERE n = 1) SELECT id, 'document' AS kind, filepath AS value FROM d UNION ALL SELECT id, 'matter', matter FROM d UNION ALL SELECT id, 'original_upload', filepath FROM d"


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's entries as written: blocked keys hidden, values cut; the action stands beside its metadata."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("m"))
    e = e.withColumn("m", F.map_concat("m", F.create_map(F.lit("token"), F.lit("t"), F.lit("note"), F.repeat("event_type", F.lit(60)))))
    s = tx.sanitize_metadata(F.col("m"))
    return e.select("event_id", s["k"].alias("k"), s["token"].alias("token"), s["note"].alias("note"))


ENTRIES = "SELECT event_id, json_extract_string(props, '$.k') AS k, '[redacted]' AS token, left(repeat(event_type, 60), 200) AS note FROM events"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's life as appended rows: filed, pages scanned, pages reviewed, document reviewed."""
    d, p = _docs(spark, sf_dir), _pages(spark, sf_dir)
    row = lambda df, doc, at, kind: df.where(f"{at} is not null").select(F.col(doc).alias("document_id"), F.col(at).alias("at"), F.lit(kind).alias("kind"))
    return reduce(DataFrame.unionByName, (row(d, "id", "created_at", "filed"), row(p, "document_id", "created_at", "scanned"), row(p, "document_id", "reviewed_at", "page_reviewed"), row(d, "id", "reviewed_at", "reviewed"))).groupBy("document_id", "kind").agg(F.count("*").alias("entries"), F.max("at").alias("last"))


TIMELINE = f"""
SELECT document_id, kind, count(*) AS entries, max(moment) AS last FROM (SELECT id AS document_id, created_at AS moment, 'filed' AS kind FROM {D} UNION ALL SELECT document_id, created_at, 'scanned' FROM {_PAGES} UNION ALL SELECT document_id, reviewed_at, 'page_reviewed' FROM {_PAGES}
UNION ALL SELECT id, reviewed_at, 'reviewed' FROM {D}) WHERE moment IS NOT NULL GROUP BY ALL
"""


def matters_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred matters: Unassigned last, the latest first, then by name."""
    m = _matters(spark, sf_dir).groupBy("matter").agg(F.max("created_at").alias("updated"), F.count("*").alias("documents"))
    return m.orderBy((F.col("matter") == "Unassigned").cast("int"), F.col("updated").desc(), "matter").limit(100)


IN_ORDER = f"SELECT matter, max(created_at) AS updated, count(*) AS documents FROM {_M} GROUP BY matter ORDER BY (matter = 'Unassigned')::INT, updated DESC, matter LIMIT 100"


def findings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding's place in its document: by its start, none counting as 0, then by the id."""
    f = _findings(spark, sf_dir).select("id", "document_id", F.coalesce("start_offset", F.lit(0)).alias("s"))
    f = f.withColumn("stretch", F.floor(F.col("s") / 256)).withColumn("o", F.struct("s", "id"))
    return numbers(f, ["document_id"], "stretch", "o").select("id", F.col("number").cast("long").alias("place"))


PLACES = f"SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(start_offset, 0), id) AS place FROM {FI}"


def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that only the detector or only reviewers have findings in (set differences), with the texts of either (union)
    and all rows (bag union)."""
    f = _findings(spark, sf_dir)
    part = lambda where: f.where(where).select("document_id", "part_name")
    a, b = part("source in ('detector', 'ocr')"), part("source = 'manual'")
    named = lambda df, kind: df.withColumn("kind", F.lit(kind))
    sets = named(a.distinct().subtract(b), "missing").unionByName(named(b.distinct().subtract(a), "added")).unionByName(named(a.union(b).distinct(), "either")).unionByName(named(a.unionAll(b), "all"))
    return sets.groupBy("kind").agg(F.count("*").alias("parts"), F.count_distinct("document_id").alias("documents"))


PART_SETS = f"""
WITH a AS (SELECT document_id, part_name FROM {FI} WHERE source IN ('detector', 'ocr')), b AS (SELECT document_id, part_name FROM {FI} WHERE source = 'manual'),
s AS (SELECT *, 'missing' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'either' FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT *, 'all' FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT kind, count(*) AS parts, count(DISTINCT document_id) AS documents FROM s GROUP BY kind
"""


def manual_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of findings that reviewers added."""
    f = _findings(spark, sf_dir).where("source = 'manual' and sample is not null")
    return f.select("id", tx.manual_fingerprint(F.col("document_id"), F.col("category"), F.col("sample")).alias("own"))


MANUAL = f"SELECT id, sha256(lower(replace(concat_ws(':', CAST(document_id AS VARCHAR), category, sample), 'İ', 'i̇'))) AS own FROM {FI} WHERE source = 'manual' AND sample IS NOT NULL"


def failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the checks a document fails, in their order."""
    d = _docs(spark, sf_dir)
    checks = F.array(*(F.struct(F.lit(n).alias("name"), F.expr(c).alias("ok")) for n, c in CHECKS.items()))
    return d.select("id", F.array_join(F.transform(F.filter(checks, lambda x: ~x["ok"]), lambda x: x["name"]), ",").alias("failed")).where("failed <> ''")


CHECKS = {"extracted": "coalesce(extraction_status = 'Good', false)", "client": "client_id IS NOT NULL", "language": "coalesce(language <> '', false)", "size": "coalesce(file_size > 0, false)"}
FAILED = f"SELECT id, failed FROM (SELECT id, concat_ws(',', {', '.join(f'''CASE WHEN NOT ({c}) THEN '{n}' END''' for n, c in CHECKS.items())}) AS failed FROM {D}) WHERE failed <> ''"


def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, total, mean, median and most of file sizes, by extension."""
    return _docs(spark, sf_dir).where("file_size is not null").groupBy("file_extension").agg(F.count("*").alias("documents"), F.sum("file_size").alias("total"), F.round(F.sum("file_size") / F.count("*"), 4).alias("mean"), F.median("file_size").alias("median"), F.max("file_size").alias("most"))


SIZES = f"SELECT file_extension, count(*) AS documents, CAST(sum(file_size) AS BIGINT) AS total, round(sum(file_size) / count(*), 4) AS mean, median(file_size) AS median, max(file_size) AS most FROM {D} WHERE file_size IS NOT NULL GROUP BY file_extension"

QUERIES = {
    "listing_joined": (listing_joined, LISTING), "matter_documents": (matter_documents, MATTER_DOCUMENTS), "page_findings": (page_findings, PAGE_FINDINGS), "review_matrix": (review_matrix, MATRIX), "seeded_matters": (seeded_matters, SEEDED),
    "latest_evidence": (latest_evidence, EVIDENCE), "matter_detail": (matter_detail, DETAIL), "page_summary": (page_summary, PAGE_SUMMARY), "scan_report": (scan_report, SCAN_REPORT), "canary": (canary, CANARY), "audit_metrics": (audit_metrics, METRICS),
    "risk_shortfall": (risk_shortfall, SHORTFALL), "pipeline_figures": (pipeline_figures, FIGURES), "risk_flags": (risk_flags, FLAGS), "login_caps": (login_caps, CAPS), "supplied_pages": (supplied_pages, SUPPLIED), "text_or_title": (text_or_title, TEXTS),
    "replaced": (replaced, REPLACED), "assigned": (assigned, ASSIGNED), "uploads": (uploads, UPLOADS), "audit_entries": (audit_entries, ENTRIES), "timeline": (timeline, TIMELINE), "matters_in_order": (matters_in_order, IN_ORDER),
    "findings_in_order": (findings_in_order, PLACES), "part_sets": (part_sets, PART_SETS), "manual_fingerprints": (manual_fingerprints, MANUAL), "failed_checks": (failed_checks, FAILED), "size_summary": (size_summary, SIZES),
}


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: s for k, (_, s) in QUERIES.items()}
