"""Queries of the catalog: listings, rollups, latest rows, set differences, search, logs.

The test tables stand for the catalog's: ``case_documents`` for documents, ``clients``, ``privacy_findings``, ``ocr_pages``
as named; ``events`` for the audit log and failed logins (user_id the account, event_type the action, ts the time); a
matter is a client's category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.functions import text as tx
from docveil.operators.containment import held
from docveil.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "case_documents").dropDuplicates(["id"])


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clients").select("id", "name").dropDuplicates(["id"])


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "privacy_findings").dropDuplicates(["id"])


D = "(SELECT DISTINCT * FROM case_documents)"
C = "(SELECT DISTINCT id, name FROM clients)"
FI = "(SELECT DISTINCT * FROM privacy_findings)"
PENDING = "coalesce(review_status, 'pending') NOT IN ('approved', 'added_by_reviewer', 'dismissed', 'retained')"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their client and counts of findings, aggregated before the join. Risk is sorted as text."""
    counts = _findings(spark, sf_dir).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("findings"), F.count_if(F.col("risk") == "CRITICAL").alias("critical"), F.count_if(F.expr(PENDING)).alias("unresolved"))
    d = _docs(spark, sf_dir).join(_clients(spark, sf_dir).select(F.col("id").alias("client_id"), F.col("name").alias("client")), "client_id", "left").join(counts, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("id", "filename", "client", "category", "residual_risk", tx.size_label(F.col("file_size")).alias("size"), zero("findings"), zero("critical"), zero("unresolved"))


LISTING = f"""
SELECT d.id, d.filename, c.name AS client, d.category, d.residual_risk,
  CASE WHEN file_size > 1048576 THEN printf('%.1f MB', file_size / 1048576.0) WHEN file_size > 1024 THEN printf('%.0f KB', file_size / 1024.0) ELSE printf('%d B', file_size) END AS size,
  coalesce(f.findings, 0) AS findings, coalesce(f.critical, 0) AS critical, coalesce(f.unresolved, 0) AS unresolved
FROM {D} d LEFT JOIN {C} c ON c.id = d.client_id
LEFT JOIN (SELECT document_id, count(*) AS findings, count(*) FILTER (risk = 'CRITICAL') AS critical, count(*) FILTER ({PENDING}) AS unresolved FROM {FI} GROUP BY document_id) f ON f.document_id = d.id
"""


def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20, with the number of all rows and pages; the count needs no join."""
    d = _docs(spark, sf_dir)
    total = d.agg(F.count("*").alias("total"))
    page = d.orderBy(F.col("residual_risk").desc(), "category", "filename", "id").select("id", "filename", "residual_risk").offset(40).limit(20)
    return page.crossJoin(F.broadcast(total)).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 20)).cast("long"))


LISTING_PAGE = f"WITH d AS {D}, t AS (SELECT count(*) AS total FROM d) SELECT p.id, filename, residual_risk, total, CAST(greatest(1, ceil(total / 20.0)) AS BIGINT) AS pages FROM (SELECT id, filename, residual_risk FROM d ORDER BY residual_risk DESC, category, filename, id LIMIT 20 OFFSET 40) p, t"


def listing_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where((F.col("category") == "litigation") & F.col("residual_risk").isin("High", "Unknown") & (tx.extension(F.col("filename")) == ".pdf") & F.col("review_status").ilike("pending%"))
    return d.select("id", "filename", "category", "residual_risk", "review_status")


FILTERED = f"SELECT id, filename, category, residual_risk, review_status FROM {D} WHERE category = 'litigation' AND residual_risk IN ('High', 'Unknown') AND lower(filename) LIKE '%.pdf' AND review_status ILIKE 'pending%'"


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.agg(
        F.count("*").alias("documents"), F.count_distinct("client_id").alias("clients"), F.count_distinct("category").alias("categories"), F.count_if(F.col("residual_risk") == "High").alias("high"),
        F.count_if(F.col("extraction_status") != "Good").alias("not_extracted"), F.count_if(F.col("ocr_status") == "accepted").alias("ocr_accepted"), F.count_if(F.col("review_status").like("pending%")).alias("pending"), F.sum("file_size").alias("bytes"),
    )


DASHBOARD = f"""
SELECT count(*) AS documents, count(DISTINCT client_id) AS clients, count(DISTINCT category) AS categories, count(*) FILTER (residual_risk = 'High') AS high, count(*) FILTER (extraction_status <> 'Good') AS not_extracted,
  count(*) FILTER (ocr_status = 'accepted') AS ocr_accepted, count(*) FILTER (review_status LIKE 'pending%') AS pending, CAST(sum(file_size) AS BIGINT) AS bytes FROM {D}
"""


def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("category").agg(F.count("*").alias("documents"), F.count_distinct("client_id").alias("clients"), F.sum("file_size").alias("bytes")).where("documents > 0")


CATEGORY_STATS = f"SELECT category, count(*) AS documents, count(DISTINCT client_id) AS clients, CAST(sum(file_size) AS BIGINT) AS bytes FROM {D} GROUP BY category HAVING count(*) > 0"


def client_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("documents"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    return _clients(spark, sf_dir).join(d, F.col("id") == F.col("client_id")).select("id", "name", "documents", "categories")


CLIENT_STATS = f"SELECT c.id, c.name, count(*) AS documents, string_agg(DISTINCT d.category, ',' ORDER BY d.category) AS categories FROM {C} c JOIN {D} d ON d.client_id = c.id GROUP BY c.id, c.name"


def top_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client_stats(spark, sf_dir).orderBy(F.col("documents").desc(), "id").limit(20).select("id", "name", "documents")


TOP_CLIENTS = f"SELECT c.id, c.name, count(*) AS documents FROM {C} c JOIN {D} d ON d.client_id = c.id GROUP BY c.id, c.name ORDER BY documents DESC, c.id LIMIT 20"


def ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document: their number, characters, mean confidence (whole decimals, so that the order of adding does
    not matter), and how many a reviewer supplied."""
    p = table(spark, sf_dir, "ocr_pages").dropDuplicates(["id"])
    return p.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.round(F.sum(F.round(F.col("confidence") * 10_000).cast("long")) / F.count("confidence"), 2).alias("confidence"), F.count_if(F.col("source") == "reviewer_supplied").alias("supplied"))


OCR_SUMMARY = "SELECT document_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, round(CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS DOUBLE) / nullif(count(confidence), 0), 2) AS confidence, count(*) FILTER (source = 'reviewer_supplied') AS supplied FROM (SELECT DISTINCT * FROM ocr_pages) GROUP BY document_id"


def finding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return f.groupBy("category", "risk").agg(F.count("*").alias("findings"), F.count_if(F.expr(PENDING)).alias("unresolved"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_distinct("document_id").alias("documents"))


MATRIX = f"SELECT category, risk, count(*) AS findings, count(*) FILTER ({PENDING}) AS unresolved, count(*) FILTER (review_status = 'approved') AS approved, count(DISTINCT document_id) AS documents FROM {FI} GROUP BY category, risk"


def matter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts per matter (client and category), some of them conditional; findings are aggregated first, so
    that joins do not multiply them."""
    f = _findings(spark, sf_dir).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("findings"), F.count_if(F.expr(PENDING)).alias("unresolved"))
    d = _docs(spark, sf_dir).join(f, "id", "left")
    return d.groupBy("client_id", "category").agg(
        F.count_distinct("id").alias("documents"), F.count_distinct(F.when(F.col("residual_risk") == "High", F.col("id"))).alias("high"), F.count_distinct(F.when(F.col("unresolved") > 0, F.col("id"))).alias("open"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings")
    )


MATTERS = f"""
SELECT client_id, category, count(DISTINCT id) AS documents, count(DISTINCT CASE WHEN residual_risk = 'High' THEN id END) AS high, count(DISTINCT CASE WHEN unresolved > 0 THEN id END) AS open, CAST(coalesce(sum(findings), 0) AS BIGINT) AS findings
FROM {D} d LEFT JOIN (SELECT document_id, count(*) AS findings, count(*) FILTER ({PENDING}) AS unresolved FROM {FI} GROUP BY document_id) f ON f.document_id = d.id GROUP BY client_id, category
"""


def latest_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finding of each document; late rows count by their time, ties by the id."""
    return _findings(spark, sf_dir).groupBy("document_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max_by("category", F.struct("created_at", "id")).alias("category"))


LATEST = f"SELECT document_id, id, category FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS n FROM {FI}) WHERE n = 1"


def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages scanned again replace earlier scans of the same page."""
    p = table(spark, sf_dir, "ocr_pages").dropDuplicates(["id"])
    w = Window.partitionBy("document_id", "page_number").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").select("document_id", "page_number", "id", F.length("text").alias("chars"))


LATEST_PAGE = "SELECT document_id, page_number, id, CAST(length(text) AS INT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY created_at DESC, id DESC) AS n FROM (SELECT DISTINCT * FROM ocr_pages)) WHERE n = 1"


def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pages of a document in order, joined by an empty line."""
    p = table(spark, sf_dir, "ocr_pages").dropDuplicates(["id"]).where("status = 'accepted' and text is not null")
    t = p.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "id", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    return t.select("document_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


SOURCE_TEXT = "SELECT document_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number, id) AS t FROM (SELECT DISTINCT * FROM ocr_pages) WHERE status = 'accepted' AND text IS NOT NULL GROUP BY document_id)"


def unassigned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a known client."""
    return _docs(spark, sf_dir).join(_clients(spark, sf_dir).select(F.col("id").alias("client_id")), "client_id", "left_anti").select("id", "filename")


UNASSIGNED = f"SELECT id, filename FROM {D} d WHERE NOT EXISTS (SELECT 1 FROM {C} c WHERE c.id = d.client_id)"


def reviewed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one finding a reviewer added (semi join)."""
    f = _findings(spark, sf_dir).where("source = 'manual'").select(F.col("document_id").alias("id"))
    return _docs(spark, sf_dir).join(f, "id", "left_semi").select("id", "filename")


REVIEWED = f"SELECT id, filename FROM {D} d WHERE id IN (SELECT document_id FROM privacy_findings WHERE source = 'manual')"


def inserted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or ignore: each category of a document's findings once, unless the document's own category is the same."""
    new = table(spark, sf_dir, "privacy_findings").select(F.col("document_id").alias("id"), F.col("category").alias("tag")).distinct()
    return new.join(_docs(spark, sf_dir).select("id", F.col("category").alias("tag")), ["id", "tag"], "left_anti")


TAGS = f"SELECT DISTINCT document_id AS id, category AS tag FROM privacy_findings f WHERE NOT EXISTS (SELECT 1 FROM {D} d WHERE d.id = f.document_id AND d.category = f.category)"


def redaction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts to redact per document, with what replaces them: a reviewer's text, else the placeholder, else a
    plain mark; empty counts as missing."""
    f = _findings(spark, sf_dir).where("review_status in ('approved', 'added_by_reviewer') and sample <> ''")
    r = F.coalesce(F.nullif("replacement_text", F.lit("")), F.nullif("placeholder", F.lit("")), F.lit("[REDACTED]"))
    return f.select("document_id", "sample", r.alias("replacement")).distinct()


TARGETS = "SELECT DISTINCT document_id, sample, coalesce(nullif(replacement_text, ''), nullif(placeholder, ''), '[REDACTED]') AS replacement FROM privacy_findings WHERE review_status IN ('approved', 'added_by_reviewer') AND sample <> ''"


def leaked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples not dismissed or retained that still stand, case and diacritics aside, in a page of their document."""
    f = table(spark, sf_dir, "privacy_findings").where("sample <> '' and (review_status is null or review_status not in ('dismissed', 'retained'))").select("document_id", tx.search_fold(F.col("sample")).alias("n")).distinct()
    p = table(spark, sf_dir, "ocr_pages").where("text is not null").dropDuplicates(["id"]).select("document_id", "id", tx.search_fold(F.col("text")).alias("t"))
    return held(p, "id", f, ["document_id"]).groupBy("document_id").agg(F.count_distinct("n").alias("leaked"), F.count_distinct("id").alias("pages"))


_FOLD = "lower(translate({0}, 'âÂçÇğĞıİIîÎöÖşŞüÜûÛ', 'aaccggiiiiioossuuuu'))"
LEAKED = f"""
WITH f AS (SELECT DISTINCT document_id, {_FOLD.format('sample')} AS needle FROM privacy_findings WHERE sample <> '' AND (review_status IS NULL OR review_status NOT IN ('dismissed', 'retained'))),
p AS (SELECT document_id, id, {_FOLD.format('text')} AS hay FROM (SELECT DISTINCT * FROM ocr_pages) WHERE text IS NOT NULL)
SELECT document_id, count(DISTINCT needle) AS leaked, count(DISTINCT id) AS pages FROM p JOIN f USING (document_id) WHERE contains(hay, needle) GROUP BY document_id
"""


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored under several ids: one row per text with its least id and number of copies."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


DUPLICATES = "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1"


def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank 95th percentile, median and mean of file sizes per category (whole bytes)."""
    d = _docs(spark, sf_dir).where("file_size is not null").groupBy("category", "file_size").agg(F.count("*").alias("n"))
    # Sizes are counted and their counts added up in stretches: the rows of a category are in no one task.
    d = d.withColumn("stretch", F.floor(F.log2(F.col("file_size") + 1) * 64))
    up = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    per = d.groupBy("category", "stretch").agg(F.sum("n").alias("m")).withColumn("base", F.sum("m").over(up("category").orderBy("stretch")) - F.col("m")).withColumn("all", F.sum("m").over(Window.partitionBy("category"))).drop("m")
    r = d.join(per, ["category", "stretch"]).withColumn("upto", F.col("base") + F.sum("n").over(up("category", "stretch").orderBy("file_size")))
    at = F.bround(F.lit(0.95) * (F.col("all") - 1)).cast("long") + 1
    size_at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("file_size")))
    return r.groupBy("category").agg(
        F.sum("n").alias("documents"), size_at(at).alias("p95"), ((size_at(F.floor((F.col("all") + 1) / 2)) + size_at(F.floor((F.col("all") + 2) / 2))) / 2).alias("median"), F.max("file_size").alias("most"),
    )


PERCENTILES = f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY file_size, id) AS i FROM {D} WHERE file_size IS NOT NULL)
SELECT category, count(*) AS documents, max(CASE WHEN i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1 THEN file_size END) AS p95, median(file_size) AS median, max(file_size) AS most FROM r GROUP BY category
"""


def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 purchases between two dates."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    bounds = e.agg(F.max("ts").alias("hi"))
    return e.crossJoin(F.broadcast(bounds)).where(F.col("ts") >= F.col("hi") - F.expr("INTERVAL 10 DAYS")).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500).select("event_id", "user_id", "ts")


AUDIT = "WITH e AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT event_id, user_id, ts FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 10 DAYS ORDER BY ts DESC, event_id DESC LIMIT 500"


THROTTLE_SECONDS = 5 * 86_400


def login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five failures of one account within a window lock it; what is left of the lock at the fifth is the window less
    the time since the first. A frame over the account's own rows, by time. The window is five days here, as the test
    table's failures lie far apart."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-THROTTLE_SECONDS, 0)
    r = e.withColumn("failures", F.count("*").over(w)).withColumn("first", F.min("at").over(w))
    return r.where("failures >= 5").select("event_id", "user_id", "failures", F.greatest(F.lit(0), F.lit(THROTTLE_SECONDS) - (F.col("at") - F.col("first"))).cast("long").alias("remaining"))


THROTTLE = f"""
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE event_type = 'error'),
r AS (SELECT *, count(*) OVER w AS failures, min(sec) OVER w AS earliest FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN {THROTTLE_SECONDS} PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, failures, CAST(greatest(0, {THROTTLE_SECONDS} - (sec - earliest)) AS BIGINT) AS remaining FROM r WHERE failures >= 5
"""


def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose filename or title has a word that begins with one of the terms."""
    d = _docs(spark, sf_dir)
    folded = tx.search_fold(F.concat_ws(" ", "filename", "title"))
    terms = F.array(F.lit("karar"), F.lit("2024"), F.lit("lease"))
    hit = F.exists(F.split(folded, "[^a-z0-9]+"), lambda w: F.exists(terms, lambda t: w.startswith(t)))
    return d.where(hit).select("id", "filename", "title")


SEARCH = f"SELECT id, filename, title FROM {D} WHERE len(list_filter(string_split_regex({_FOLD.format('concat_ws(chr(32), filename, title)')}, '[^a-z0-9]+'), lambda w: starts_with(w, 'karar') OR starts_with(w, '2024') OR starts_with(w, 'lease'))) > 0"


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases given as JSON arrays, one per row; anything else gives none."""
    c = table(spark, sf_dir, "clients").dropDuplicates(["id"])
    return c.select("id", F.posexplode(F.from_json("aliases", "array<string>")).alias("i", "alias")).select("id", F.col("i").cast("long").alias("i"), "alias")


ALIASES = "SELECT id, i - 1 AS i, a[i] AS alias FROM (SELECT id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT DISTINCT id, CASE WHEN json_valid(aliases) AND json_type(aliases) = 'ARRAY' THEN CAST(json(aliases) AS VARCHAR[]) END AS a FROM clients))"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk and status distribution."""
    return _docs(spark, sf_dir).groupBy("residual_risk", "extraction_status", "ocr_status").agg(F.count("*").alias("documents"))


COHORT = f"SELECT residual_risk, extraction_status, ocr_status, count(*) AS documents FROM {D} GROUP BY ALL"

QUERIES = {
    "listing": (listing, LISTING), "listing_page": (listing_page, LISTING_PAGE), "listing_filtered": (listing_filtered, FILTERED), "dashboard": (dashboard, DASHBOARD), "category_stats": (category_stats, CATEGORY_STATS),
    "client_stats": (client_stats, CLIENT_STATS), "top_clients": (top_clients, TOP_CLIENTS), "ocr_summary": (ocr_summary, OCR_SUMMARY), "finding_matrix": (finding_matrix, MATRIX), "matter_rollup": (matter_rollup, MATTERS),
    "latest_finding": (latest_finding, LATEST), "latest_page": (latest_page, LATEST_PAGE), "source_text": (source_text, SOURCE_TEXT), "unassigned_documents": (unassigned_documents, UNASSIGNED),
    "reviewed_documents": (reviewed_documents, REVIEWED), "inserted_tags": (inserted_tags, TAGS), 
    "redaction_targets": (redaction_targets, TARGETS), "leaked_samples": (leaked_samples, LEAKED), "duplicate_texts": (duplicate_texts, DUPLICATES), "size_percentiles": (size_percentiles, PERCENTILES),
    "audit_search": (audit_search, AUDIT), "login_throttle": (login_throttle, THROTTLE), "full_text_search": (full_text_search, SEARCH), "aliases": (aliases, ALIASES), "cohort": (cohort, COHORT),
}


def queries():
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql():
    return {k: s for k, (_, s) in QUERIES.items()}
