"""Scalar text functions as column expressions; Catalyst keeps them in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that tell a filename's language, patterns of versions and dates, groups of letters that are one
# to a search.
ENGLISH = ("Agreement", "Policy", "Terms", "Notice", "Certificate", "Consent", "Resolution", "Opinion", "Report", "Inc.", "Co.", "ENG")
TURKISH = ("Sozlesme", "Sözleşme", "Yonetmelik", "Yönetmelik", "Aydinlatma", "Aydınlatma", "Tutanak", "Karar", "Rapor", "Devir", "Dilekce", "Dilekçe")
VERSIONS = (r"[vV]\.?\s*(\d+\.?\d*)", r"VL\s*(\d+\.?\d*)", r"_v(\d+)", r"version\s*(\d+\.?\d*)")
DATES = ((r"(\d{4})(\d{2})(\d{2})", True), (r"(\d{4})[._-](\d{2})[._-](\d{2})", True), (r"(\d{2})[._-](\d{2})[._-](\d{4})", False), (r"(\d{2})(\d{2})(\d{4})", False))
FOLDED, FOLDED_AS = "âÂçÇğĞıİIîÎöÖşŞüÜûÛ", "aaccggiiiiioossuuuu"
SKIPPED = (".DS_Store", "~$", ".gitignore", ".git")
EXTENSIONS = (".docx", ".doc", ".pdf", ".xlsx", ".pptx", ".zip", ".png", ".jpg", ".jpeg", ".udf", ".txt", ".md")
UNSAFE = "\"'<>"
BLOCKED_KEYS = ("password", "token", "secret", "csrf", "session")

BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Unicode blanks off both ends."""
    return F.regexp_replace(c, BLANKS, "")


def normalize_layout(c: Column) -> Column:
    """Line ends to LF, control characters out, blanks at line ends out, at most one empty line; inner blanks stay."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"[ \t]+(?=\n)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tr_fold(c: Column) -> Column:
    """Lower case the Turkish way."""
    return F.lower(F.translate(c, "İI", "iı"))


def pseudonym_key(c: Column) -> Column:
    """One key for spellings that differ in case and blanks."""
    return strip(tr_fold(F.regexp_replace(c, r"(?U)\s+", " ")))


def audit_key(c: Column) -> Column:
    return strip(F.lower(F.regexp_replace(c, r"(?U)\s+", " ")))


def fingerprint(c: Column, digits: int = 12) -> Column:
    """The first hex digits of SHA-256 over the lower-cased value."""
    return F.substring(F.sha2(F.lower(c), 256), 1, digits)


def manual_fingerprint(document: Column, category: Column, value: Column) -> Column:
    """SHA-256 of document, category and value in small letters."""
    return F.sha2(F.lower(F.concat_ws(":", document.cast("string"), category, value)), 256)


def region_fingerprint(document: Column, finding: Column, page: Column, *coordinates: Column) -> Column:
    """20 hex digits over ids and coordinates of six decimals; a missing finding prints None."""
    parts = [document.cast("string"), F.coalesce(finding.cast("string"), F.lit("None")), page.cast("string"), *(F.format_string("%.6f", x) for x in coordinates)]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 20)


def search_fold(c: Column) -> Column:
    """Case and diacritics away, width kept, so offsets in the folded text are offsets in the text."""
    return F.lower(F.translate(c, FOLDED, FOLDED_AS))


def contains_folded(text: Column, needle: Column) -> Column:
    return search_fold(text).contains(search_fold(needle))


def stem(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def generate_title(filename: Column) -> Column:
    return strip(F.regexp_replace(F.translate(stem(filename), "_", " "), r"(?U)\s+", " "))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))


def skipped(filename: Column) -> Column:
    return reduce(Column.__or__, (filename.contains(x) for x in SKIPPED))


def supported(filename: Column) -> Column:
    return extension(filename).isin(*EXTENSIONS)


def detect_language(filename: Column) -> Column:
    low = F.lower(filename)
    english, turkish = (reduce(Column.__or__, (low.contains(w.lower()) for w in ws)) for ws in (ENGLISH, TURKISH))
    return F.when(english & turkish, "TR/EN").when(english, "EN").otherwise("TR")


def detect_version(filename: Column) -> Column:
    return F.coalesce(*(F.concat(F.lit("v"), F.nullif(F.regexp_extract(filename, "(?i)" + p, 1), F.lit(""))) for p in VERSIONS))


def detect_date(filename: Column) -> Column:
    """The first pattern whose first occurrence is within bounds; days are not checked against the calendar."""

    def one(pattern: str, year_first: bool) -> Column:
        y, m, d = (F.regexp_extract(filename, pattern, g) for g in ((1, 2, 3) if year_first else (3, 2, 1)))
        ok = y.try_cast("int").between(2020, 2035) & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
        return F.when(ok, F.concat_ws("-", y, m, d))

    return F.coalesce(*(one(p, f) for p, f in DATES))


def size_label(size: Column) -> Column:
    return F.when(size > 1_048_576, F.format_string("%.1f MB", size / 1_048_576)).when(size > 1024, F.format_string("%.0f KB", size / 1024)).otherwise(F.format_string("%d B", size))


def evidence_context(text: Column, start: Column, end: Column, sample: Column, width: int = 48) -> Column:
    """The value with ``width`` characters on either side, on one line; without a place, the sample's beginning."""
    low = F.greatest(start - width, F.lit(0))
    around = strip(F.translate(F.substr(text, low + 1, end + width - low), "\n", " "))
    return F.when(text.isNotNull() & start.isNotNull() & end.isNotNull() & (end > start) & (start >= 0), around).otherwise(F.substring(sample, 1, 160))


def drop_unsafe(c: Column) -> Column:
    return F.translate(c, UNSAFE, "")


def safe_stem(filename: Column, default: str = "document") -> Column:
    name = F.substring(F.regexp_replace(F.regexp_replace(stem(filename), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), 1, 120)
    return F.when(F.coalesce(name, F.lit("")) == "", default).otherwise(name)


def replacement_for(placeholder: Column, risk: Column, action: Column) -> Column:
    """Placeholders of critical values that need a review say so."""
    marked = (risk == "CRITICAL") & F.lower(action).contains("review") & ~placeholder.endswith("_REDACTED]")
    return F.when(marked, F.regexp_replace(placeholder, r"\]$", "_REDACTED]")).otherwise(placeholder)


def strip_markup(c: Column) -> Column:
    """Tags to blanks, the common entities undone."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def sanitize_metadata(entries: Column) -> Column:
    """Of a map of strings: blocked keys hidden, values cut to 200 characters."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).isin(*BLOCKED_KEYS), "[redacted]").otherwise(F.substring(v, 1, 200)))


def explain(category: Column, known: dict[str, str]) -> Column:
    """What a category means; an unknown one is spelt out."""
    out = F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))
    for name, meaning in known.items():
        out = F.when(category == name, meaning).otherwise(out)
    return out


def mentions(text: Column, words: tuple[str, ...], window: int = 5_000) -> Column:
    """Whether one of the words is in the lower-cased beginning of the text."""
    low = F.lower(F.substring(text, 1, window))
    return F.coalesce(reduce(Column.__or__, (low.contains(w) for w in words)), F.lit(False))


def count_mentions(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__add__, (low.contains(w).cast("int") for w in words))
