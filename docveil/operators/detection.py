"""Findings of the rules, set-oriented: every rule is one expression over the text, in one pass over the rows.

All places are found by JVM expressions in a single projection; one generator turns them into findings. Only rules of
whose words one occurs in a text scan it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions.spans import SPANS, matches_sql, once, quoted
from docveil.functions.text import BLANKS, fingerprint, pseudonym_key, search_fold, strip
from docveil.operators.person_names import person_names
from docveil.operators.spans import beside, merge_spans, overlapping
from docveil.operators.rules import CONTEXT, COURT_HIGH, COURT_NUMBERED, COURT_SUFFIX, CRIMINAL, DIRECT, HEALTH, NOTARY_NUMBERED, PRIVILEGED, PSEUDONYM, RULES, Rule, clauses, is_person

#: Labels of identifiers.
ID_LABELS = ("TCKN", "TC", "VKN", "MERSIS", "MERSİS", "IBAN", "UYAP")
#: Characters of a sample.
SAMPLE = 180
_TRIGGERS = f"(?iuU)(?:{HEALTH}|{CRIMINAL}|{PRIVILEGED})"
_STREET = r"(?iuU)\b(?:mah\.?|mahallesi|cad\.?|caddesi|sok\.?|sokak|sokağı|sokagi|bulvarı|bulvari|apartmanı|apartmani|apt\.?|[İi]lçesi|ilcesi|köyü|koyu)\b"
_LEAD = r"(?iuU)^(?:[A-ZÇĞİÖŞÜ][a-zA-Z0-9çğıöşüÇĞİÖŞÜ]*\s+){0,2}"


def _pattern(rule: Rule) -> str:
    return f"(?{rule.flags}){rule.pattern}"


def named_courts_sql(text: str) -> str:
    """Spans of the rules that begin at a court's own name."""
    return f"concat({', '.join(matches_sql(text, f'(?iuU){p}') for p in (COURT_NUMBERED, NOTARY_NUMBERED, COURT_HIGH))})"


def generic_courts_sql(text: str) -> str:
    """Authorities known by their last word, with what follows. One strictly inside a named court is that court and
    is skipped, and the scan resumes at the narrowest such court's end; else after the match.

    The suffixes are listed with the sweep as a lookahead, so that each keeps its place whatever is skipped; a fold
    over them plays the scan's cursor."""
    suffix, sweep = COURT_SUFFIX.rsplit("[^.", 1)
    follow = f"regexp_extract_all({text}, {quoted(f'(?iuU){suffix}(?=([^.{sweep}))')}, 1)"
    spans = "transform(arrays_zip(c.heads, c.tails), z -> named_struct('start', z.heads.start, 'end', z.heads.end + length(coalesce(z.tails, ''))))"
    inside = "array_min(transform(filter(c.named, n -> n.start < m.start AND m.start < n.end), n -> n.end))"
    value = f"substr({text}, m.start + 1, m.end - m.start)"
    kept = f"concat(acc.out, array(named_struct('start', m.start, 'end', m.end, 'value', {value}, 'whole', {value})))"
    step = once(inside, "i", f"named_struct('at', IF(m.start < acc.at, acc.at, coalesce(i, m.end)), 'out', IF(m.start < acc.at OR i IS NOT NULL, acc.out, {kept}))")
    walk = f"aggregate({spans}, named_struct('at', 0, 'out', CAST(array() AS {SPANS})), (acc, m) -> {step}, acc -> acc.out)"
    heads = matches_sql(text, f"(?iuU){suffix}")
    return once(f"named_struct('heads', {heads}, 'tails', {follow}, 'named', {named_courts_sql(text)})", "c", walk)


def _address_start_sql() -> str:
    """An address does not begin before a trigger of a sensitive clause that stands among its first words, if a street
    word is left after it."""
    lead, trigger = quoted(_LEAD), quoted(rf"^.*{_TRIGGERS}\s*")
    moved = once("substr(a.whole, k + 1)", "r", f"IF(k > 0 AND r RLIKE {quoted(_STREET)}, named_struct('start', a.start + k, 'end', a.end, 'value', r, 'whole', r), a)")
    return once(f"length(regexp_extract(regexp_extract(a.whole, {lead}, 0), {trigger}, 0))", "k", moved)


def _spans_sql(rule: Rule) -> str:
    """Spans of a rule in the column ``text``, beside which stand its forms ``low`` and ``clause``."""
    if rule.pattern == COURT_SUFFIX:
        out = generic_courts_sql("text")
    else:
        out = matches_sql("clause" if rule.clause else "text", _pattern(rule), rule.group, "text")
        if rule.category == "address":
            out = f"transform({out}, a -> {_address_start_sql()})"
    may = [f"({' OR '.join(f'contains(low, {quoted(w)})' for w in rule.words)})"] if rule.words else []
    may += [f"text RLIKE {quoted(rule.shape)}"] if rule.shape else []
    return f"IF({' AND '.join(may)}, {out}, CAST(array() AS {SPANS}))" if may else out


def findings(docs: DataFrame, doc_id: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Raw findings in order of rules and places, before cutting and deduplication.

    Columns out: ``doc_id, rule_ord, match_ord, category, sample, risk, action, prefix, start, end, value, fingerprint``.
    Offsets are half-open code points of the raw match; the value is stripped, the sample its first 180 characters.
    Null texts have none.
    """
    base = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = base.select("doc_id", "text", F.translate(search_fold(F.col("text")), "ſ", "s").alias("low"), clauses(F.col("text")).alias("clause"))

    listed = [f"transform({_spans_sql(r)}, (m, j) -> named_struct('rule_ord', {i}, 'match_ord', j, 'start', m.start, 'end', m.end, 'value', regexp_replace(m.value, {quoted(BLANKS)}, '')))" for i, r in enumerate(rules)]
    f = base.select("doc_id", F.explode(F.expr(f"flatten(array({', '.join(listed)}))")).alias("f")).select("doc_id", "f.*").where("value <> ''")
    ok = F.lit(True)
    for i, r in enumerate(rules):
        if r.keep is not None:
            ok = F.when(F.col("rule_ord") == i, r.keep(F.col("value"))).otherwise(ok)
    # What a rule says of its findings is looked up once they are told.
    told = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in (("category", r.category), ("risk", r.risk), ("action", r.action), ("prefix", r.prefix)))) for r in rules))
    f = f.where(ok).withColumn("r", F.get(told, F.col("rule_ord")))
    return f.select("doc_id", "rule_ord", "match_ord", "r.category", "r.risk", "r.action", "r.prefix", "start", "end", "value", F.substring("value", 1, SAMPLE).alias("sample"), fingerprint(F.col("value")).alias("fingerprint"))


def all_findings(docs: DataFrame, doc_id: str, text: str, given: list[str], rare: DataFrame | None = None) -> DataFrame:
    """``findings`` of all rules and, after them, the names that ``person_names`` finds without a title or role."""
    n = person_names(docs, doc_id, text, given, rare).where(is_person(F.col("value"))).select(
        "doc_id", F.lit(len(RULES)).alias("rule_ord"), F.col("start").alias("match_ord"), F.lit("natural_person_name").alias("category"), F.lit("HIGH").alias("risk"), F.lit(PSEUDONYM).alias("action"), F.lit("PERSON").alias("prefix"),
        "start", "end", "value", F.substring("value", 1, SAMPLE).alias("sample"), fingerprint(F.col("value")).alias("fingerprint"),
    )
    return findings(docs, doc_id, text).unionByName(n)


def cut_identifiers(f: DataFrame) -> DataFrame:
    """Sensitive clauses without the direct identifiers in them: each clause is split at the merged spans of the
    identifiers it overlaps (one as wide as the clause does not cut it), its pieces stripped of leading points and
    blanks, and pieces without a word left out."""
    key = ["doc_id", "c_start", "c_end", "c_ord"]
    clause = f.where(F.col("category").isin(*CONTEXT)).withColumn("c_ord", F.struct("rule_ord", "match_ord")).withColumn("c_start", F.col("start")).withColumn("c_end", F.col("end"))
    ident = f.where(F.col("category").isin(*DIRECT)).select("doc_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    cuts = overlapping(clause.select(*key), ident, ["doc_id"], ("c_start", "c_end"), ("i_start", "i_end")).where("NOT (i_start = c_start AND i_end = c_end)")
    merged = merge_spans(cuts.withColumnRenamed("i_start", "start").withColumnRenamed("i_end", "end"), key)
    w = Window.partitionBy(*key).orderBy("start")
    inner = merged.withColumn("prev", F.lag("end").over(w))
    pieces = (
        inner.select(*key, F.coalesce("prev", "c_start").alias("p_start"), F.col("start").alias("p_end"))
        .union(merged.groupBy(*key).agg(F.max("end").alias("p_start")).select(*key, "p_start", F.col("c_end").alias("p_end")))
        .where("p_start < p_end")
    )
    cut = clause.join(pieces, key)
    whole = clause.join(merged.select(*key).distinct(), key, "left_anti")
    part = F.expr("substring(value, p_start - c_start + 1, p_end - p_start)")
    lead = F.length(F.regexp_extract(part, r"(?U)^[\s.,;:]+", 0))
    cut = cut.withColumn("piece", part).withColumn("lead", lead).select(*[c for c in f.columns if c not in ("start", "end", "value", "sample", "fingerprint")], (F.col("p_start") == F.col("c_start")).alias("leading"), (F.col("p_start") + F.col("lead")).alias("start"), strip(F.expr("substring(piece, lead + 1)")).alias("value"))
    cut = cut.withColumn("end", F.col("start") + F.length("value"))
    # The leading piece holds the clause's own word; any other one says nothing if its only word is an identifier's label.
    words = F.regexp_extract_all("value", F.lit(r"\p{L}{2,}"), F.lit(0))
    lone = (F.size(words) == 1) & F.upper(F.get(words, F.lit(0))).isin(*ID_LABELS) & ~F.col("leading")
    cut = cut.where((F.size(words) > 0) & ~lone).drop("leading").withColumn("sample", F.substring("value", 1, SAMPLE)).withColumn("fingerprint", fingerprint(F.col("value")))
    rest = f.where(~F.col("category").isin(*CONTEXT))
    return rest.unionByName(whole.select(*f.columns)).unionByName(cut.select(*f.columns))


#: Places of a rule in a text that are numbered in one go.
STRETCH = 4096


def placeholders(f: DataFrame) -> DataFrame:
    """Numbers per document and prefix, by first appearance in the order of rules and places; spellings that differ in
    case and blanks share one. Adds ``placeholder``."""
    k = f.withColumn("key", pseudonym_key(F.col("value")))
    first = k.groupBy("doc_id", "prefix", "key").agg(F.min(F.struct("rule_ord", "match_ord")).alias("first"))
    numbered = numbers(first.withColumn("stretch", F.struct(F.col("first.rule_ord").alias("r"), F.floor(F.col("first.match_ord") / STRETCH).alias("m"))), ["doc_id", "prefix"], "stretch", "first")
    j = beside(k, numbered.select("doc_id", "prefix", "key", "number"), ["doc_id", "prefix", "key"])
    return j.withColumn("placeholder", F.concat(F.lit("["), "prefix", F.lit("_"), F.col("number").cast("string"), F.lit("]"))).drop("number", "key")


def numbers(rows: DataFrame, keys: list[str], stretch: str, order: str) -> DataFrame:
    """Adds ``number``, the rank from 1 of each row (``order`` is without ties) within its keys: the rows of the stretches
    before its own, counted first, and its rank within its stretch. ``stretch`` rises with ``order``."""
    w = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*keys, stretch).agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    return beside(rows, counts, [*keys, stretch]).withColumn("number", F.col("_base") + F.row_number().over(Window.partitionBy(*keys, stretch).orderBy(order))).drop("_base")
