"""Document classes by keyword: the first rule with a keyword in the name or the first 4,000 characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are looked at: part of what a class means, not a saving.
WINDOW = 4_000

# Keywords in order of precedence, category, subcategory.
RULES = (
    (("sikayet", "şikayet", "suc duyurusu", "suç duyurusu", "savciligi", "savcılığı", "supheli", "şüpheli"), "litigation", "criminal_complaint"),
    (("dilekce", "dilekçe", "mahkemesi", "court", "petition"), "litigation", "petition"),
    (("karar", "decision", "judgment"), "litigation", "court_decision"),
    (("delil", "evidence", "ek-"), "litigation", "evidence"),
    (("sha", "hissedarlar", "shareholders agreement"), "corporate_law", "shareholders_agreement"),
    (("spa", "hisse devir", "hisse_devir", "stock purchase", "pay devir"), "corporate_law", "stock_purchase"),
    (("post-inc", "post incorporation", "bylaws", "initial-action", "coi"), "corporate_law", "post_incorporation"),
    (("ykk", "yonetim kurulu", "yönetim kurulu", "board resolution", "bod consent"), "corporate_law", "board_resolutions"),
    (("sermaye", "capital increase", "_gk_", "gk_"), "corporate_law", "capital_increase"),
    (("poa", "power of attorney", "vekaletname"), "corporate_law", "power_of_attorney"),
    (("consulting agreement", "danismanlik", "danışmanlık", "advisory agreement", "advisor"), "contract_law", "consulting_advisory"),
    (("employment", "is sozlesmesi", "iş sözleşmesi", "contractor agreement"), "contract_law", "employment"),
    (("hizmet", "service agreement", "saas agreement", "agent solution"), "contract_law", "service_agreement"),
    (("protokol", "isbirligi", "işbirliği", "cooperation"), "contract_law", "cooperation_protocol"),
    (("software agreement", "yazilim", "yazılım"), "contract_law", "saas_software"),
    (("mesafeli satis", "mesafeli satış", "rspa"), "contract_law", "sales_agreement"),
    (("ip devir", "ip_assignment", "fikri mulkiyet", "fikri mülkiyet"), "intellectual_property", "ip_assignment"),
    (("nda", "gizlilik", "non-disclosure", "non disclosure"), "intellectual_property", "nda"),
    (("marka", "trademark"), "intellectual_property", "trademark"),
    (("aydinlatma", "aydınlatma", "privacy notice"), "data_privacy", "privacy_notice"),
    (("kvkk", "kisisel veri", "kişisel veri", "gdpr", "standart sozlesme", "scc"), "data_privacy", "kvkk_compliance"),
    (("veri transfer", "data transfer", "dpa", "data processing"), "data_privacy", "data_transfer"),
    (("privacy policy", "gizlilik politikasi", "gizlilik politikası"), "data_privacy", "privacy_policy"),
    (("cookie", "cerez", "çerez"), "data_privacy", "cookie_policy"),
    (("token", "mica", "kripto", "masak", "kvhs"), "regulatory_compliance", "crypto_token"),
    (("legal opinion", "yasal gorus", "yasal görüş"), "regulatory_compliance", "legal_opinion"),
    (("terms of use", "terms of service", "kullanim kosullari", "kullanım koşulları"), "regulatory_compliance", "terms_of_use"),
    (("disiplin", "etik hat"), "labor_law", "discipline"),
    (("non compete", "non-compete", "non solicitation", "rekabet yasagi"), "labor_law", "non_compete"),
    (("sweat equity", "phantom stock"), "labor_law", "sweat_equity"),
    (("prim", "maas haczi", "maaş haczi", "maas", "maaş"), "labor_law", "compensation"),
    (("fesih", "termination", "ihtar"), "labor_law", "termination"),
    (("durum tespit", "due diligence"), "reports_presentations", "due_diligence"),
    (("toplanti tutanagi", "toplantı tutanağı", "meeting minutes"), "reports_presentations", "meeting_minutes"),
    (("arastirma", "araştırma", "research"), "reports_presentations", "research"),
    (("presentation", "sunum"), "reports_presentations", "presentation"),
    (("rapor", "report", "bilgi notu"), "reports_presentations", "research"),
    (("safe",), "other", "safe_agreement"),
    (("zimmet",), "other", "asset_inventory"),
    (("sulh", "settlement"), "other", "settlement"),
    (("indemnity", "tazminat"), "other", "indemnity"),
)


#: The tags of each of the rules, in their order.
TAGS = (
    ("ceza", "şikayet"), ("dilekçe",), ("karar",), ("delil",), ("SHA", "hissedar"), ("SPA", "hisse devir"), ("kuruluş", "post-inc"), ("YKK",), ("sermaye",), ("vekaletname",), ("danışmanlık",), ("iş sözleşmesi",), ("hizmet",), ("protokol",),
    ("yazılım",), ("satış",), ("IP",), ("NDA", "gizlilik"), ("marka",), ("KVKK",), ("KVKK/GDPR",), ("veri aktarım",), ("gizlilik politikası",), ("çerez",), ("kripto",), ("yasal görüş",), ("kullanım koşulları",), ("disiplin",),
    ("rekabet yasağı",), ("sweat equity",), ("maaş",), ("fesih",), ("durum tespiti",), ("toplantı",), ("araştırma",), ("sunum",), ("rapor",), ("SAFE",), ("zimmet",), ("sulh",), ("tazminat",),
)


def classify(docs: DataFrame, doc_id: str, filename: str, text: str, tags: bool = False) -> DataFrame:
    """``doc_id, category, subcategory`` and, if asked for, ``tags ARRAY<STRING>``. A text without a keyword is ``other,
    miscellaneous`` and has no tags."""
    hay = docs.select(doc_id, F.lower(F.concat_ws("\n", filename, F.substring(text, 1, WINDOW))).alias("h"))
    rule = F.lit(len(RULES))
    for i in range(len(RULES) - 1, -1, -1):
        rule = F.when(reduce(Column.__or__, (F.col("h").contains(k) for k in RULES[i][0])), i).otherwise(rule)
    names = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"), F.array(*map(F.lit, t)).cast("array<string>").alias("tags")) for (_, c, s), t in zip((*RULES, ((), "other", "miscellaneous")), (*TAGS, ()), strict=True)))
    return hay.select(doc_id, F.get(names, rule).alias("c")).select(doc_id, "c.category", "c.subcategory", *(["c.tags"] if tags else []))
