"""Personal information inside free text (problem 1).

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs and their spelt forms, cues of identity
numbers and telephones, dialling signs and digits, words of streets, given names, initials, roles, words of placeholders.
Around each anchor a deterministic parser expands to the value's boundaries and validates it. Values are replaced by typed
placeholders, numbered by first appearance in the text.

A parser reads the text in a plain form in which look-alikes, invisible characters, wrongly read bytes and words split
at line ends are undone, and maps offsets back to the text as stored.
"""

from __future__ import annotations

import re
import string
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions.text import search_fold
from docveil.llm import mojibake
from docveil.llm.inputs import rows_of, union
from docveil.llm.lookalikes import mapping
from docveil.sources.tables import table

#: A token is taken for a given name when it stands first in so many name findings, and more often first than last.
LEAST = 2
#: Given names in the automaton, the most frequent ones; texts that may hold another one are found by a join.
IN_AUTOMATON = 20_000
#: Characters between a cue and the number it announces, at most.
NEAR = 60
#: Kinds in the order in which overlaps are settled.
KINDS = ("email_address", "identity_number", "phone_number", "address", "natural_person_name")
PREFIX = {"email_address": "EMAIL", "identity_number": "NATIONAL_ID", "phone_number": "PHONE", "address": "ADDRESS", "natural_person_name": "PERSON"}
#: Categories of findings, by the kind their placeholder may leak.
LEAKS = {"natural_person_name": "natural_person_name", "phone_number": "phone_number", "address": "address", "email_address": "email_address", "turkish_national_id": "identity_number", "passport_number": "identity_number"}
CONTEXT = ("health_data", "criminal_allegation", "privileged_or_confidential")

UP = "A-ZÇĞİÖŞÜÂÎÛÉÈÊËÀÄÔÏÙÒÌÅÆŒÁÍÓÚÑ"
LOW = "a-zçğıöşüâîûéèêëàäôïùòìåæœßáíóúñ"

#: The capitals of ``UP`` one by one.
LETTERS = string.ascii_uppercase + UP[3:]


def spellings(word: str) -> set[str]:
    """The word, and as typed without accents, with and without the dotless i."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return {word, bare, bare.replace("ı", "i")}


def upper(word: str) -> str:
    return word.replace("i", "İ").replace("ı", "I").upper()


def cases(word: str) -> set[str]:
    """The word in small letters, with a capital, in capitals (the Turkish way and the other)."""
    return {word, word[:1].upper() + word[1:], upper(word[:1]) + word[1:], word.upper(), upper(word)}


# Words of the five languages that tell kinds of values apart.
AT = ("@", "(at)", "[at]", "{at}", "(AT)", "[AT]")
IDENTITY = (
    "TCKN", "T.C. Kimlik", "T.C. kimlik", "TC Kimlik", "TC kimlik", "TC No", "TC no", "T.C. No", "T.C. no", "kimlik no", "Kimlik No", "Kimlik no", "kimlik numarası", "Kimlik Numarası", "KİMLİK NO", "pasaport", "Pasaport",
    "PASAPORT", "passport", "Passport", "national ID", "National ID", "Turkish ID", "identity number", "Identity number", "ID number", "d'identité", "passeport", "Passeport", "d'identità", "passaporto", "Passaporto",
    "codice identificativo", "codice fiscale", "Reisepass", "reisepass", "Personenkennzahl", "Identitätsnummer", "Passnummer", "Pass-Nr", "Ausweisnummer", "Personalausweis", "Kimlik bilgileri",
)
PHONE = ("tel", "tel.", "telefon", "phone", "téléphone", "telefono", "irtibat", "ulaşım", "faks", "fax", "rufnummer", "erreichbar", "joignable", "raggiungibile", "gsm", "mobil", "mobile", "cep", "hattan", "hattı", "reached", "call", "dial", "numarasını ara", "appeler", "chiamare")
DIAL = tuple("+(0123456789O")
NO_PHONE = re.compile(
    r"(?:vergi|\bvkn|takip|barkod|barcode|referans|reference|référence|riferimento|beleg|\bbuild|sürüm|surum|yazılımın|yazilimin|\biban|\btr\d\d|\bhesa[bp]|\bkonto|\baccount|\bcompte|\bconto|sicil|mersis|tckn|kimlik|identi|\btc no|pasaport|passport|passnummer|passeport|passaporto|reisepass"
    r"|\besas|\bdosya|\bfile\b|\baffaire|\bcausa|verfahren|parsel|\busd\b|\beur\b|\btl\b|₺|€|\$)[^.;,)]{0,22}$",
    re.I,
)
TR_STREET = r"Mah(?:\.|alles\w)|Cad(?:\.|des\w)|Blv\.|Bulv(?:\.|ar\w)|So?k(?:\.|ak|a\w\w)|Sk\.|MAH(?:\.|ALLES\w)|CAD(?:\.|DES\w)|BLV\.|BULVAR\w|SOK(?:\.|AK|A\w\w)|SK\."
TR_MORE = r"(?:Mah|Cad|Blv|Bulv|Sok|Sk|Apt|Apartman|No|NO|Kat|Daire|D|K|MAH|CAD|SOK|APT|Sit|Blok)\b"
FR_STREET = r"rue|avenue|av\.|bd|boulevard|chemin|place|allée|impasse|quai|route|cours|square|passage"
DE_STREET = r"[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Aa]llee|[Pp]latz|[Gg]asse|[Rr]ing|[Dd]amm|[Uu]fer|[Cc]haussee|[Ss]teig|[Pp]fad"
EN_STREET = r"Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.|Square|Sq\.?|Court|Way|Close|Crescent|Terrace|Row|Walk|Gardens|Boulevard|Place|Hill|Parade|Mews"
IT_STREET = r"Via|V\.le|Viale|Piazza|P\.zza|Piazzale|Corso|Largo|Vicolo|C\.so|Strada"
STREET_WORDS = {
    "tr": ("Mah", "MAH", "Cad", "CAD", "Blv", "BLV", "Bulv", "BULV", "Sok", "SOK", "Sk.", "SK."),
    "en": ("Street", "St", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Drive", "Dr.", "Square", "Sq", "Court", "Way", "Close", "Crescent", "Terrace", "Row", "Walk", "Gardens", "Boulevard", "Place", "Hill", "Parade", "Mews"),
    "fr": ("rue ", "avenue ", "av. ", "bd ", "boulevard ", "chemin ", "place ", "allée ", "impasse ", "quai ", "route ", "cours ", "square ", "passage "),
    "de": ("traße", "trasse", "weg ", "Weg ", "Allee", "allee", "latz ", "asse ", "ring ", "Ring ", "damm ", "Damm ", "ufer ", "Ufer ", "Str.", "str.", "haussee ", "steig ", "Steig ", "pfad ", "Pfad "),
    "it": ("Via ", "Viale", "V.le", "Piazza", "P.zza", "Corso", "Largo", "Vicolo", "C.so", "Strada "),
}
ROLES = (
    "davacı", "davalı", "tanık", "şüpheli", "sanık", "malik", "maliki", "hasta", "müvekkil", "işçi", "müdür", "hâkim", "alacaklı", "borçlu", "müşteki", "mağdur", "vekil", "vekili", "av.", "avukat", "dr.", "sayın", "ilgili kişi", "adı soyadı:",
    "hazırlayan", "claimant", "defendant", "patient", "employee", "auditor", "insured,", "consultant", "witness", "tenant", "mr", "ms", "mrs", "mr.", "ms.", "mrs.", "name:", "nom :", "nome:", "rechtsanwalt", "rechtsanwältin", "kläger", "klägerin",
    "beklagte", "patientin", "zeuge", "zeugin", "versicherte", "geschäftsführer", "arbeitnehmer", "arbeitnehmerin", "maître", "témoin", "demandeur", "demanderesse", "gérante", "gérant", "assurée", "assuré", "salarié", "salariée", "avvocato",
    "l'avvocato", "lavoratore", "testimone", "attore", "l'attore", "amministratrice", "l'amministratrice", "assicurata", "l'assicurata", "paziente",
)
TYPES = ("PERSON", "PHONE", "ADDRESS", "EMAIL", "NATIONAL_ID", "PASSPORT")
FIRM = re.compile(
    rf"[ \n]*(?:[{UP}][{UP}{LOW}.&'’-]*[ \n]+){{0,4}}?(?:A\.?\s?Ş\.?|A\.S\.|AŞ|AS|Ltd|LTD|LİMİTED|Limited|San\.|SAN\.|Tic\.|TİC\.|Inc|LLP|LLC|GmbH|AG|KG|SARL|SAS|S\.p\.A|S\.r\.l|S\.A\.|Holdings?|Partners|Logistics|Co\.|&|Anonim|ANONİM"
    r"|Gıda|Gida|GIDA|Kimya|KİMYA|KIMYA|Makine|MAKİNE|MAKINE|Tekstil|TEKSTİL|TEKSTIL|Turizm|TURİZM|TURIZM|Otomotiv|OTOMOTİV|OTOMOTIV|Lojistik|LOJİSTİK|LOJISTIK|Elektronik|ELEKTRONİK|ELEKTRONIK|Yazılım|Yazilim|YAZILIM|Enerji|ENERJİ|ENERJI|Madencilik|MADENCİLİK|MADENCILIK|Mobilya|MOBİLYA|MOBILYA|Ambalaj|AMBALAJ|Yayıncılık|Yayincilik|YAYINCILIK"
    r"|Danışmanlık|Danismanlik|DANIŞMANLIK|DANISMANLIK|Denizcilik|DENİZCİLİK|DENIZCILIK|İnşaat|Insaat|İNŞAAT|INSAAT|Sağlık|Saglik|SAĞLIK|SAGLIK|Servizi|Handels|Associés|Mahkemesi|MAHKEMESİ|Müdürlüğü|Noterliği|Sicili)(?![\w])"
)
#: Capitalised words that follow or precede a given name without being part of a person's name.
NOT_NAMES = frozenset(
    "Station Konakları Konutları Sitesi Mahallesi Mah Caddesi Cad Sokak Sokağı Sok Sk Bulvarı Blv Apartmanı Apt Hanım Bey Kimlik Esas No NO Ticaret Sicil Sicili Asliye Sulh İcra Aile İş Mahkemesi Noterliği Müdürlüğü Projesi Hotel Hastanesi "
    "Üniversitesi Okulu Limanı Köprüsü Parkı Street Road Lane Avenue Square Court Way Ave Rd St House Centre Center Park Bridge Depot TC TCKN Pasaport Passport ID Tel Phone Telefon Téléphone Telefono Adres Adresse Address Indirizzo Adresi "
    "Statement STATEMENT Report REPORT Agreement AGREEMENT This The EKLER Vekaletname Fatura Tutanak Enclosures Anlagen Allegati Pièces Daire Kat Dr Av Mr Ms".split()
)

_SIGNS = "’‘“”–—«»…°§€²³½¬"
_PAIR = re.compile(f"[ÃÄÅÂ][{_SIGNS}]")
_ODD = re.compile(f"[^\x00-\x7f{mojibake.NATURAL}{_SIGNS}]|{_PAIR.pattern}")
_PLAIN = {chr(c): to for c, (to, _) in mapping().items()}
_BYTES = {}
for _wrong, _right in (("cp1252", "cp1254"), ("cp1250", "cp1254"), ("cp1252", "cp857"), ("cp850", "cp1254"), ("latin-1", "cp857")):
    for _c, _to in mojibake._single(_wrong, _right).items():
        if chr(_c) not in mojibake.NATURAL:
            _BYTES.setdefault(chr(_c), _to)
_SPLIT = re.compile(rf"(?<=[{UP}{LOW}])(?:[-¬‐]\s?\n[ \t]*(?=[{LOW}])|¬\s?\n[ \t]*(?=[{UP}])|(?<=[{UP}]{{2}})-\s?\n[ \t]*(?=[{UP}]{{2}}))")
_COMBINED = re.compile("[̀-ͯ]")


class Plain:
    """A text in plain form, and the place of its characters in the text as stored."""

    __slots__ = ("text", "_at", "_shift")

    def __init__(self, raw: str):
        self._at, self._shift = [0], [0]
        odd, split = _ODD.search(raw), _SPLIT.search(raw)
        if not odd and not split:
            self.text = raw
            return
        out, n, at = [], 0, 0

        def put(new: str, start: int, end: int) -> None:
            """``new`` in the place of raw[start:end]."""
            nonlocal n, at
            out.append(raw[at:start])
            n += start - at
            if new:
                out.append(new)
                self._at.append(n)
                self._shift.append(start - n)
                n += len(new)
            at = end
            self._at.append(n)
            self._shift.append(end - n)

        edits = [(m.start(), m.end(), "") for m in _SPLIT.finditer(raw)]
        if odd:
            for m in re.finditer(r"[^ \n\t]+", raw):
                word = m[0]
                if not _ODD.search(word):
                    continue
                new = _undo(word)
                # Character by character where the lengths allow, as values may begin within the word.
                if isinstance(new, list):
                    edits += [(m.start() + i, m.start() + i + 1, c) for i, c in new]
                elif new != word:
                    edits.append((m.start(), m.end(), new))
        end = -1
        for a, b, new in sorted(edits):
            if a >= end:
                put(new, a, b)
                end = b
        out.append(raw[at:])
        self.text = "".join(out)

    def stored(self, i: int) -> int:
        k = bisect_right(self._at, i) - 1
        return i + self._shift[k]


def _undo(word: str) -> str | list[tuple[int, str]]:
    """A word without look-alikes and damage: single changes by place, or the whole word read anew."""
    sound = lambda r: not _ODD.search(r)
    if _PAIR.search(word) or not all(c in _PLAIN or _COMBINED.match(c) or not _ODD.match(c) for c in word):
        best = min((r for r, path in mojibake.readings(word) if path[0] != "bytes" and sound(r)), key=len, default=None)
        if best is not None:
            return best
    changes = []
    for i, c in enumerate(word):
        if c in _PLAIN:
            changes.append((i, _PLAIN[c]))
        elif _COMBINED.match(c):
            changes.append((i, ""))
        elif _ODD.match(c):
            unknown = c == mojibake.LOST or not c.isalnum() and 0 < i < len(word) - 1 and word[i - 1].isalpha()
            to = _BYTES.get(c) or (("Ü" if word[i - 1 : i].isupper() and word[i - 2 : i - 1].isupper() else "ü") if unknown else c)
            changes.append((i, to))
    return changes


# --- parsers -------------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[ \t]{0,2}[\w-]+(?:\.[\w-]+)*\.\w{2,}")
_DIGITS = re.compile(r"(?<![\w.,/@-])(?:\+|\()?[0-9OolISBZb](?:[0-9OolISBZb]|[ .()/-]{1,2}(?=[0-9(]|[OolISBZb][0-9])|\s*\n\s*(?=[0-9]))*")
_ID_VALUE = re.compile(r"[^\d;,()]{0,26}?(?<![A-Za-z])((?:[A-Z]{1,2}[0-9OolISBZ]{6,9}|[0-9OolISBZ][0-9OolISBZ -]{8,16}[0-9OolISBZ]))(?![\w])")


def _emails(t: str, at: list[int]) -> Iterator[tuple[int, int]]:
    for i in at:
        end = i
        while end > max(0, i - 2) and t[end - 1] in " \t\n":
            end -= 1
        start = end
        while start and (t[start - 1].isalnum() or t[start - 1] in "_.+'-"):
            start -= 1
        # A local part begins with any of its signs, and ends with none but these.
        if start == end or not (t[end - 1].isalnum() or t[end - 1] in "_+-"):
            continue
        if domain := _DOMAIN.match(t, i + (1 if t[i] in "@＠" else 4)):
            yield start, domain.end()


def _identities(t: str, ends: list[int]) -> Iterator[tuple[int, int]]:
    """Numbers after their cue, by length and leading letter. Check digits are not asked for: after a cue, a number whose
    digits were misread or mistyped is somebody's number too."""
    for i in ends:
        m = _ID_VALUE.match(t, i)
        if not m:
            continue
        digits = sum(c in "0123456789OolISBZ" for c in m[1])
        letter = m[1][0].isalpha() and m[1][0] not in "Ool"
        if (letter and 7 <= digits <= 10) or digits in (10, 11, 12):
            yield m.start(1), m.end(1)


#: Digits that letters are misread for; area code and number as written within a country.
_AS_DIGIT = str.maketrans("OolISZBb", "00115286")
_NATIONAL = re.compile(r"[2-5]\d{2}([ .-]?)\d{3}\1\d{2}\1\d{2}|[2-5]\d{2}[ .-]\d{3}[ .-]\d{4}")


def _phones(t: str, flat: str, dial: list[int], cues: list[int]) -> Iterator[tuple[int, int]]:
    """From a dialling sign or digit that begins a number, or the first number after a cue. ``cues`` are in order."""
    starts = {i for i in dial if i == 0 or not (t[i - 1].isalnum() or t[i - 1] in "_.,/@-")}
    for i in cues:
        starts.update(m.start() for m in _DIGITS.finditer(t, i, i + NEAR + 1))
    done = 0
    for at in sorted(starts):
        if at < done or not (m := _DIGITS.match(t, at)):
            continue
        done = m.end()
        raw = m[0]
        digits = re.sub(r"[^0-9OolISBZb]", "", raw)
        n = len(digits)
        if not 9 <= n <= 13 or sum(c.isdigit() for c in digits) < n - 3:
            continue
        start = m.start()
        if raw[0] == "(" and not re.match(r"\([0O+]?[0-9OolISBZ]{1,5}\)", raw):
            start += 1
            raw = raw[1:]
        before = flat[max(0, start - 36) : start]
        if re.search(r"[.,]\d{2,3}[.,]|\d\s+/\s+\d", raw) and not re.match(r"[+(0]", raw) or NO_PHONE.search(before):
            continue
        k = bisect_right(cues, start) - 1
        near = k >= 0 and start - cues[k] <= NEAR
        shape = _NATIONAL.fullmatch(re.sub(r"\s+", " ", raw.translate(_AS_DIGIT)))
        if raw[0] == "+" or (raw[0] in "(0O" and n >= 9) or shape or near:
            yield start, m.end()


_TR_ADDRESS = re.compile(rf"(?<![\w])([{UP}][{UP}{LOW}]+)[ \n]+(?:{TR_STREET})(?![{LOW}])")
_TR_TAIL = re.compile(rf"(?:[ ,\n]+|(?<=[.:/]))(?:{TR_STREET}|{TR_MORE}\.?:?|Apartmanı|Apartmani|APARTMANI|[{UP}][{UP}{LOW}]+(?=[ \n]+(?:{TR_STREET}|Apt|Apartmanı|Apartmani))|\d+(?:/\d+)?[A-Za-z]?\.?(?![\w])|:?\s?\d+)")
_TR_CITY = re.compile(rf"[ ,\n]+[{UP}][{LOW}]+(?=[\s.,;)]|$)|[ ,\n]+[{UP}]{{4,}}(?=[\s.,;)]|$)")
_FR_ADDRESS = re.compile(rf"(?<![\w/.,-])\d+[A-Za-z]?(?:[ \n]+(?:bis|ter|quater))?,?[ \n]+(?:{FR_STREET})[ \n]+(?:[dl][’'e][ \n]?|de[ \n]+la[ \n]+|des?[ \n]+|du[ \n]+|la[ \n]+|les[ \n]+)*[{UP}][\w’'-]*(?:[ \n-]+[{UP}][\w’'-]*)*(?:,[ \n]+\d{{5}}[ \n]+[{UP}][\w-]+|,[ \n]+[{UP}][\w-]+)?")
_DE_ADDRESS = re.compile(rf"(?<![\w])(?:(?:Am|An|Auf|Im|In|Zum|Zur|Unter)[ \n](?:der|den|dem)?[ \n]?)?(?:[{UP}][\w-]*[ \n-]+)?(?:[{UP}][\w-]*)?(?:{DE_STREET})[ \n]+\d+[ ]?[a-z]?(?![\w])(?:,[ \n]+(?:\d{{5}}[ \n]+)?[{UP}][\w-]+)?")
_EN_ADDRESS = re.compile(rf"(?<![\w/.,-])(?:(?:Unit|Flat|Suite|Apartment|Apt\.?)[ \n]+\d+[A-Z]?,[ \n]+)?\d+[A-Z]?[ \n]+(?:[{UP}][\w’'-]+[ \n]+){{1,3}}(?:{EN_STREET})(?![\w])(?:,[ \n]+(?:Flat|Unit|Apt\.?)[ \n]+\d+[A-Z]?)?(?:,[ \n]+[{UP}][\w-]+)?")
_IT_ADDRESS = re.compile(rf"(?<![\w])(?:{IT_STREET})[ \n]+(?:(?:del|della|dello|delle|dei|degli|di|al|alla|dell[’'])[ \n]?)*[{UP}][\w’'-]*(?:[ \n]+[{UP}][\w’'-]*)*,?[ \n]+(?:n\.[ \n]?)?\d+[A-Za-z]?(?:,[ \n]+(?:\d{{5}}[ \n]+)?[{UP}][\w-]+)?")


_ADDRESSES = {"tr": _TR_ADDRESS, "en": _EN_ADDRESS, "fr": _FR_ADDRESS, "de": _DE_ADDRESS, "it": _IT_ADDRESS}
_LEAD = re.compile(rf"(?:Die|Der|Das|In|An|Auf|Bei|Nach|Von|Aus)[ \n]+(?=[{UP}])")
#: A street in one word, with the word before it: that word is not the street's.
_COMPOUND = re.compile(rf"[{UP}][\w]*[{LOW}][ \n]+(?=[{UP}][\w-]*[{LOW}](?:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|ring|damm|ufer|chaussee|steig|pfad)[ \n])")
_GAP_OF_BLOCKS = re.compile(r"\n[ \t]*\n")


def _addresses(t: str, anchors: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
    """The paragraph an anchor stands in is parsed once by the rules of the anchor's language; what holds no anchor is no
    address."""
    edges = [0, *(m.end() for m in _GAP_OF_BLOCKS.finditer(t)), len(t)]
    found = []
    for order, (lang, pattern) in enumerate(_ADDRESSES.items()):
        own = sorted(set(anchors[lang]))
        for k in sorted({bisect_right(edges, i) - 1 for i in own}):
            for m in pattern.finditer(t, edges[k], edges[min(k + 1, len(edges) - 1)]):
                i = bisect_left(own, m.start())
                if i < len(own) and own[i] < m.end() and (span := _address(t, lang, *m.span())):
                    found.append((*span, order))
    done = 0
    for a, b, _ in sorted(found, key=lambda x: (x[0], x[2])):
        if a >= done:
            yield a, b
            done = b


def _address(t: str, lang: str, start: int, end: int) -> tuple[int, int] | None:
    if lang == "tr":
        if FIRM.match(t, end):
            return None
        first = end
        while tail := _TR_TAIL.match(t, end):
            end = tail.end()
        if end == first:
            return None
        if city := _TR_CITY.match(t, end):
            end = city.end()
    elif lang == "de" and len(t[start:end].split()) > 3 and (lead := _LEAD.match(t, start) or _COMPOUND.match(t, start)):
        start = lead.end()
    return start, end


_TOKEN = re.compile(rf"[{UP}][{UP}{LOW}]*(?:[’'](?![{LOW}]{{1,5}}(?![{UP}{LOW}]))[{UP}{LOW}]+)?(?:-\n?[{UP}][{UP}{LOW}]+)*")
_INITIAL = re.compile(rf"[{UP}]\.[ \n]{{1,2}}(?=[{UP}][{UP}{LOW}]{{3,}})")
_LAST_FIRST = re.compile(rf"([{UP}][{UP}{LOW}’'-]+),[ \n]{{1,2}}$")
_MIDDLE = re.compile(rf"[{UP}]\.(?=\s?[{UP} \n])")
_AFTER_ROLE = re.compile(r"[ \t,]{1,2}|[ \t]*\n[ \t]*")
_GAP = re.compile(r"[ \t]{1,2}|[ \t]?\n[ \t]*|_")


def _surnames(t: str, at: int) -> int:
    """End of the capitalised tokens that go on from ``at``: initials and words. 0 if there is none."""
    end, pos = 0, at
    while gap := _GAP.match(t, pos):
        if initial := _MIDDLE.match(t, gap.end()):
            pos = initial.end()
            continue
        m = _TOKEN.match(t, gap.end())
        if not m or m[0] in NOT_NAMES or len(m[0]) < 2 or ("\n" in gap[0] and gap[0].count("\n") > 1):
            break
        if FIRM.match(t, gap.start()):
            return 0
        pos = end = m.end()
    if not end or FIRM.match(t, end):
        return 0
    return end


class Finder:
    """Anchors of all kinds in one automaton; ``given`` are the given names of the corpus."""

    def __init__(self, given: list[str]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        words: dict[str, set[str]] = {}

        def anchors(kind: str, own) -> None:
            for w in own:
                words.setdefault(w, set()).add(kind)

        anchors("at", AT)
        anchors("id", (f for w in IDENTITY for f in spellings(w)))
        anchors("phone", (f for w in PHONE for c in cases(w) for f in spellings(c)))
        anchors("dial", DIAL)
        for lang, own in STREET_WORDS.items():
            anchors(lang, (f for w in own for f in spellings(w)))
        anchors("role", (f for w in ROLES for c in cases(w) for f in spellings(c)))
        anchors("initial", (f"{c}." for c in LETTERS))
        anchors("given", (f for g in given for c in (g, upper(g), g.upper()) for f in spellings(c)))
        for w, kinds in words.items():
            self.auto.add_word(w, (len(w), tuple(sorted(kinds))))
        self.auto.make_automaton()

    def spans(self, t: str, rare: list[str] | None = None) -> list[tuple[int, int, str]]:
        """Values of a plain text, in order and apart. ``rare`` are given names that are not in the automaton."""
        at: dict[str, list] = {k: [] for k in ("at", "id", "phone", "dial", *STREET_WORDS, "role", "initial", "given")}
        n = len(t)
        flat = t.replace("\n", " ")
        for end, (size, kinds) in self.auto.iter(flat):
            start, end = end - size + 1, end + 1
            for kind in kinds:
                if kind in ("given", "role"):
                    if (start == 0 or not (t[start - 1].isalnum() or t[start - 1] in "@.-'’")) and (end == n or not (t[end].isalnum() or t[end] == "@")):
                        at[kind].append((start, end))
                elif kind == "phone":
                    if start == 0 or not t[start - 1].isalnum():
                        at[kind].append(start)
                else:
                    at[kind].append(end if kind == "id" else start)
        for w in {f for g in rare or () for c in (g, upper(g), g.upper()) for f in spellings(c)}:
            at["given"] += [m.span() for m in re.finditer(rf"(?<![\w@.'’-]){re.escape(w)}(?![\w@])", t)]
        found: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(kind: str, spans: Iterator[tuple[int, int]]) -> None:
            for a, b in spans:
                # Taken ones are apart and in order: only the neighbours can overlap.
                k = bisect_left(taken, (a, b))
                if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b))
                    found.append((a, b, kind))

        if at["at"]:
            add("email_address", _emails(t, at["at"]))
        if at["id"]:
            add("identity_number", _identities(t, at["id"]))
        if at["dial"] or at["phone"]:
            add("phone_number", _phones(t, flat, at["dial"], sorted(at["phone"])))
        if any(at[k] for k in STREET_WORDS):
            add("address", _addresses(t, at))
        add("natural_person_name", self._names(t, at["given"], at["initial"], at["role"]))
        return sorted(found)

    def _names(self, t: str, given: list[tuple[int, int]], initials: list[int], roles: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        done, given = 0, set(given)
        starts = sorted({*given, *((i, m.end() - 1) for i in initials if (i == 0 or not (t[i - 1].isalnum() or t[i - 1] in "_.")) and (m := _INITIAL.match(t, i)))})
        known = {a for a, _ in starts}
        for _, b in roles:
            # A role before an unknown word: the word may be a damaged given name.
            gap = _AFTER_ROLE.match(t, b)
            m = gap and _TOKEN.match(t, gap.end())
            if m and m.start() not in known and len(m[0]) >= 3 and m[0] not in NOT_NAMES:
                starts.append((m.start(), m.end()))
        for a, b in sorted(starts):
            if a < done:
                continue
            if t[a:b].endswith("."):
                b = a + 2
            end = _surnames(t, b)
            if not end:
                # A surname may stand first, set off by a comma.
                last = _LAST_FIRST.search(t, max(done, a - 40), a) if (a, b) in given else None
                if not last or last[1] in NOT_NAMES or len(last[1]) < 3 or (last.start() and t[last.start() - 1].isalnum()) or FIRM.match(t, b):
                    continue
                a, end = last.start(), b
            if re.search(r"(?:Via|Viale|Piazza|rue|avenue)[ \n]+$", t[max(0, a - 9) : a]):
                continue
            yield a, end
            done = end


def redacted(raw: str, spans: list[tuple[int, int, str]]) -> str:
    """The stored text with typed placeholders for the spans; equal values of a kind share a number."""
    out, at, numbers = [], 0, {}
    for a, b, kind in spans:
        value = re.sub(r"\s+", " ", raw[a:b]).casefold()
        own = numbers.setdefault(kind, {})
        out += [raw[at:a], f"[{PREFIX[kind]}_{own.setdefault(value, len(own) + 1)}]"]
        at = b
    return "".join([*out, raw[at:]])


_FRAME = re.compile(rf"^\[?(?:(?:{'|'.join(TYPES)})[_: ]+)?\s*")
_WELL_FORMED = r"^\[[A-Z_]+_[0-9]{1,8}(?:_REDACTED)?\]$"


def leaked(raw: str, kind: str) -> tuple[int, int] | None:
    """The value of a malformed placeholder, between its type word and its bracket, if it is one of the kind."""
    start, end = _FRAME.match(raw).end(), len(raw) - raw.endswith("]")
    value = raw[start:end]
    digits = sum(c.isdigit() for c in value)
    words = [w for w in re.split(r"[\W\d_]+", value) if w and w.upper() not in TYPES]
    if kind == "email_address":
        good = any(x in value for x in AT)
    elif kind in ("phone_number", "identity_number"):
        good = digits >= 7
    elif kind == "address":
        good = bool(words) and digits > 0
    else:
        good = len(words) >= 2 and digits < 3 and any(len(w) > 1 for w in words)
    return (start, end) if good else None


def _finder(given: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given)
        for batch in batches:
            out = []
            for src, key, category, raw, rare in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if category in LEAKS:
                    spans = [(*x, LEAKS[category])] if (x := leaked(raw, LEAKS[category])) else []
                else:
                    plain = Plain(raw)
                    spans = [(plain.stored(a), plain.stored(b), k) for a, b, k in finder.spans(plain.text, rare)]
                if spans:
                    out.append((src, key, [k for *_, k in spans], [a for a, *_ in spans], [b for _, b, _ in spans], redacted(raw, spans)))
            cols = list(zip(*out, strict=True)) or [[] for _ in range(6)]
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["src", "row_key", "kinds", "starts", "ends", "redacted"])

    return run


def given_names(findings: DataFrame, least: int = LEAST) -> DataFrame:
    """``given, n``: tokens that stand first in names, and how often; counted over all findings."""
    name = rf"^([{UP}][{LOW}]{{2,}}) (?:.* )?([{UP}][{LOW}]+)$"
    f = findings.where("category = 'natural_person_name'").select(F.regexp_extract("sample", rf"^([{UP}][{LOW}]{{2,}}) [{UP}]", 1).alias("g"), F.regexp_extract("sample", name, 2).alias("z"))
    one = lambda c, first, last: F.struct(F.col(c).alias("given"), F.lit(first).alias("first"), F.lit(last).alias("last"))
    each = f.select(F.explode(F.array(one("g", 1, 0), one("z", 0, 1))).alias("x")).select("x.*").where("given <> ''")
    return each.groupBy("given").agg(F.sum("first").alias("n"), F.sum("last").alias("last")).where((F.col("n") >= least) & (F.col("n") > F.col("last"))).select("given", "n")


def split_names(names: DataFrame, limit: int = IN_AUTOMATON) -> tuple[list[str], DataFrame | None]:
    """The ``limit`` most frequent of ``given, n`` as a list, and the rest as a frame if there are more."""
    order = [F.col("n").desc(), F.col("given")]
    top = names.orderBy(*order).limit(limit + 1).collect()
    if len(top) <= limit:
        return sorted(r["given"] for r in top), None
    last = top[limit - 1]
    return sorted(r["given"] for r in top[:limit]), names.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("given") > last["given"]))).select("given")


def personal(texts: DataFrame, given: list[str], rare: DataFrame | None = None) -> DataFrame:
    """Texts of ``src, row_key, category, text`` that hold personal values.

    Columns out: ``src, row_key, kinds, starts, ends`` (arrays in order of appearance) and ``redacted``. ``category`` is
    that of a leaked placeholder, null elsewhere. Null and empty texts hold nothing; rows with equal keys come out once.
    ``rare`` (column ``given``) are further given names, too many for an automaton: capitalised words of the texts are
    joined with them, and what a text holds of them is sought in it."""
    key = ["src", "row_key"]
    t = texts.where("trim(text) <> ''").select(*key, "category", "text")
    if rare is None:
        t = t.withColumn("rare", F.array().cast("array<string>"))
    else:
        words = t.where("category is null").select(*key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"[{UP}][{UP}{LOW}]{{2,}}"), F.lit(0)))).alias("w")).select(*key, search_fold(F.col("w")).alias("w"))
        own = words.join(rare.select("given", search_fold(F.col("given")).alias("w")), "w").groupBy(*key).agg(F.collect_set("given").alias("rare"))
        t = t.join(own, key, "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    return t.mapInArrow(_finder(given), "src string, row_key string, kinds array<string>, starts array<bigint>, ends array<bigint>, redacted string").dropDuplicates(key)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string").alias("category")
    f = table(spark, sf_dir, "privacy_findings")
    leaked = f.where(~F.col("placeholder").rlike(_WELL_FORMED) & F.col("category").isin(*LEAKS, *CONTEXT)).select(F.lit("privacy_findings.placeholder").alias("src"), F.col("id").cast("string").alias("row_key"), F.col("placeholder").alias("text"), "category")
    return union(
        rows_of(spark, sf_dir, "ocr_pages", "ocr_pages.text", "id", "text", none),
        rows_of(spark, sf_dir, "gold_labels", "gold_labels.ocr_text", "id", "ocr_text", none),
        rows_of(spark, sf_dir, "privacy_findings", "privacy_findings.sample", "id", "sample", none, where=f"category in {CONTEXT}"),
        leaked,
    )


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(inputs(spark, sf_dir), *split_names(given_names(table(spark, sf_dir, "privacy_findings"))))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped: Column = F.arrays_zip("kinds", "starts")
    return p1_redacted(spark, sf_dir).select("src", "row_key", F.explode(zipped).alias("x")).select("src", "row_key", F.col("x.kinds").alias("kind"), F.col("x.starts").alias("start_offset"))


def queries():
    return {"p1_found": p1_found, "p1_redacted": p1_redacted}


def oracle_sql():
    return {}
