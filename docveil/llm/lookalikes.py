"""Characters that look like others: tables built from the Unicode database, and the letters of other scripts."""

from __future__ import annotations

import unicodedata
from functools import cache

#: Letters of other scripts, and the Latin letter each looks like, in the order of the strings.
CYRILLIC = "АВЕЅІЈКМНОРСТУХѴаеѕіјорсухһԁԛԝѵӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXVaesijopcyxhdqwvl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιορυχνϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXaiopuxvcj"
ARMENIAN = "ՍՕօսհոզ"
ARMENIAN_AS = "UOouhnq"

LETTERS = {ord(a): b for x, y in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS)) for a, b in zip(x, y, strict=True)}
#: Code points of letters of other scripts that look like Latin ones.
LOOKALIKE = frozenset(LETTERS)

#: Invisible characters beyond the format category, and unusual spaces beyond the space category.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180E))
BLANK = (0x2800,)
#: Decompositions whose result looks different from the sign, by the Unicode database's tag.
DIFFERENT = ("super", "sub", "fraction", "circle", "square", "initial", "medial", "final", "isolated", "vertical", "small")


@cache
def mapping() -> dict[int, tuple[str, str]]:
    """Code point to what it stands for and the kind of difference: width, space, invisible, joined, letter.

    The whole of Unicode is gone through, so the table is bounded by it, and nothing depends on the corpus.
    """
    out: dict[int, tuple[str, str]] = {}
    for cp in range(0x80, 0x2FA20):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cp in INVISIBLE or cat == "Cf":
            out[cp] = ("", "invisible")
        elif (cat == "Zs" and cp != 0x20) or cp in BLANK:
            out[cp] = (" ", "space")
        elif cp in LETTERS:
            out[cp] = (LETTERS[cp], "letter")
        else:
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            # Compatibility ideographs are the ideograph itself.
            if 0xF900 <= cp <= 0xFAFF or cp >= 0x2F800:
                if (to := unicodedata.normalize("NFC", ch)) != ch:
                    out[cp] = (to, "width")
                continue
            if not tag.startswith("<") or tag[1:-1] in DIFFERENT:
                continue
            to = unicodedata.normalize("NFKC", ch)
            if tag in ("<wide>", "<narrow>"):
                out[cp] = (to, "width")
            elif tag == "<noBreak>":
                out[cp] = (to, "width")
            elif tag == "<font>" and to.isascii():
                out[cp] = (to, "width")
            elif tag == "<compat>" and cat[0] == "L" and to.isalpha() and len(to) > 1 and "LIGATURE" in unicodedata.name(ch, ""):
                out[cp] = (to, "joined")
            elif tag == "<compat>" and cp == 0x017F:
                out[cp] = (to, "joined")
    for cp in (*range(0xFF01, 0xFF5F),):
        out[cp] = (chr(cp - 0xFEE0), "width")
    return out


@cache
def marks() -> dict[int, int]:
    """Combining marks and their class."""
    return {cp: c for cp in range(0x300, 0x2FA20) if (c := unicodedata.combining(chr(cp))) and unicodedata.category(chr(cp)) == "Mn"}


@cache
def compositions() -> dict[tuple[str, str], str]:
    """Starter and mark to the composed letter."""
    out = {}
    for cp in range(0xC0, 0x2FA20):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            a, b = (chr(int(x, 16)) for x in parts)
            if unicodedata.combining(b) and unicodedata.normalize("NFC", a + b) == chr(cp):
                out[a, b] = chr(cp)
    return out
