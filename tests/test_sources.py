from __future__ import annotations

import io
import zipfile

import pytest

from docveil.sources import documents as d

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


def docx(*paragraphs: list[str], **parts: str) -> bytes:
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs)
    return package({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "[Content_Types].xml": "<x/>", **parts})


def test_docx_in_reading_order():
    extra = {"word/header1.xml": f'<w:hdr xmlns:w="{W}"><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>', "word/footer1.xml": f'<w:ftr xmlns:w="{W}"><w:p><w:r><w:t>Foot</w:t></w:r></w:p></w:ftr>'}
    assert d.extract("a.docx", docx(["Ay", "şe Kaya"], ["İkinci  satır"], **extra)) == ("Head\n\nAyşe Kaya\nİkinci  satır\n\nFoot", None)


def test_xlsx():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    data = package({
        "xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="Maaşlar"/></sheets></workbook>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Ayşe</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>10000000146</v></c><c t="inlineStr"><is><t>satır</t></is></c></row></sheetData><headerFooter><oddHeader>&amp;LAnonim&amp;C&amp;"Arial"&amp;12R&amp;&amp;D</oddHeader></headerFooter></worksheet>',
    })
    text, warning = d.extract("a.xlsx", data)
    assert text.split("\n") == ["Maaşlar", "Ayşe", "Anonim\t  R&D", "10000000146", "satır"] and warning is None


def test_zip_members_and_refusals():
    data = package({"a.txt": "bir", "b.zip": b"PK", "c.docx": docx(["iki"]), "d.bin": b"x"})
    assert d.extract("x.zip", data) == ("[a.txt]\nbir\n\n[c.docx]\niki", "Not extracted: b.zip, d.bin")


def test_plain_markup_and_failures():
    assert d.extract("a.txt", b"sat\xc4\xb1r \xff\r\n") == ("satır \r\n", None)
    assert d.extract("a.udf", package({"content.xml": "<r><p>Bir</p><p>&#304;ki</p></r>"}))[0] == "Bir\nİki"
    assert d.extract("a.udf", "<p>Kırık".encode("cp1254"))[0] == "Kırık"
    assert d.extract("a.docx", b"no zip")[1].startswith("Extraction failed")
    assert d.extract("a.png", b"")[1] == d.OCR_WARNING
    evil = package({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    assert "refused" in d.extract("a.docx", evil)[1]


def test_limit_is_told():
    text, warning = d.extract("a.txt", b"x" * (d.TEXT_CHARS + 1))
    assert len(text) == d.TEXT_CHARS and str(d.TEXT_CHARS) in warning


def test_redacted_docx_over_runs():
    data = docx(["Ay", "şe Ka", "ya geldi"], ["AYŞE KAYA"])
    new = d.redact_docx(data, [("Ayşe Kaya", "[PERSON_1]")])
    assert d.extract("a.docx", new)[0] == "[PERSON_1] geldi\n[PERSON_1]"
    assert zipfile.ZipFile(io.BytesIO(new)).read("[Content_Types].xml") == b"<x/>"


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub").mkdir()
    for name, raw in (("a.txt", b"bir"), ("sub/b.docx", docx(["iki"])), (".git/c.txt", b"no"), ("~$d.txt", b"no"), ("e.exe", b"no")):
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["warning"]) for r in d.extracted(d.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("bir", None), "b.docx": ("iki", None)}


def test_null_content(spark):
    df = spark.createDataFrame([("a.txt", None), (None, bytearray(b"x"))], "path string, content binary")
    assert sorted(r["warning"] for r in d.extracted(df).collect()) == ["No content.", "Unsupported file type."]


def test_document_types_are_refused_wherever_they_stand():
    late = "<!--" + "x" * 5000 + '--><!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'
    wide = '<?xml version="1.0" encoding="utf-16"?><!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'.encode("utf-16")
    for evil in (late, wide):
        assert "refused" in d.extract("a.docx", package({"word/document.xml": evil}))[1]
        assert "refused" in d.extract("a.xlsx", package({"xl/worksheets/sheet1.xml": evil}))[1]
        with pytest.raises(d.Unreadable):
            d.redact_docx(package({"word/document.xml": evil}), [("a", "b")])


def test_redaction_folds_case_and_diacritics():
    data = docx(["İstanbul'da AYŞE KAYA geldi, Ayse  Kaya gitti"], ["ayşe", " KAYA'nın İli"])
    new = d.extract("a.docx", d.redact_docx(data, [("Ayşe Kaya", "[P]")]))[0]
    assert new == "İstanbul'da [P] geldi, [P] gitti\n[P]'nın İli"


def test_redaction_stays_within_paragraphs():
    data = docx(["son Ay"], ["şe Kaya yok"], ["Kaya"])
    assert d.redact_docx(data, [("Ayşe Kaya", "[P]")]) and d.extract("a.docx", d.redact_docx(data, [("Ayşe Kaya", "[P]")]))[0] == "son Ay\nşe Kaya yok\nKaya"
    tabs = package({"word/document.xml": f'<w:document xmlns:w="{W}"><w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>Ayşe</w:t><w:tab/><w:t>Kaya</w:t><w:br/><w:t>Kaya</w:t></w:r></w:p></w:document>'})
    assert d.extract("a.docx", tabs)[0] == "Ayşe\tKaya\nKaya"
    assert d.extract("a.docx", d.redact_docx(tabs, [("Ayşe Kaya", "[P]")]))[0] == "[P]\nKaya"


def test_deleted_text_is_redacted_too():
    data = package({"word/document.xml": f'<w:document xmlns:w="{W}"><w:p><w:del><w:r><w:delText>Ayşe Kaya</w:delText></w:r></w:del></w:p></w:document>'})
    assert b"Ay" not in zipfile.ZipFile(io.BytesIO(d.redact_docx(data, [("Ayşe Kaya", "[P]")]))).read("word/document.xml").replace(b"encoding", b"")


def test_redaction_reads_within_limits(monkeypatch):
    monkeypatch.setattr(d, "MEMBER_BYTES", 50)
    with pytest.raises(d.Unreadable):
        d.redact_docx(package({"media/x.bin": b"x" * 51}), [])


def test_markup_that_does_not_parse():
    assert d.from_markup("a < b & c") == "a < b & c"
    assert d.from_markup("<p>bir<br>iki &amp; üç") == "bir iki & üç"
    assert d.from_markup("") == "" and d.from_markup("&#304;ki") == "İki"
