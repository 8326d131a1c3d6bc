"""How a redacted document compares with its source, part by part."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.sources.documents import DOCX_PARTS, Package, Unreadable, _local, _xml

# Parts that hold no text of the document.
BENIGN = ("[Content_Types].xml", "word/settings.xml", "word/webSettings.xml", "word/styles.xml", "word/stylesWithEffects.xml", "word/fontTable.xml", "word/numbering.xml")
BENIGN_FOLDERS = ("docProps/", "customXml/itemProps", "word/theme/", "word/media/", "word/fonts/")
_SCHEMA = "path string, part string, kind string, nodes int, filled int, chars int, paragraphs int, tables int, broken boolean"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                pack = Package(data or b"")
            except Unreadable:
                out.append((path, None, "unreadable", 0, 0, 0, 0, 0, True))
                continue
            for name in pack.names:
                if not (name.startswith(DOCX_PARTS) and name.endswith(".xml")):
                    benign = name in BENIGN or name.startswith(BENIGN_FOLDERS) or name.endswith(".rels")
                    out.append((path, name, "benign" if benign else "unscanned", 0, 0, 0, 0, 0, False))
                    continue
                try:
                    nodes = list(_xml(pack.read(name)).iter())
                except (Unreadable, ElementTree.ParseError, zipfile.BadZipFile):
                    out.append((path, name, "text", 0, 0, 0, 0, 0, True))
                    continue
                texts = [n.text or "" for n in nodes if _local(n) == "t"]
                count = lambda kind, nodes=nodes: sum(_local(n) == kind for n in nodes)
                out.append((path, name, "text", len(texts), sum(map(bool, texts)), sum(map(len, texts)), count("p"), count("tbl"), False))
        kinds = [pa.string()] * 3 + [pa.int32()] * 5 + [pa.bool_()]
        cols = list(zip(*out, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])


def parts(files: DataFrame) -> DataFrame:
    """Parts of ``path, content``: ``path, part, kind`` (text, benign, unscanned; unreadable without a part), numbers of
    text nodes, of filled ones, of characters, paragraphs and tables, and whether it does not parse."""
    return files.select("path", "content").mapInArrow(_stats, _SCHEMA)


def unscanned(files: DataFrame) -> DataFrame:
    """Parts that are neither read nor known to hold no text."""
    p = parts(files)
    return p.select("path", "part").join(p.where("kind in ('text', 'benign')").select("path", "part"), ["path", "part"], "left_anti").where("part is not null")


def compared(source: DataFrame, redacted: DataFrame) -> DataFrame:
    """Text parts of both by ``path`` and ``part``: ``status`` (fail where one does not parse, warn where a part is on one
    side only or its structure differs, else pass), the numbers of text nodes, and what was added of each kind."""
    a, b = (parts(x).where("kind = 'text'") for x in (source, redacted))
    z = lambda c: F.coalesce(c, F.lit(0))
    j = a.alias("a").join(b.alias("b"), ["path", "part"], "full")
    delta = {k: z(F.col(f"b.{k}")) - z(F.col(f"a.{k}")) for k in ("nodes", "chars", "paragraphs", "tables")}
    both = F.col("a.kind").isNotNull() & F.col("b.kind").isNotNull()
    broken = F.coalesce("a.broken", F.lit(False)) | F.coalesce("b.broken", F.lit(False))
    moved = (delta["nodes"] != 0) | (delta["paragraphs"] != 0) | (delta["tables"] != 0)
    status = F.when(~both, "warn").when(broken, "fail").when(moved, "warn").otherwise("pass")
    side = F.when(F.col("b.kind").isNull(), "missing").when(F.col("a.kind").isNull(), "added").otherwise("both")
    return j.select("path", "part", status.alias("status"), side.alias("presence"), z(F.col("a.nodes")).alias("nodes_before"), z(F.col("b.nodes")).alias("nodes_after"), *(v.alias(f"{k}_delta") for k, v in delta.items()))
