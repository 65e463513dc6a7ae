"""Writers: page indexes, DOCX files, grey maps and upserted lists."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEPT = {"\r": "&#13;"}  # else a reader takes it for a line break
#: Characters that XML cannot hold.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def write_index(pages: DataFrame, path: str, keys: list[str]) -> None:
    """Page texts as JSON lines, one folder for each key; the committer renames finished files."""
    pages.write.mode("overwrite").partitionBy(*keys).json(path)


def docx_bytes(text: str, rtl: bool = False) -> bytes:
    """A word-processor document with one paragraph for each line."""
    flag = "<w:pPr><w:bidi/></w:pPr>" if rtl else ""
    body = "".join(f'<w:p>{flag}<w:r><w:t xml:space="preserve">{escape(line, _KEPT)}</w:t></w:r></w:p>' for line in _FORBIDDEN.sub("", text).split("\n"))
    ns = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{ns}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def to_docx(documents: DataFrame, key: str, text: str, rtl: str | None = None) -> DataFrame:
    """``(key, content)``: each text as a document's bytes, built where the rows are.

    ``rtl`` names a column that tells texts written from right to left. Null texts give a
    document with one empty paragraph; characters that no document may hold are left out.
    """
    side = F.coalesce(F.col(rtl), F.lit(False)) if rtl else F.lit(False)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": [docx_bytes(t or "", bool(r)) for t, r in zip(pdf["_text"], pdf["_rtl"])]})

    rows = documents.select(key, F.col(text).alias("_text"), side.alias("_rtl"))
    return rows.mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, content binary")


def read_docx(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``(key, sound, paragraphs, rtl, text)`` of documents; what is no sound archive has nulls but for ``sound``."""

    def one(data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if z.testzip() is not None:
                    return False, None, None, None
                body = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return False, None, None, None
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        found = list(body.iter(f"{w}p"))
        return True, len(found), any(True for _ in body.iter(f"{w}bidi")), "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in found)

    def run(batches):
        for pdf in batches:
            rows = [(k, *one(data)) for k, data in zip(pdf[key], pdf[content])]
            yield pd.DataFrame(rows, columns=[key, "sound", "paragraphs", "rtl", "text"])

    return files.select(key, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, sound boolean, paragraphs long, rtl boolean, text string")


def grey_map(width: int, height: int, pixels: bytes) -> bytes:
    return f"P5\n{width} {height}\n255\n".encode() + pixels


def upsert_recent(known: DataFrame, opened: DataFrame, path: str, at: str, limit: int = 10) -> DataFrame:
    """The ``limit`` most recent files, each once with its newest time."""
    both = known.select(path, at).unionByName(opened.select(path, at))
    return both.groupBy(path).agg(F.max(at).alias(at)).orderBy(F.col(at).desc(), path).limit(limit)
