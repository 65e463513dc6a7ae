"""Parsers of the text and binary formats pages come in, as DataFrame operators."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_CONFIDENCE = 20  # of a recognised word (fixed value)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(page_number, file)`` of index manifests ``{version, pages: {number: {path}}}``.

    Manifests below version 2 and files that are no such JSON give no rows, as do keys that
    are no positive number.
    """
    schema = "version int, pages map<string, struct<path: string>>"
    m = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    pages = m.where("version >= 2").select(F.explode("pages").alias("n", "p"))
    return pages.select(F.col("n").try_cast("int").alias("page_number"), F.col("p.path").alias("file")).where("page_number > 0")


def tsv_words(lines: DataFrame, column: str) -> DataFrame:
    """Words of recognition lines with twelve tab-separated fields.

    Adds ``block, par, line_no, word_no, left, top, width, height, conf, text``; rows that are
    no word (level 5), are not sure enough, or have no size are left out.
    """
    # behind the generator the fields are an attribute: split once, whatever is asked of them
    lines = lines.withColumn("_fields", F.explode(F.array(F.split(F.col(column), "\t", 12))))
    f = F.col("_fields")
    num = lambda i: F.try_element_at(f, F.lit(i)).try_cast("double")
    whole = lambda i: num(i).cast("int")
    kept = lines.where((F.size(f) >= 12) & (whole(1) == 5) & (num(11) >= LEAST_CONFIDENCE) & (num(9) > 0) & (num(10) > 0))
    names = {"block": 3, "par": 4, "line_no": 5, "word_no": 6, "left": 7, "top": 8, "width": 9, "height": 10}
    return kept.select("*", *[whole(i).alias(n) for n, i in names.items()], num(11).alias("conf"), F.try_element_at(f, F.lit(12)).alias("text")).drop("_fields")


def words_to_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, block, par, line_no, line)``: words joined by spaces in their order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"])
    return words.groupBy(*keys, "block", "par", "line_no").agg(F.array_join(listed, " ").alias("line"))


def metadata(column: Column) -> Column:
    """``struct<key, value>`` of a line ``key "value"`` with backslash escapes; null for other lines."""
    form = r'^\s*([A-Za-z][A-Za-z0-9_-]*)\s+"((?:[^"\\]|\\.)*)"\s*$'
    value = F.regexp_replace(F.regexp_extract(column, form, 2), r"\\(.)", "$1")
    return F.when(column.rlike(form), F.struct(F.regexp_extract(column, form, 1).alias("key"), value.alias("value")))


def source_dpi(lines: DataFrame, keys: list[str], column: str, default: int = 300) -> DataFrame:
    """``(keys, dpi)``: the largest x or y resolution (fields 13 and 14) of image-list lines, in [72, 1200]."""
    f = F.split(F.trim(F.col(column)), r"\s+")
    part = lambda i: F.try_element_at(f, F.lit(i)).try_cast("int")
    best = F.max(F.greatest(part(13), part(14)))
    return lines.groupBy(*keys).agg(F.greatest(F.lit(72), F.least(F.lit(1200), F.coalesce(best, F.lit(default)))).alias("dpi"))


def parse_netpbm(data: bytes) -> tuple[int, int, int, bytes]:
    """``width, height, channels, pixels`` of a binary grey or colour map of eight bits."""
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("unsupported format")
    at, numbers = 2, []
    while len(numbers) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad header")
        numbers.append(int(data[at:end]))
        at = end
    width, height, top = numbers
    if width <= 0 or height <= 0:
        raise ValueError("no pixels")
    if top > 255:
        raise ValueError("only eight bits")
    channels = 1 if data[:2] == b"P5" else 3
    pixels = data[at + 1 : at + 1 + width * height * channels]
    if len(pixels) < width * height * channels:
        raise ValueError("truncated")
    return width, height, channels, pixels


def netpbm(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``(key, width, height, channels, pixels, error)``; files that are no such image have an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, data in zip(pdf[key], pdf[content]):
                try:
                    rows.append((k, *parse_netpbm(bytes(data or b"")), None))
                except ValueError as e:
                    rows.append((k, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "width", "height", "channels", "pixels", "error"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return files.select(key, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, width int, height int, channels int, pixels binary, error string")


def png_size(content: Column) -> Column:
    """``struct<width, height>`` of a PNG's header, null for other data."""
    head = F.hex(F.substring(content, 1, 24))
    part = lambda a: F.conv(F.substring(head, a, 8), 16, 10).cast("long")
    return F.when(head.startswith("89504E470D0A1A0A") & (F.length(head) == 48), F.struct(part(33).alias("width"), part(41).alias("height")))


def image_dpi(data: bytes, default: int = 72) -> int:
    """Resolution in a PNG's pHYs or a JPEG's JFIF header, else ``default``."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = data.find(b"pHYs")
        if at > 0 and len(data) >= at + 13 and data[at + 12] == 1:
            return round(struct.unpack(">I", data[at + 4 : at + 8])[0] * 0.0254) or default
    if data[:2] == b"\xff\xd8" and data[6:10] == b"JFIF" and len(data) > 17:
        unit, x = data[13], struct.unpack(">H", data[14:16])[0]
        return (x if unit == 1 else round(x * 2.54) if unit == 2 else default) or default
    return default


_OUTLINE = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("page_index", T.IntegerType())]))


def parse_outline(text: str | None) -> list[dict]:
    """Nodes of ``(bookmarks ("Title" "#page" (...)))`` in preorder; pages from 0; [] if it is none."""
    if not text:
        return []
    tokens: list[str] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c in "()":
            tokens.append(c)
            i += 1
        elif c == '"':
            part, i = "", i + 1
            while i < len(text) and text[i] != '"':
                if text[i] == "\\":
                    i += 1
                part += text[i : i + 1]
                i += 1
            tokens.append('"' + part)
            i += 1
        elif c.isspace():
            i += 1
        else:
            end = i
            while end < len(text) and text[end] not in '()" \n\t\r':
                end += 1
            tokens.append(text[i:end])
            i = end
    if tokens[:2] != ["(", "bookmarks"]:
        return []
    out: list[dict] = []
    stack: list[int | None] = []
    at = 2
    while at < len(tokens):
        if tokens[at] == "(":
            words = []
            at += 1
            while at < len(tokens) and tokens[at].startswith('"'):
                words.append(tokens[at][1:])
                at += 1
            page = int(words[1][1:]) - 1 if len(words) > 1 and words[1][:1] == "#" and words[1][1:].isdigit() else None
            out.append({"ordinal": len(out), "parent": stack[-1] if stack else None, "depth": len(stack), "title": words[0] if words else "", "page_index": page})
            stack.append(len(out) - 1)
        else:
            if tokens[at] == ")" and stack:
                stack.pop()
            at += 1
    return out


def outlines(documents: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, ordinal, parent, depth, title, page_index)`` of outlines in S-expressions."""

    @F.pandas_udf(_OUTLINE)
    def nodes(texts: pd.Series) -> pd.Series:
        return texts.map(parse_outline)

    return documents.select(key, F.explode(nodes(F.col(column))).alias("n")).select(key, "n.*")
