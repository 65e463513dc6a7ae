"""Column functions over text: search offsets, excerpts, normal forms, labels of sizes and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 40  # characters of an excerpt on either side (fixed value)
_SPACE = r"(?U)\s+"
#: White space as the reference's ``\s`` has it (in Java a byte order mark is none, and U+0085 is one).
_BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_EDGES = r"(?U)^\s+|\s+$"


def _literal(query: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", query)


def trim_all(column: Column) -> Column:
    """Without white space at the ends, Unicode spaces included."""
    return F.regexp_replace(column, _EDGES, "")


def squeeze(column: Column) -> Column:
    return F.regexp_replace(column, _SPACE, " ")


def comparable(column: Column) -> Column:
    """Trimmed, runs of white space made one, in lower case; null becomes ''."""
    return F.lower(squeeze(trim_all(F.coalesce(column, F.lit("")))))


def match_starts(text: Column, query: str) -> Column:
    """Offsets of the non-overlapping, case-insensitive literal matches of ``query``, left to right."""
    q = query.lower()
    parts = F.split(F.lower(text), _literal(q), -1)
    size = F.lit(len(q))
    ends = F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + size).alias("at"), F.concat(acc["all"], F.array(acc["at"] + F.length(p))).alias("all")
        ),
        lambda acc: acc["all"],
    )
    return F.when(F.lit(bool(q.strip())) & text.isNotNull(), ends).otherwise(F.array().cast("array<int>"))


def excerpt(text: Column, start: Column, end: Column, context: int = CONTEXT) -> Column:
    """``struct<prefix, suffix, before, match, after>`` around ``text[start:end]``."""
    lo = F.greatest(start - context, F.lit(0))
    hi = F.least(end + context, F.length(text))
    cut = lambda a, b: F.regexp_replace(F.substring(text, a + 1, b - a), _BLANK + "+", " ")
    return F.struct(
        (lo > 0).alias("prefix"),
        (hi < F.length(text)).alias("suffix"),
        F.regexp_replace(cut(lo, start), "^ ", "").alias("before"),
        cut(start, end).alias("match"),
        F.regexp_replace(cut(end, hi), r" \z", "").alias("after"),
    )


def shorten(column: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three of a shortened text being dots."""
    return F.when(F.length(column) > limit, F.concat(F.substring(column, 1, limit - 3), F.lit("..."))).otherwise(column)


def size_label(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB; two digits under ten, else one; '-' for what is no size."""
    value = size.cast("double")
    out = F.when(size.isNull() | F.isnan(value) | (value < 0), F.lit("-")).when(value < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        part = value / float(1024**k)
        text = F.when(part >= 10, F.format_string("%.1f", part)).otherwise(F.format_string("%.2f", part))
        labelled = F.concat(text, F.lit(f" {unit}"))
        out = out.otherwise(labelled) if unit == "TB" else out.when(part < 1024, labelled)
    return out


def file_size_label(size: Column) -> Column:
    """Bytes as B to GB; one digit under ten, else none; nothing positive has an unknown size."""
    value = size.cast("double")
    out = F.when(size.isNull() | F.isnan(value) | (value <= 0), F.lit("Unknown size"))
    for k, unit in enumerate(["B", "KB", "MB", "GB"]):
        part = value / float(1024**k)
        text = F.when(part >= 10, F.format_string("%.0f", part)).otherwise(F.format_string("%.1f", part))
        labelled = F.concat(text, F.lit(f" {unit}"))
        out = out.otherwise(labelled) if unit == "GB" else out.when(part < 1024, labelled)
    return out


def pdf_date(at: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+00'00'`` of a time in UTC."""
    return F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("+00'00'"))


def parse_pdf_date(column: Column) -> Column:
    """Seconds since 1970 of a PDF date with an offset; null for anything else."""
    form = r"^D:(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)([+-])(\d\d)'(\d\d)'$"
    part = lambda i: F.regexp_extract(column, form, i)
    local = F.unix_timestamp(F.to_timestamp(F.concat(*[part(i) for i in range(1, 7)]), "yyyyMMddHHmmss"))
    shift = (part(8).cast("int") * 3600 + part(9).cast("int") * 60) * F.when(part(7) == "-", -1).otherwise(1)
    return F.when(column.rlike(form), local - shift)


def escape_xml(column: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def site_url(column: Column) -> Column:
    """A site's address with a scheme and without closing slashes."""
    bare = F.regexp_replace(F.trim(column), r"/+$", "")
    return F.when(bare.rlike(r"(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def canonical_path(column: Column) -> Column:
    return F.when(column.isNull() | column.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(column, r"/+$", ""))


def _agree(a: Column, b: Column, part) -> Column:
    """Largest length at which ``part(text, from, size)`` of both texts agree, by halving steps."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]),
        F.when(n.isNotNull(), 0),
        lambda acc, size: F.when((size <= n - acc) & (part(a, acc, size) == part(b, acc, size)), acc + size).otherwise(acc),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading characters."""
    return _agree(a, b, lambda c, i, size: F.substring(c, i + 1, size))


def common_suffix(a: Column, b: Column) -> Column:
    """Number of equal closing characters."""
    return _agree(a, b, lambda c, i, size: F.substring(c, F.length(c) - i - size + 1, size))


def word_bounds(text: Column, at: Column) -> Column:
    """``struct<start, stop>`` of the word at an offset; from white space it moves to the nearest
    other character, left first, and stays in a text of white space only."""
    size = F.length(text)
    run = lambda part, form: F.length(F.regexp_extract(part, form, 0))
    before = lambda i: F.substring(text, F.lit(1), i)
    after = lambda i: F.substring(text, i + 1, size)
    left = at - run(before(at), _BLANK + r"*\z") - 1
    right = at + run(after(at), r"\A" + _BLANK + "*")
    near = (
        F.when(right == at, at)
        .when((left >= 0) & ((right >= size) | (at - left <= right - at)), left)
        .when(right < size, right)
    )
    word = _BLANK.replace("[", "[^", 1) + "*"
    return F.when(
        near.isNotNull(),
        F.struct((near - run(before(near), word + r"\z")).alias("start"), (near + run(after(near), r"\A" + word)).alias("stop")),
    ).when(size > 0, F.struct(at.alias("start"), (at + 1).alias("stop")))


def eta_label(ms: Column) -> Column:
    """Milliseconds left as ``m:ss``, at least a second; null for nothing left."""
    seconds = F.greatest(F.lit(1), F.floor(ms / 1000 + 0.5)).cast("long")
    return F.when(ms > 0, F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")))
