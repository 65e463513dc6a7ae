"""Column functions for paths, exported files, destinations and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of image formats, the one that is written first.
FORMATS = {"png": [".png"], "jpeg": [".jpg", ".jpeg"], "tiff": [".tif", ".tiff"]}
RTL_CODES = ("heb", "syr")
OPENABLE = (".pdf", ".djvu", ".djv", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif")


def ending(path: Column) -> Column:
    """The file's ending with its dot, in lower case; '' without one (a leading dot is none)."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def image_export(path: Column, fallback: str = "png") -> Column:
    """``struct<path, format>``: the trimmed path, with the fallback's ending where it names no image."""
    flat = F.trim(path)
    kind = F.lit(None).cast("string")
    for name, ends in FORMATS.items():
        kind = F.coalesce(kind, F.when(ending(flat).isin(*ends), F.lit(name)))
    return F.struct(F.when(kind.isNull(), F.concat(flat, F.lit(FORMATS[fallback][0]))).otherwise(flat).alias("path"), F.coalesce(kind, F.lit(fallback)).alias("format"))


def numbered_name(path: Column, place: Column, count: Column) -> Column:
    """The name of the ``place``-th (from 1) of ``count`` exported files; a single one keeps the path."""
    stem, end = F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    number = F.when(place < 1000, F.lpad(place.cast("string"), 3, "0")).otherwise(place.cast("string"))
    return F.when(count == 1, path).otherwise(F.concat(stem, F.lit("-"), number, end))


def combined_name(first: Column, count: Column) -> Column:
    """Where the combination of ``count`` files, of which ``first`` is the first, is written."""
    stem = F.regexp_replace(first, r"\.[^./]*$", "")
    return F.when(count == 0, F.lit("combined.pdf")).when(count == 1, F.concat(stem, F.lit(".pdf"))).otherwise(F.concat(stem, F.lit("-combined.pdf")))


def valid_pages(pages: Column) -> Column:
    """Whether a list of numbers is one of pages: not empty, whole numbers from 1."""
    return F.coalesce((F.size(pages) > 0) & F.forall(pages, lambda p: p.isNotNull() & (p >= 1) & (F.floor(p) == p)), F.lit(False))


def destination_index(raw: Column, pages: Column) -> Column:
    """Page index of a destination's number: from 0 if in range, else from 1, else null."""
    n = raw.cast("long")
    return F.when((n >= 0) & (n < pages), n).when((n > 0) & (n <= pages), n - 1)


def remaining_ms(elapsed: Column, done: Column, total: Column) -> Column:
    """Milliseconds left at the mean pace so far; 0 before the first and after the last."""
    return F.when((done <= 0) | (total <= done), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(elapsed / done * (total - done) + 0.5))).cast("long")


def percent(phase: Column, done: Column, total: Column) -> Column:
    """Rounded percentage; null while preparing, 0 of nothing."""
    return F.when(phase == "preparing", F.lit(None)).when(total == 0, F.lit(0)).otherwise(F.floor(done / total * 100 + 0.5)).cast("long")


def rtl_first(codes: Column) -> Column:
    """Distinct codes in order, those written from right to left first; null and '' are none."""
    flat = F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != "")))
    return F.concat(F.filter(flat, lambda c: c.isin(*RTL_CODES)), F.filter(flat, lambda c: ~c.isin(*RTL_CODES)))


def stdout_pages(text: Column, expected: Column) -> Column:
    """Trimmed pages of a tool's output, cut at form feeds. With a positive ``expected`` count filled
    up or cut to it; else one blank page at the end is left out."""
    parts = F.split(text, "\f", -1)
    size = F.size(parts)
    lacking = F.greatest(expected - size, F.lit(0))
    fixed = F.slice(F.concat(parts, F.array_repeat(F.lit(""), lacking.cast("int"))), F.lit(1), expected)
    free = F.when((size > 1) & ~F.element_at(parts, -1).rlike(r"\S"), F.slice(parts, F.lit(1), size - 1)).otherwise(parts)
    return F.transform(F.when(expected > 0, fixed).otherwise(free), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def probed_pages(said: Column) -> Column:
    """The page count a tool said; null for what is no positive number."""
    n = F.regexp_extract(F.trim(said), r"^\+?(\d+)", 1).try_cast("int")
    return F.when(n > 0, n)


def probed_dpi(said: Column, default: int = 300) -> Column:
    return F.coalesce(probed_pages(said), F.lit(default))


def move_element(items: Column, source: Column, target: Column) -> Column:
    """The list with the element at ``source`` (from 0) moved to ``target``; unchanged if either is out of range."""
    n = F.size(items)
    inside = source.between(0, n - 1) & target.between(0, n - 1) & (source != target)
    rest = F.concat(F.slice(items, F.lit(1), F.greatest(source, F.lit(0))), F.slice(items, source + 2, F.greatest(n, F.lit(0))))
    moved = F.concat(F.slice(rest, F.lit(1), F.greatest(target, F.lit(0))), F.slice(items, source + 1, F.lit(1)), F.slice(rest, target + 1, n))
    return F.when(inside, moved).otherwise(items)


def open_route(paths: Column) -> Column:
    """How a list of existing paths is opened: ``djvu``, ``pdf``, ``combined``, ``invalid``, or null for none.

    All must be of a kind that can be opened; a DjVu document is opened alone only.
    """
    n = F.size(paths)
    known = F.forall(paths, lambda p: F.coalesce(ending(p).isin(*OPENABLE), F.lit(False)))
    djvu = F.exists(paths, lambda p: ending(p).isin(".djvu", ".djv"))
    return (
        F.when(n <= 0, F.lit(None).cast("string"))
        .when(~known, "invalid")
        .when(djvu, F.when(n == 1, "djvu").otherwise("invalid"))
        .when((n == 1) & (ending(F.get(paths, F.lit(0))) == ".pdf"), "pdf")
        .otherwise("combined")
    )


def version_parts(version: Column) -> Column:
    """A version's numbers, without a leading v, what follows a hyphen, and closing zeros, so
    that arrays compare as versions do; parts that are no number count 0."""
    flat = F.element_at(F.split(F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), "(?i)^v", ""), "-"), 1)
    parts = F.transform(F.split(flat, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    last = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(0), lambda acc, i: F.when(F.element_at(parts, i) != 0, i).otherwise(acc))
    return F.slice(parts, F.lit(1), last)


def geo(headers: Column) -> Column:
    """``struct<country, city, region>`` of a request's headers; null where one is missing."""
    part = lambda name: F.try_element_at(headers, F.lit(name))
    return F.struct(part("x-vercel-ip-country").alias("country"), part("x-vercel-ip-city").alias("city"), part("x-vercel-ip-country-region").alias("region"))


def recognition_response(ok: Column, text: Column, error: Column) -> Column:
    """``struct<success, text, error>``: a result as the text or, where it failed, the error."""
    return F.struct(ok.alias("success"), F.when(ok, F.coalesce(text, F.lit(""))).alias("text"), F.when(~ok, F.coalesce(error, F.lit("Unknown error"))).alias("error"))


LOCALES = ("en", "ru", "fr", "de", "es", "it", "pt", "nl")


def settings(raw: Column) -> Column:
    """Settings of a JSON text field by field; a field of another type has its default, and what
    is no JSON has all defaults."""
    v = F.try_parse_json(raw)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    text = lambda f: F.when(kind(f) == "STRING", F.try_variant_get(v, f"$.{f}", "string"))
    number = F.when(kind("version").rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), F.try_variant_get(v, "$.version", "int"))
    return F.struct(
        F.coalesce(number, F.lit(1)).alias("version"),
        F.coalesce(text("authorName"), F.lit("")).alias("author"),
        F.when(text("theme") == "dark", "dark").otherwise("light").alias("theme"),
        F.when(text("locale").isin(*LOCALES), text("locale")).otherwise("en").alias("locale"),
        F.when(kind("suppress") == "BOOLEAN", F.try_variant_get(v, "$.suppress", "boolean")).alias("suppress"),
        F.nullif(F.trim(text("skipped")), F.lit("")).alias("skipped"),
    )
