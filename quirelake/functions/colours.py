"""Column functions for colours of outlines and annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hex(parts: Column) -> Column:
    """``#rrggbb`` of an array of numbers, rounded and kept within 0 to 255; what is no finite
    number counts as 0, and fewer than three parts have no colour."""

    def two(i: int) -> Column:
        v = F.get(parts, F.lit(i)).cast("double")
        v = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
        level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int")
        return F.lpad(F.lower(F.hex(level)), 2, "0")

    return F.when(F.size(parts) >= 3, F.concat(F.lit("#"), two(0), two(1), two(2)))


def bookmark_colour(column: Column) -> Column:
    """A colour as ``#rrggbb`` in lower case, from six or three digits; null for anything else."""
    flat = F.lower(F.trim(column))
    return F.when(flat.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(flat, "([0-9a-f])", "$1$1")).when(flat.rlike("^#[0-9a-f]{6}$"), flat)


def hex_parts(column: Column) -> Column:
    """The three levels of ``#rgb`` or ``#rrggbb`` as numbers from 0 to 1."""
    full = F.when(F.length(column) == 4, F.regexp_replace(column, "([0-9a-fA-F])", "$1$1")).otherwise(column)
    return F.array(*[F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6)])


def css_colour(parts: Column, opacity: Column) -> Column:
    """``rgba(r, g, b, opacity)`` of an array of at least three numbers, else null."""
    level = lambda i: F.get(parts, F.lit(i)).cast("string")
    return F.when(F.size(parts) >= 3, F.concat(F.lit("rgba("), F.concat_ws(", ", level(0), level(1), level(2), opacity.cast("string")), F.lit(")")))


def with_opacity(column: Column, opacity: Column) -> Column:
    """A hexadecimal colour with an opacity; other colours stay."""
    levels = F.transform(hex_parts(column), lambda x: F.round(x * 255).cast("int"))
    return F.when(column.startswith("#") & F.length(column).isin(4, 7), css_colour(levels, opacity)).otherwise(column)
