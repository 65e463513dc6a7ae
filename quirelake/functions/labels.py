"""Column functions for page labels, page ranges and spreads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals with their subtractive pairs.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(number: Column) -> Column:
    """Upper-case Roman form of a number, without an upper bound; '' below one.

    Each numeral's count follows from what the larger ones leave, so it is all arithmetic.
    """
    parts, rest = [], number
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return F.when(number < 1, F.lit("")).otherwise(F.concat(*parts))


def from_roman(column: Column) -> Column:
    """The number of a canonical Roman numeral in one case, else null."""
    upper = F.upper(column)
    digits = F.transform(
        F.split(upper, ""),
        lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0),
    )
    shifted = F.concat(F.slice(digits, 2, F.greatest(F.size(digits) - 1, F.lit(0))), F.array(F.lit(0)))
    total = F.aggregate(
        F.zip_with(digits, shifted, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda acc, x: acc + x
    )
    one_case = (column == upper) | (column == F.lower(column))
    return F.when(column.rlike("^[IVXLCDMivxlcdm]+$") & one_case & (total >= 1) & (roman(total) == upper), total)


def alphabetic(number: Column) -> Column:
    """A to Z, then AA, BB and so on; '' below one."""
    letter = F.char(F.lit(65) + F.pmod(number - 1, F.lit(26)))
    return F.when(number < 1, F.lit("")).otherwise(F.repeat(letter, (F.floor((number - 1) / 26) + 1).cast("int")))


def from_alphabetic(column: Column) -> Column:
    upper = F.upper(column)
    same = upper.rlike(r"^([A-Z])\1*$")
    return F.when(same, (F.length(upper) - 1) * 26 + F.ascii(upper) - 64)


def label(style: Column, prefix: Column, start: Column, offset: Column) -> Column:
    """Label of the page ``offset`` pages into a range; a null style is the prefix alone."""
    n = F.greatest(F.lit(1), start + offset)
    value = (
        F.when(style == "D", n.cast("string"))
        .when(style == "R", roman(n))
        .when(style == "r", F.lower(roman(n)))
        .when(style == "A", alphabetic(n))
        .when(style == "a", F.lower(alphabetic(n)))
        .otherwise(F.lit(""))
    )
    return F.when(style.isNull(), prefix).otherwise(F.concat(prefix, value))


def page_range(text: Column, total: Column) -> Column:
    """``struct<first, last>`` of '5' or '3-7' (any dash or '..', ends in any order) within a document."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[–—]", "-"), r"\.\.", "-"), r"\s+", "")
    form = r"^(\d{1,9})(?:-(\d{1,9}))?$"
    a = F.regexp_extract(flat, form, 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(flat, form, 2).try_cast("int"), a)
    fits = flat.rlike(form) & a.between(1, total) & b.between(1, total)
    return F.when(fits, F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("last")))


def pages_of(text: Column, total: Column) -> Column:
    """Sorted distinct pages of a list such as '1, 3-5'; parts that are no pages are left out."""
    form = r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9}))?\s*.*$"

    def span(part: Column) -> Column:
        a = F.regexp_extract(part, form, 1).try_cast("int")
        b = F.regexp_extract(part, form, 2).try_cast("int")
        lo, hi = F.greatest(a, F.lit(1)), F.least(F.coalesce(b, a), total)
        return F.when((lo <= hi) & a.isNotNull(), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), span))))


def spread_start(page: Column, mode: Column, total: Column) -> Column:
    """First page of the spread a page is on; modes single, facing, facing-first-single."""
    p = F.greatest(F.lit(1), F.least(page, F.greatest(F.lit(1), total)))
    even = F.pmod(p, F.lit(2)) == 0
    return (
        F.when((mode == "single") | (total <= 1), p)
        .when(mode == "facing", F.when(even, p - 1).otherwise(p))
        .when(p == 1, F.lit(1))
        .when((F.pmod(total, F.lit(2)) == 0) & (p == total), total)
        .otherwise(F.when(even, p).otherwise(p - 1))
    )


def find_page(text: Column, total: Column, labels: Column) -> Column:
    """The page a reader means: its number, else the first page labelled so, else so in another case.

    Labels count only where there is one for each page; blank input means none.
    """
    flat = F.trim(text)
    number = F.when(flat.rlike(r"^\d{1,9}$"), flat.try_cast("int"))
    whole = F.size(labels) == total
    exact = F.array_position(labels, flat).cast("int")
    cased = F.array_position(F.transform(labels, lambda x: F.lower(x)), F.lower(flat)).cast("int")
    return (
        F.when(F.coalesce(flat, F.lit("")) == "", F.lit(None))
        .when(number.between(1, total), number)
        .when(whole & (exact > 0), exact)
        .when(whole & (cased > 0), cased)
        .cast("int")
    )


def page_indicator(page: Column, labels: Column) -> Column:
    """The page's label with its number behind, or the number alone where the label says no more."""
    said = F.nullif(F.trim(F.get(labels, page - 1)), F.lit(""))
    number = page.cast("string")
    return F.when(said.isNull() | (said == number), number).otherwise(F.concat(said, F.lit(" ("), number, F.lit(")")))
