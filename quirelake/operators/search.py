"""Literal full-text search over page texts, with offsets, ordinals and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import excerpt, match_starts

LIMIT = 500  # results of one search (fixed value)


def search(pages: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``(key, page_match_index, start_offset, end_offset, excerpt)`` of every match of ``query``.

    Matches are literal, case-insensitive, left to right and do not overlap. A blank query
    and null or empty texts have none. Offsets are those of the lower-case text.
    """
    found = pages.select(F.col(key), F.col(text).alias("t"), F.posexplode(match_starts(F.col(text), query)).alias("page_match_index", "start_offset"))
    end = F.col("start_offset") + F.lit(len(query))
    return found.select(
        key, "page_match_index", "start_offset", end.alias("end_offset"), excerpt(F.col("t"), F.col("start_offset"), end).alias("excerpt")
    )


def ordered(matches: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` matches by page and offset, with their overall ordinal from 0.

    Only the limited rows are numbered, so no window runs over all matches.
    """
    top = matches.orderBy(key, "start_offset").limit(limit)
    return top.withColumn("match_index", F.row_number().over(Window.orderBy(key, "start_offset")) - 1)


def occurrences(text: Column, query: Column) -> Column:
    """Number of non-overlapping occurrences of ``query`` in ``text``, ignoring case."""
    low, q = F.lower(text), F.lower(query)
    return F.when(F.length(q) > 0, (F.length(low) - F.length(F.replace(low, q, F.lit("")))) / F.length(q)).otherwise(0).cast("long")


def newest_text(pages: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """One row for each page: the newest extraction that has any text, else the newest.

    Combined before the shuffle: the choice is a maximum of a struct, not a window.
    """
    filled = F.coalesce(F.col(text), F.lit("")) != ""
    best = F.max(F.struct(filled.alias("filled"), *[F.col(c) for c in order], F.col(text).alias("text"))).alias("b")
    return pages.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in order], F.col("b.text").alias("text"))
