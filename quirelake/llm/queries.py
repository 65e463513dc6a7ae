"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import bpe, frequent, language, leaks, lookalike, scans, subjects, visitors
from quirelake.runtime import ship, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark, folder):
            ship(spark)
            return f(spark, folder)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FREQUENT_SQL = """
WITH v AS (SELECT DISTINCT id, path, referrer, user_agent FROM landing_page_view),
x AS (SELECT 'referrer' AS field, referrer AS item FROM v UNION ALL
      SELECT 'user_agent', user_agent FROM v UNION ALL SELECT 'path', path FROM v),
n AS (SELECT field, item, count(*) AS n_views FROM x WHERE item IS NOT NULL AND item <> '' GROUP BY 1, 2),
t AS (SELECT field, sum(n_views) AS total FROM n GROUP BY 1)
"""


@query(_FREQUENT_SQL + "SELECT n.field, n.item FROM n JOIN t USING (field) WHERE n.n_views >= 0.01 * t.total")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_counts(spark, folder).select("field", "item")


@query(_FREQUENT_SQL + "SELECT n.field, n.item, CAST(n.n_views AS BIGINT) AS n_views, CAST(t.total AS BIGINT) AS total FROM n JOIN t USING (field) WHERE n.n_views >= 0.01 * t.total")
def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    views = table(spark, folder, "landing_page_view")
    found = frequent.frequent(views, ["referrer", "user_agent", "path"], 0.01, "id")
    return found.withColumnRenamed("n", "n_views")


@query(
    """
WITH v AS (SELECT DISTINCT id, created_at, country, visitor_hash FROM landing_page_view),
vv AS (SELECT strftime(created_at, '%Y-%m-%d') AS view_day, coalesce(country, '') AS country, id, visitor_hash FROM v),
dd AS (SELECT strftime(created_at, '%Y-%m-%d') AS view_day, coalesce(country, '') AS country, visitor_hash FROM landing_download),
cells AS (SELECT view_day, country, count(*) AS n FROM vv GROUP BY 1, 2
          UNION ALL SELECT view_day, '*', count(*) FROM vv GROUP BY 1),
who AS (SELECT view_day, country, visitor_hash FROM vv UNION ALL SELECT * FROM dd),
allwho AS (SELECT * FROM who UNION ALL SELECT view_day, '*', visitor_hash FROM who),
d AS (SELECT view_day, country, count(DISTINCT visitor_hash) AS m FROM allwho WHERE visitor_hash <> '' GROUP BY 1, 2)
SELECT c.view_day, c.country FROM cells c LEFT JOIN d USING (view_day, country)
WHERE c.n >= 60 AND 4 * coalesce(d.m, 0) < c.n
"""
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return visitors.crowded_cells(table(spark, folder, "landing_page_view"), table(spark, folder, "landing_download"))


@query()
def p6_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return visitors.estimates(table(spark, folder, "landing_page_view"), table(spark, folder, "landing_download"))


def tokenizer_file(name: str) -> str:
    """A vocabulary file; the folder is the parameter QUIRELAKE_TOKENIZERS."""
    return os.path.join(os.environ.get("QUIRELAKE_TOKENIZERS", "/opt/tokenizers"), name)


#: How texts are cut into words before the merges; belongs to the public vocabulary (fixed value).
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@query()
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(
        table(spark, folder, "documents"), "doc_id", "text", tokenizer_file("byte_bpe_50k.tiktoken"), BYTE_BPE_PATTERN
    )


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    forms = p4_forms(spark, folder)
    return forms.select("field", "row_key", F.when(F.col("field") == "page", "").otherwise(F.col("plain")).alias("plain"))


@query()
def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_text").select("page_id", "text")
    requests, matches = table(spark, folder, "search_request"), table(spark, folder, "search_match")
    before, hit, after = (F.coalesce(F.col(f"excerpt.{x}"), F.lit("")) for x in ("before", "match", "after"))
    values = (
        requests.select(F.lit("query").alias("field"), F.col("request_id").alias("row_key"), F.col("query").alias("whole"), F.lit(0).alias("skip"), F.length("query").alias("size"))
        .unionAll(
            matches.where(F.col("excerpt.match").isNotNull()).select(
                F.lit("match"), F.concat_ws(":", "request_id", F.col("match_index").cast("string")), F.concat(before, hit, after), F.length(before), F.length(hit)
            )
        )
        .unionAll(pages.select(F.lit("page"), F.col("page_id").cast("string"), F.col("text"), F.lit(0), F.length("text")))
    )
    return lookalike.canonical_values(values, pages)


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.doubtful_pages(p2_segments(spark, folder))


@query()
def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    # a fixed table of ten codes
    codes = sorted(r["code"] for r in table(spark, folder, "ocr_language").select("code").collect())
    pages = table(spark, folder, "page_text").select("page_id", "pdf_path", "text", "lang")
    return language.label_segments(pages, codes)


@query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id")


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_parts(spark, folder).select("doc_id", "subject")


@query()
def p9_parts(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects(table(spark, folder, "documents"), table(spark, folder, "subject_label"))


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    furniture, split, misread = scans.repair(table(spark, folder, "page_text").select("page_id", "pdf_path", "text"))
    return (
        split.select("page_id", F.lit("split").alias("kind"), "piece")
        .unionAll(misread.select("page_id", F.lit("misread"), F.col("right")))
        .unionAll(furniture.select("page_id", F.lit("furniture"), "piece"))
        .distinct()
    )


@query()
def p3_pages(spark: SparkSession, folder: str) -> DataFrame:
    return scans.readable_pages(table(spark, folder, "page_text").select("page_id", "pdf_path", "text"))
