"""Sessions of the website's visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.sessions import sessionize
from quirelake.plans.registry import query
from quirelake.runtime import table

_SESSION_SQL = """
WITH v AS (SELECT DISTINCT id, visitor_hash, epoch_us(created_at) AS t FROM landing_page_view WHERE visitor_hash <> ''),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1800000000 THEN 1 ELSE 0 END AS brk FROM v WINDOW w AS (PARTITION BY visitor_hash ORDER BY t)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY visitor_hash ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g)
"""


@query(_SESSION_SQL + "SELECT visitor_hash, min(t) AS start_us, max(t) AS end_us, count(*) AS n_views FROM s GROUP BY visitor_hash, no")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    views = table(spark, folder, "landing_page_view")
    return sessionize(views).select("visitor_hash", "start_us", "end_us", F.col("n_events").alias("n_views"))


@query(
    _SESSION_SQL
    + ", x AS (SELECT visitor_hash, max(t) - min(t) AS d, count(*) AS n FROM s GROUP BY visitor_hash, no) "
    "SELECT n AS n_views, count(*) AS n_sessions, CAST(sum(d) AS BIGINT) AS total_us FROM x GROUP BY n"
)
def p5_lengths(spark: SparkSession, folder: str) -> DataFrame:
    views = table(spark, folder, "landing_page_view")
    return (
        sessionize(views)
        .groupBy(F.col("n_events").alias("n_views"))
        .agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("duration_us").alias("total_us"))
    )
