"""Batch forms of the timers and state machines, and small-series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.operators import ordered, series
from quirelake.plans.registry import query
from quirelake.runtime import table

MIN = 60_000_000


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


_NEAR = "WITH e AS (SELECT *, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER w AS nt, lag(epoch_us(ts)) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "


@query(_NEAR + "SELECT event_id FROM e WHERE nt IS NULL OR nt - t > 600000000")
def t03_debounced(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.debounce(_events(spark, folder), ["user_id"], "ts", "event_id", 10 * MIN).select("event_id")


@query(_NEAR + "SELECT user_id, event_id, CAST(sum(CASE WHEN pt IS NULL OR t - pt > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e")
def t02_idle_runs(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.runs(_events(spark, folder), ["user_id"], "ts", "event_id", 30 * MIN).select("user_id", "event_id", "run")


def _walked(key: str, gap_us: int, seed: str, step: str, out: str) -> str:
    """A twin that follows the events of a run one by one: ``seed`` from ``o`` where n = 1, ``step`` from ``w`` and the next ``o``."""
    return (
        f"WITH RECURSIVE e AS (SELECT {key} AS k, event_id, CASE WHEN event_type = 'error' THEN -value ELSE value END AS d, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS pt FROM events), "
        f"r AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {gap_us} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY t, event_id) AS n, count(*) OVER (PARTITION BY k, run) AS m FROM r), "
        f"w AS ({seed} UNION ALL {step}) {out}"
    )


_NEXT = "JOIN o ON o.k = w.k AND o.run = w.run AND o.n = w.n + 1"


@query(
    _walked(
        "user_id", 600 * MIN,
        "SELECT k, run, n, t, t AS began, 0 AS batch FROM o WHERE n = 1",
        f"SELECT o.k, o.run, o.n, o.t, CASE WHEN o.t - began >= {1200 * MIN} THEN o.t ELSE began END, CASE WHEN o.t - began >= {1200 * MIN} THEN batch + 1 ELSE batch END FROM w {_NEXT}",
        "SELECT k AS user_id, CAST(run AS BIGINT) AS run, CAST(batch AS INT) AS batch, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM w GROUP BY k, run, batch",
    )
)
def t02_batches(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.batches(_events(spark, folder), ["user_id"], "ts", "event_id", 600 * MIN, 1200 * MIN)


@query(
    _walked(
        "event_type", 30 * MIN,
        "SELECT k, run, n, m, t, event_id, t AS sent, true AS hit FROM o WHERE n = 1",
        f"SELECT o.k, o.run, o.n, o.m, o.t, o.event_id, CASE WHEN o.t - sent >= {30 * MIN} THEN o.t ELSE sent END, o.t - sent >= {30 * MIN} FROM w {_NEXT}",
        "SELECT k AS event_type, CAST(run AS BIGINT) AS run, t AS event_us, event_id FROM w WHERE hit OR n = m",
    )
)
def t05_throttled(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.throttle(_events(spark, folder), ["event_type"], "ts", "event_id", 30 * MIN)


@query(
    _walked(
        "user_id", 600 * MIN,
        "SELECT k, run, n, event_id, CAST(sign(d) AS INT) AS way, d - sign(d) * least(3, floor(abs(d) / 20)) * 20 AS kept, CAST(sign(d) * least(3, floor(abs(d) / 20)) AS INT) AS steps FROM o WHERE n = 1",
        "SELECT k, run, n, event_id, way, total - way * least(3, floor(abs(total) / 20)) * 20, CAST(way * least(3, floor(abs(total) / 20)) AS INT) FROM (SELECT o.k, o.run, o.n, o.event_id, CASE WHEN d <> 0 THEN CAST(sign(d) AS INT) ELSE way END AS way, CASE WHEN d <> 0 AND sign(d) <> way THEN 0 ELSE kept END + d AS total FROM w " + _NEXT + ")",
        "SELECT k AS user_id, event_id, steps FROM w",
    )
)
def t01_steps(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("delta", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")))
    return ordered.accumulate(e, ["user_id"], "ts", "event_id", "delta", 20.0, 600 * MIN)


@query("SELECT e.event_id, CAST((SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND x.ts < e.ts AND x.ts >= e.ts - INTERVAL 120 MINUTE) AS BIGINT) AS alive FROM events e")
def t07_entries_alive(spark: SparkSession, folder: str) -> DataFrame:
    from quirelake.runtime import micros

    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-120 * MIN, -1)
    return _events(spark, folder).withColumn("t", micros(F.col("ts"))).select("event_id", F.count(F.lit(1)).over(w).alias("alive"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def t09_ring_buffer(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.newest(_events(spark, folder), ["user_id"], "ts", "event_id", 20).select("event_id")


@query(
    "SELECT event_id FROM (SELECT event_id, row_number() OVER w AS k, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE k <= 20 AND s <= 20000"
)
def t11_undo_budget(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return ordered.within_budget(e, ["user_id"], "ts", "event_id", "cents", 20, 20000).select("event_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def t12_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def x28_json_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.where("k IS NOT NULL")


# ---- small series over lineitem ------------------------------------------------------------

_H = "WITH h AS (SELECT l_quantity AS v, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) "


@query(
    _H
    + ", r AS (SELECT v, sum(n) OVER (ORDER BY v) AS n0, sum(n * v) OVER (ORDER BY v) AS s0, sum(n) OVER () AS n, sum(n * v) OVER () AS s FROM h), "
    "b AS (SELECT v, CASE WHEN n > n0 THEN n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) ELSE 0 END AS b FROM r) SELECT v AS threshold FROM b ORDER BY b DESC, v LIMIT 1"
)
def a17_otsu(spark: SparkSession, folder: str) -> DataFrame:
    return series.otsu(table(spark, folder, "lineitem"), "l_quantity").select("threshold")


_S = "WITH h AS (SELECT l_returnflag AS f, CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT f, q, least(max(n) OVER (PARTITION BY f ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(n) OVER (PARTITION BY f ORDER BY q ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) - n AS d, max(n) OVER (PARTITION BY f ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, max(n) OVER (PARTITION BY f ORDER BY q ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM h) "


def _hist(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query(_S + "SELECT f, q, d AS depth FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d DESC, q) AS k FROM m WHERE a IS NOT NULL AND b IS NOT NULL) WHERE k = 1")
def w08_saddle(spark: SparkSession, folder: str) -> DataFrame:
    return series.saddle(_hist(spark, folder), ["f"], "q", "n")


@query(
    "WITH h AS (SELECT l_returnflag AS f, CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT f, avg(n) AS m FROM h GROUP BY 1), "
    "b AS (SELECT f, q, q - row_number() OVER (PARTITION BY f ORDER BY q) AS g FROM h WHERE n % 7 < 4), r AS (SELECT f, min(q) AS first_q, max(q) AS last_q FROM b GROUP BY f, g) "
    "SELECT f, first_q, last_q FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY last_q - first_q DESC, first_q) AS k FROM r) WHERE k = 1"
)
def w09_low_band(spark: SparkSession, folder: str) -> DataFrame:
    h = _hist(spark, folder).withColumn("m", F.col("n") % 7)
    return series.low_band(h, ["f"], "q", "m", 4).toDF("f", "first_q", "last_q")


@query("WITH h AS (SELECT l_returnflag AS f, CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT f, q, avg(n) OVER (PARTITION BY f ORDER BY q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean FROM h")
def w10_sliding_mean(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("f").orderBy("q").rowsBetween(-2, 2)
    return _hist(spark, folder).select("f", "q", F.avg("n").over(w).alias("mean"))


@query("WITH h AS (SELECT l_returnflag AS f, CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT f, q, (n - coalesce(lag(n) OVER (PARTITION BY f ORDER BY q), 0) + 256000000) % 256 AS up FROM h")
def w07_up_filter(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("f").orderBy("q")
    return _hist(spark, folder).select("f", "q", F.pmod(F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0)), F.lit(256)).alias("up"))


@query("SELECT l_orderkey, l_returnflag, score FROM (SELECT l_orderkey, l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(l_quantity) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def a15_weighted_vote(spark: SparkSession, folder: str) -> DataFrame:
    return series.vote(table(spark, folder, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity")


@query("SELECT l_suppkey, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) AS mean, round(stddev_pop(l_quantity), 4) AS spread, median(l_quantity) AS middle FROM lineitem GROUP BY 1")
def a14_weighted_stats(spark: SparkSession, folder: str) -> DataFrame:
    q, w = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(q * w) / F.sum(w), 6).alias("mean"), F.round(F.stddev_pop(q), 4).alias("spread"), F.median(q).alias("middle")
    )


@query()
def a18_curvature(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return series.curvature(li, ["l_suppkey"], "x", "y").select("l_suppkey", F.round("bend", 6).alias("bend"))


@query()
def w05_inferred_ranges(spark: SparkSession, folder: str) -> DataFrame:
    from quirelake.plans.layout import j03_page_labels

    labels = j03_page_labels(spark, folder).join(table(spark, folder, "page_text").select("page_id", "pdf_path", "page_number"), "page_id")
    one = labels.groupBy("pdf_path", "page_number").agg(F.min("label").alias("label"))
    return series.infer_label_ranges(one, ["pdf_path"], "page_number", "label")


@query("SELECT source AS item, 'both' AS side FROM (SELECT source FROM documents WHERE kind = 'note' INTERSECT SELECT source FROM documents WHERE kind = 'outline') UNION ALL SELECT source, 'notes only' FROM (SELECT source FROM documents WHERE kind = 'note' EXCEPT SELECT source FROM documents WHERE kind = 'outline')")
def u15_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    notes, outlines = (d.where(F.col("kind") == k).select(F.col("source").alias("item")) for k in ("note", "outline"))
    return notes.intersect(outlines).withColumn("side", F.lit("both")).unionAll(notes.subtract(outlines).withColumn("side", F.lit("notes only")))


@query("SELECT strategy, count(*) AS n, CAST(sum(o_orderkey % 1000) AS BIGINT) AS checksum FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('merge'), ('shuffle_hash'), ('broadcast')) s(strategy) GROUP BY 1")
def j22_join_strategies(spark: SparkSession, folder: str) -> DataFrame:
    # the same join by each strategy; the broadcast side is asked for its size by the planner's own limit
    o, c = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    out = None
    for name in ("merge", "shuffle_hash", "broadcast"):
        side = c if name == "broadcast" else c.hint(name)
        one = o.join(side, "k").agg(F.lit(name).alias("strategy"), F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") % 1000).cast("long").alias("checksum"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT o_orderkey, CAST(last_day(o_orderdate) - CAST(o_orderdate AS DATE) AS INT) AS days_left, CAST(o_orderkey & 255 AS BIGINT) AS low, CAST(xor(o_orderkey, o_custkey) AS BIGINT) AS mixed, regexp_extract(o_orderpriority, '^(\\d)-(\\w+)', 2) AS word FROM orders")
def x31_dates_bits_groups(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey", F.datediff(F.last_day(day), day).alias("days_left"), F.col("o_orderkey").bitwiseAND(255).cast("long").alias("low"),
        F.col("o_orderkey").bitwiseXOR(F.col("o_custkey")).cast("long").alias("mixed"), F.regexp_extract("o_orderpriority", r"^(\d)-(\w+)", 2).alias("word"),
    )
