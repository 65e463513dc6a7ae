"""Sessions of activity by start-end pairing.

A session of a key is a maximal run of events in which no two neighbours are more than
``gap`` apart. The events are first folded into buckets as wide as the gap: two events of
one bucket are always less than the gap apart, so a bucket never holds a session border
and its first event, last event and count stand for all its events. A key with a third
of all rows thus reaches the window stage with at most two points per gap of covered time.
Copies are removed and buckets folded behind one shuffle by (key, bucket, salt).

Borders are then found without a running state: a RANGE frame of one gap before a point
that is empty marks a start, an empty frame of one gap behind it marks an end. The k-th
start of a key belongs to its k-th end, so both are numbered apart and joined on equal
rank; the count of a session is the difference of the cumulative ranks at its two ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.runtime import micros

GAP_US = 30 * 60 * 1_000_000
SALTS = 16


def sessionize(
    events: DataFrame,
    key: str = "visitor_hash",
    at: str = "created_at",
    row_id: str | None = "id",
    gap_us: int = GAP_US,
) -> DataFrame:
    """``(key, session_no, start_us, end_us, duration_us, n_events)``, one row per session.

    A distance of exactly ``gap_us`` stays in the session. Rows whose key is null or ''
    and rows without a time are in no session. Rows that share ``row_id`` and are whole
    copies count once; a null ``row_id`` is an event of its own; with ``row_id=None``
    every row is an event. An empty table gives no rows. Other columns are ignored.
    """
    rows = events.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(at).isNotNull())
    rows = rows.select(F.col(key).alias("k"), micros(F.col(at)).alias("t"), *([F.col(row_id).alias("i")] if row_id else []))
    rows = rows.withColumn("b", F.floor(F.col("t") / F.lit(gap_us)))
    facts = [F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")]
    if row_id:
        # one shuffle serves the removal of copies and the first folding; the salt splits a
        # bucket that holds many events, and copies share it as they share the id
        own = rows.withColumn("u", F.when(F.col("i").isNull(), F.monotonically_increasing_id()))
        own = own.withColumn("salt", F.pmod(F.xxhash64("i", "u"), F.lit(SALTS))).repartition("k", "b", "salt")
        part = own.groupBy("k", "b", "salt", "i", "u", "t").agg(F.lit(1).alias("one")).groupBy("k", "b", "salt").agg(*facts)
    else:
        part = rows.groupBy("k", "b").agg(*facts)
    # at most SALTS rows a bucket go on to the key's own partition, where the rest happens
    folded = (
        part.repartition("k")
        .groupBy("k", "b")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        .select(
            "k",
            F.explode(
                F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("t"), F.col("n").alias("n"))))
                .otherwise(
                    F.array(
                        F.struct(F.col("lo").alias("t"), (F.col("n") - 1).alias("n")),
                        F.struct(F.col("hi").alias("t"), F.lit(1).cast("long").alias("n")),
                    )
                )
            ).alias("p"),
        )
        .select("k", "p.t", "p.n")
    )
    by_time = Window.partitionBy("k").orderBy("t")
    points = folded.select(
        "k",
        "t",
        "n",
        (F.count(F.lit(1)).over(by_time.rangeBetween(-gap_us, -1)) == 0).alias("is_start"),
        (F.count(F.lit(1)).over(by_time.rangeBetween(1, gap_us)) == 0).alias("is_end"),
        F.sum("n").over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("rank_to"),
    ).where("is_start OR is_end")
    # starts and ends are numbered apart: a running count of each kind is its row number
    ranked = points.select(
        "*",
        F.sum(F.col("is_start").cast("long")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("s_no"),
        F.sum(F.col("is_end").cast("long")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("e_no"),
    )
    # equal ranks are joined by grouping on (key, rank): both sides already lie in one
    # partition by key, so the pairing needs no further shuffle
    halves = ranked.select(
        "k",
        F.explode(
            F.filter(
                F.array(
                    F.when(
                        F.col("is_start"),
                        F.struct(
                            F.col("s_no").alias("no"),
                            F.col("t").alias("s"),
                            F.lit(None).cast("long").alias("e"),
                            (F.col("rank_to") - F.col("n")).alias("r0"),
                            F.lit(None).cast("long").alias("r1"),
                        ),
                    ),
                    F.when(
                        F.col("is_end"),
                        F.struct(
                            F.col("e_no").alias("no"),
                            F.lit(None).cast("long").alias("s"),
                            F.col("t").alias("e"),
                            F.lit(None).cast("long").alias("r0"),
                            F.col("rank_to").alias("r1"),
                        ),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("h"),
    ).select("k", "h.*")
    paired = halves.groupBy("k", "no").agg(
        F.max("s").alias("start_us"), F.max("e").alias("end_us"), F.max("r0").alias("r0"), F.max("r1").alias("r1")
    )
    return paired.select(
        F.col("k").alias(key),
        F.col("no").alias("session_no"),
        "start_us",
        "end_us",
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        (F.col("r1") - F.col("r0")).alias("n_events"),
    )
