"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(key, start, end, n)`` of each key's sessions, emitted once the watermark has passed them.

    State is bounded by the open sessions; events later than ``late`` are dropped, as the
    watermark says.
    """
    timed = events.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    grouped = timed.groupBy(F.col(key), F.session_window("_at", gap)).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("start"), F.max("_at").alias("end"))
    return grouped.select(key, "start", "end", "n")


def daily_bitmaps(events: DataFrame, key: str, at: str, bits: int = 1024, late: str = "2 days") -> DataFrame:
    """Mergeable bitmaps of the identifiers of each day, ``(day, word, bits)``, kept as running state."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    placed = (
        events.where(F.col(key).isNotNull())
        .withColumn("_at", F.col(at).cast("timestamp"))
        .withWatermark("_at", late)
        .select(F.window("_at", "1 day").alias("day"), F.floor(h / 64).alias("word"), F.pmod(h, F.lit(64)).cast("int").alias("bit"))
    )
    return placed.groupBy("day", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).select(F.col("day.start").alias("day"), "word", "bits")


def throttled(events: DataFrame, key: str, at: str, pause_us: int) -> DataFrame:
    """``(key, t)``: at most one event of a key each ``pause_us``, by event time in arrival batches."""
    kind = events.schema[key].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for pdf in batches for x in pdf["t"]):
            if last is None or t - last >= pause_us:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "t": out})

    timed = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t")).where("t IS NOT NULL")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def append(stream: DataFrame, path: str, checkpoint: str):
    """Append-only ingestion of a stream into Parquet, exactly once; ends when the input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
