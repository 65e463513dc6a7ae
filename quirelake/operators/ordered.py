"""Order-dependent operators over events of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.runtime import micros

DAY_US = 86_400_000_000


def time_neighbours(df: DataFrame, keys: list[str], at: str, tie: str, width_us: int = DAY_US) -> DataFrame:
    """``df`` with ``event_us``, ``prev_us`` and ``next_us`` (microseconds) of the neighbours in the key's order.

    A key's rows are cut into ranges of ``width_us``; windows run inside a range, and only the
    first and last time of each range are compared across ranges. A key with a third of all
    rows thus spreads over its ranges. Equal times are ordered by ``tie``. Rows without a
    time and rows with a null key are left out; an empty table gives no rows.
    """
    rows = df.withColumn("event_us", micros(F.col(at))).where(F.col("event_us").isNotNull()).withColumn("_range", F.floor(F.col("event_us") / width_us))
    inside = Window.partitionBy(*keys, "_range").orderBy("event_us", tie)
    edges = rows.groupBy(*keys, "_range").agg(F.min("event_us").alias("lo"), F.max("event_us").alias("hi"))
    across = Window.partitionBy(*keys).orderBy("_range")
    edges = edges.select(*keys, "_range", F.lag("hi").over(across).alias("_before"), F.lead("lo").over(across).alias("_after"))
    near = rows.withColumn("_p", F.lag("event_us").over(inside)).withColumn("_n", F.lead("event_us").over(inside))
    out = near.join(edges, [*keys, "_range"])
    return out.withColumn("prev_us", F.coalesce("_p", "_before")).withColumn("next_us", F.coalesce("_n", "_after")).drop("_p", "_n", "_before", "_after", "_range")


def per_group(df: DataFrame, keys: list[str], order: list[str], values: list[str], fn: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows ``fn(key, rows)`` yields for each group, whose rows come in order as tuples of ``order + values``.

    Groups are laid side by side by a sort inside the partitions and streamed, so neither a
    group nor a call for each group has to fit in memory or pay a batch of its own.
    """
    columns, n = [*keys, *order, *values], len(keys)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    lined = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        def rows():
            for pdf in batches:
                yield from zip(*(pdf[c].tolist() for c in columns))

        out: list[tuple] = []
        for key, group in groupby(rows(), key=lambda r: r[:n]):
            for row in fn(key, (r[n:] for r in group)):
                out.append(row)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    return lined.mapInPandas(run, schema)


def _typed(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)


def debounce(df: DataFrame, keys: list[str], at: str, tie: str, wait_us: int) -> DataFrame:
    """Rows after which their key is silent for more than ``wait_us``; the last row always stays."""
    near = time_neighbours(df, keys, at, tie)
    return near.where(F.col("next_us").isNull() | (F.col("next_us") - F.col("event_us") > wait_us)).select(*df.columns)


def runs(df: DataFrame, keys: list[str], at: str, tie: str, gap_us: int) -> DataFrame:
    """``df`` with ``event_us`` and the ``run`` number: a distance over ``gap_us`` starts a new run.

    Run numbers are the running count of starts; only starts, not rows, are windowed by key.
    """
    near = time_neighbours(df, keys, at, tie).withColumn("_start", F.col("prev_us").isNull() | (F.col("event_us") - F.col("prev_us") > gap_us))
    days = near.withColumn("_range", F.floor(F.col("event_us") / DAY_US))
    whole = days.groupBy(*keys, "_range").agg(F.count_if("_start").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy("event_us", tie).rowsBetween(Window.unboundedPreceding, 0)
    numbered = days.withColumn("_in", F.sum(F.col("_start").cast("long")).over(inside))
    return numbered.join(offsets, [*keys, "_range"]).withColumn("run", F.col("_base") + F.col("_in")).select(*df.columns, "event_us", "run")


def batches(df: DataFrame, keys: list[str], at: str, tie: str, silence_us: int, longest_us: int) -> DataFrame:
    """``(keys, run, batch, first_t, last_t, n)``: flushed after silence, or by the first arrival
    at least ``longest_us`` after the batch began (that arrival begins the next batch)."""

    def cut(key, rows):
        batch, first, last, n = 0, None, None, 0
        for t, _ in rows:
            if first is not None and t - first >= longest_us:
                yield (*key, batch, first, last, n)
                batch, first, n = batch + 1, None, 0
            first = t if first is None else first
            last, n = t, n + 1
        yield (*key, batch, first, last, n)

    found = runs(df, keys, at, tie, silence_us)
    return per_group(found, [*keys, "run"], ["event_us", tie], [], cut, f"{_typed(df, keys)}, run long, batch int, first_t long, last_t long, n long")


def throttle(df: DataFrame, keys: list[str], at: str, tie: str, pause_us: int) -> DataFrame:
    """``(keys, run, event_us, tie)``: rows let through, at most one each ``pause_us``; first and last of a run always."""

    def pick(key, rows):
        last, waiting = None, None
        for t, i in rows:
            waiting = (*key, t, i)
            if last is None or t - last >= pause_us:
                yield waiting
                last, waiting = t, None
        if waiting:
            yield waiting

    found = runs(df, keys, at, tie, pause_us)
    return per_group(found, [*keys, "run"], ["event_us", tie], [], pick, f"{_typed(df, keys)}, run long, event_us long, {_typed(df, [tie])}")


def accumulate(df: DataFrame, keys: list[str], at: str, tie: str, delta: str, step: float, idle_us: int, most: int = 3) -> DataFrame:
    """``(keys, tie, steps)``: whole steps of the summed deltas, reset by a turn or an idle gap.

    Each row adds its delta; as many whole steps as the sum holds, at most ``most``, are
    emitted and the rest is kept.
    """

    def walk(key, rows):
        total, way = 0.0, 0
        for _, i, d in rows:
            turn = (d > 0) - (d < 0)
            if turn and turn != way:
                total, way = 0.0, turn
            total += d if d == d else 0.0
            steps = min(most, int(abs(total) // step))
            total -= way * steps * step
            yield (*key[:-1], i, steps * way)

    found = runs(df, keys, at, tie, idle_us)
    return per_group(found, [*keys, "run"], ["event_us", tie], [delta], walk, f"{_typed(df, [*keys, tie])}, steps int")


def newest(df: DataFrame, keys: list[str], at: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key; Spark prunes each partition to ``n`` a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def within_budget(df: DataFrame, keys: list[str], at: str, tie: str, size: str, most: int, budget: float) -> DataFrame:
    """The newest rows of each key, at most ``most`` of them and ``budget`` in size together."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = newest(df, keys, at, tie, most).withColumn("_s", F.sum(size).over(w))
    return kept.where(F.col("_s") <= budget).drop("_s")
