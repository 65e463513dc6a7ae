"""Joins between what a viewer shows and what its tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.functions.files import destination_index


def text_runs(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys..., run, run_start, run_end, run_text)``: the lines of each text with their offsets.

    A line break counts one character and belongs to no run. Null texts have no runs, an empty
    text has one empty run.
    """
    lines = F.split(F.col(text), "\n", -1)
    spans = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,t:string>>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["all"], F.array(F.struct(acc["at"].alias("s"), x.alias("t")))).alias("all")),
        lambda acc: acc["all"],
    )
    runs = texts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(spans).alias("run", "x"))
    return runs.select(*keys, "run", F.col("x.s").alias("run_start"), (F.col("x.s") + F.length("x.t")).alias("run_end"), F.col("x.t").alias("run_text"))


def clipped_hits(runs: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits ``(keys..., start_offset, end_offset)`` on the runs they overlap, clipped to them.

    Adds ``run, clip_start, clip_end`` (offsets within the run). Touching is no overlap.
    """
    met = hits.join(runs.drop("run_text"), keys).where((F.col("start_offset") < F.col("run_end")) & (F.col("end_offset") > F.col("run_start")))
    return met.select(
        *hits.columns,
        "run",
        (F.greatest("start_offset", "run_start") - F.col("run_start")).alias("clip_start"),
        (F.least("end_offset", "run_end") - F.col("run_start")).alias("clip_end"),
    )


def aligned(hits: DataFrame, context: int = 40) -> DataFrame:
    """The occurrence on the shown text that a kept match most likely is.

    ``hits`` has ``(hit, text, word, before, after, expected)``; the answer is ``(hit, best)``,
    the index of the occurrence of ``word`` with the largest agreement of context, less its
    distance from ``expected``; of equals the first. Hits without an occurrence give no row.
    """
    flat = lambda c: F.lower(tx.squeeze(c))
    found = hits.where(F.col("text").isNotNull() & (F.length("word") > 0)).withColumn("parts", F.split(F.lower("text"), F.regexp_replace(F.lower("word"), r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"), -1))
    starts = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1),
        lambda i: F.struct(i.alias("i"), (F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * F.length("word")).alias("s")),
    )
    each = found.where(F.size("parts") > 1).select("hit", "text", "word", "before", "after", "expected", F.explode(starts).alias("o"))
    lo = F.greatest(F.col("o.s") - context, F.lit(0))
    own_before = flat(F.substring("text", lo + 1, F.col("o.s") - lo))
    own_after = flat(F.substring("text", F.col("o.s") + F.length("word") + 1, F.lit(context)))
    score = tx.common_suffix(flat(F.col("before")), own_before) + tx.common_prefix(flat(F.col("after")), own_after) - F.abs(F.col("o.i") - 1 - F.col("expected"))
    best = F.max(F.struct(score.alias("p"), (-F.col("o.i")).alias("i"))).alias("m")
    return each.groupBy("hit").agg(best).select("hit", (-F.col("m.i") - 1).alias("best"))


def destinations(items: DataFrame, names: DataFrame, refs: DataFrame, pages: DataFrame) -> DataFrame:
    """``(file, item, page_index)`` of outline items.

    ``items`` has ``(file, item, name, ref, number)``: a named destination, a page's reference or a
    number. Names are resolved by ``names (file, name, ref, number)``, references by
    ``refs (file, ref, page_index)``, numbers by the file's ``pages (file, n_pages)``. What
    resolves to nothing has a null page.
    """
    known = names.select("file", "name", F.col("ref").alias("ref2"), F.col("number").alias("number2"))
    named = items.join(known, ["file", "name"], "left")
    full = named.select("file", "item", F.coalesce("ref", "ref2").alias("ref"), F.coalesce("number", "number2").alias("number"))
    placed = full.join(refs, ["file", "ref"], "left").join(pages, "file", "left")
    return placed.select("file", "item", F.coalesce(F.when(F.col("ref").isNotNull(), F.col("page_index").cast("long")).otherwise(destination_index(F.col("number"), F.col("n_pages")))).alias("page_index"))


def hydrated(comments: DataFrame, keys: str = "keys") -> DataFrame:
    """``(id, text, from_key)``: comments without text get that remembered under their strongest key.

    ``comments`` has ``(id, text, has_note, keys array)``. Under a key the text of the latest
    comment (largest id) that has one is remembered. Comments with a note or a text keep their own.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    memory = comments.where(~blank).select("id", "text", F.explode(keys).alias("key")).groupBy("key").agg(F.max_by("text", "id").alias("known"))
    asking = comments.where(blank & ~F.coalesce("has_note", F.lit(False)))
    got = asking.select("id", F.posexplode(keys).alias("k", "key")).join(memory, "key").groupBy("id").agg(F.min(F.struct("k", "key", "known")).alias("m"))
    return comments.join(got, "id", "left").select("id", F.coalesce("m.known", "text").alias("text"), F.col("m.key").alias("from_key"))


def changed_sets(current: DataFrame, baseline: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, dirty)``: whether the rows of a key, counted with repetitions, differ from its baseline's."""
    signed = current.select(key, *columns, F.lit(1).alias("n")).unionAll(baseline.select(key, *columns, F.lit(-1).alias("n")))
    return signed.groupBy(key, *columns).agg(F.sum("n").alias("n")).groupBy(key).agg(F.bool_or(F.col("n") != 0).alias("dirty"))


def merged_order(groups: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """``(item, place)``: the members of the groups in their order, then the other items in theirs.

    ``groups (grp, grp_order)``, ``members (grp, item, item_order)``, ``items (item, own_order)``. An
    item of several groups stands where it comes first. Places are 1, 2, ... within ``part`` of the
    items where they have such a column, over all of them otherwise.
    """
    first = members.join(groups, "grp").groupBy("item").agg(F.min(F.struct("grp_order", "item_order")).alias("m"))
    late = items.join(first, "item", "left")
    by = Window.partitionBy("part") if "part" in items.columns else Window.partitionBy()
    order = by.orderBy(F.col("m").isNull(), "m.grp_order", "m.item_order", "own_order", "item")
    return late.select(*[c for c in ("part",) if c in items.columns], "item", F.row_number().over(order).alias("place"))
