"""Statistics over small ordered series: histograms, projections, curves and votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.ordered import per_group


def otsu(df: DataFrame, value: str) -> DataFrame:
    """``(threshold, variance)``: the value that splits best into two classes.

    The table is first counted by value; the windows run over the histogram, whose size is
    the number of different values (256 grey levels of an image).
    """
    h = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = h.select("v", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"))
    n1 = F.col("n") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    between = F.when(n1 > 0, F.col("n0") * n1 * apart * apart).otherwise(0.0)
    best = r.select(F.max(F.struct(between.alias("b"), (-F.col("v")).alias("k"))).alias("m"))
    return best.select((-F.col("m.k")).alias("threshold"), F.col("m.b").alias("variance"))


def saddle(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``(keys, at, depth)``: the deepest valley, by the lower of the two highest sides minus the value."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    sides = df.select(*keys, F.col(at), F.col(value), F.max(value).over(before).alias("a"), F.max(value).over(after).alias("b"))
    deep = sides.where("a IS NOT NULL AND b IS NOT NULL").select(*keys, F.struct((F.least("a", "b") - F.col(value)).alias("depth"), (-F.col(at)).alias("k")).alias("m"))
    return deep.groupBy(*keys).agg(F.max("m").alias("m")).select(*keys, (-F.col("m.k")).alias(at), F.col("m.depth").alias("depth"))


def low_band(df: DataFrame, keys: list[str], at: str, value: str, limit: float) -> DataFrame:
    """``(keys, first, last)`` of the longest run of neighbouring positions under ``limit``; the first wins ties."""
    low = df.where(F.col(value) < limit).select(*keys, F.col(at).alias("p"))
    island = F.col("p") - F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    bands = low.withColumn("g", island).groupBy(*keys, "g").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    best = bands.groupBy(*keys).agg(F.max(F.struct((F.col("last") - F.col("first")).alias("w"), (-F.col("first")).alias("k"), "last")).alias("m"))
    return best.select(*keys, (-F.col("m.k")).alias("first"), F.col("m.last").alias("last"))


def vote(df: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """``(keys, label, score)``: the label with the largest summed weight; ties by label."""
    sums = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.sum(weight).alias("score"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(label).alias("l"))).alias("m"))
    return best.select(*keys, F.col("m.l").alias(label), (-F.col("m.s")).alias("score"))


def curvature(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``(keys, bend)``: size of the quadratic coefficient of a least-squares parabola times the width.

    Solved from summed powers, so it is one aggregation; fewer than three different x give 0.
    """
    c = lambda p: F.sum(F.pow(F.col("_x"), F.lit(p)))
    centre = points.join(points.groupBy(*keys).agg(F.avg(x).alias("_m"), F.max(x).alias("_b"), F.min(x).alias("_a")), keys)
    scaled = centre.withColumn("_w", F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-12))).withColumn("_x", (F.col(x) - F.col("_m")) / F.col("_w"))
    sums = scaled.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_s0"), c(1).alias("_s1"), c(2).alias("_s2"), c(3).alias("_s3"), c(4).alias("_s4"),
        F.sum(y).alias("_t0"), F.sum(F.col("_x") * F.col(y)).alias("_t1"), F.sum(F.col("_x") * F.col("_x") * F.col(y)).alias("_t2"),
        F.count_distinct(x).alias("_k"), F.first("_w").alias("_width"),
    )
    d = "(_s0*(_s2*_s4-_s3*_s3) - _s1*(_s1*_s4-_s3*_s2) + _s2*(_s1*_s3-_s2*_s2))"
    a = "(_s0*(_s2*_t2-_t1*_s3) - _s1*(_s1*_t2-_t1*_s2) + _t0*(_s1*_s3-_s2*_s2))"
    return sums.select(*keys, F.expr(f"CASE WHEN _k < 3 OR {d} = 0 THEN 0D ELSE abs({a} / {d}) / _width END").alias("bend"))


def infer_label_ranges(labels: DataFrame, keys: list[str], page: str, label: str) -> DataFrame:
    """``(keys, start_page, style, prefix, start_number)``: ranges that explain a document's labels.

    From each start the explanation (constant, decimal, Roman, alphabetic) that holds for the
    longest run wins, of equal runs one that is not constant. The choice is sequential, so a
    document's labels are worked on together; a document has as many labels as pages.
    """
    import re

    def roman(n: int) -> str:
        out = ""
        for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out, n = out + s * (n // v), n % v
        return out

    def write(style: str | None, prefix: str, n: int) -> str:
        text = {None: "", "D": str(n), "R": roman(n), "r": roman(n).lower()}.get(style)
        if text is None:
            text = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1)
            text = text.lower() if style == "a" else text
        return prefix + text

    def explanations(text: str):
        yield None, text, 1
        if m := re.fullmatch(r"(.*?)([0-9]+)", text, re.S):
            yield "D", m[1], max(1, int(m[2]))
        if m := re.fullmatch(r"(.*?)([ivxlcdm]+|[IVXLCDM]+)", text, re.S):
            digits = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}[c] for c in m[2].upper()]
            n = sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0]))
            if n > 0 and roman(n) == m[2].upper():
                yield ("r" if m[2].islower() else "R"), m[1], n
        if m := re.fullmatch(r"(.*?)([A-Za-z]+)", text, re.S):
            s = m[2].lower()
            if s == s[0] * len(s):
                yield ("a" if m[2].islower() else "A"), m[1], (len(s) - 1) * 26 + ord(s[0]) - 96

    def walk(key, rows):
        texts = [t or "" for _, t in rows]
        at = 0
        while at < len(texts):
            best = (0, False, None)
            for style, prefix, n in explanations(texts[at]):
                size = 1
                while at + size < len(texts) and texts[at + size] == write(style, prefix, n + size):
                    size += 1
                if (size, style is not None) > best[:2]:
                    best = (size, style is not None, (at + 1, style, prefix, n))
            yield (*key, *best[2])
            at += best[0]

    schema = ", ".join(f"{k} {labels.schema[k].dataType.simpleString()}" for k in keys)
    return per_group(labels, keys, [page], [label], walk, f"{schema}, start_page int, style string, prefix string, start_number long")


def profile(images: DataFrame, key: str, width: str, pixels: str) -> DataFrame:
    """``(key, column, mean)`` of grey images given as row-major bytes."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, w, data in zip(pdf[key], pdf[width], pdf[pixels]):
                if data and w:
                    grid = np.frombuffer(data[: len(data) // w * w], np.uint8).reshape(-1, w)
                    rows += [(k, i, float(m)) for i, m in enumerate(grid.mean(axis=0))] if len(grid) else []
            yield pd.DataFrame(rows, columns=[key, "column", "mean"])

    return images.select(key, width, pixels).mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, column int, mean double")
