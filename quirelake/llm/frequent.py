"""Most frequent values by code-based identification.

Every value is reduced to a 64-bit fingerprint, written as two words of a Reed-Solomon
code over GF(16) (8 data and 4 check symbols each). In each of ``REPEATS`` repetitions a
hash sends the fingerprint to one of the groups, and the group counts, for each of
the 24 code positions, how often each of the 16 symbols occurs. A value that is frequent
against the rest of its group owns the heaviest symbol at nearly every position; the code
corrects the positions it lost, which yields its fingerprint without ever storing values.
Decoded fingerprints are peeled off in all repetitions and decoding is tried again, so
frequent values that share a group are separated.

The number of groups follows from the share: at most ``1 / share`` values can be frequent,
and ``groups_for`` gives every repetition ``SPREAD`` groups for each of them, a quarter of
what peeling four repetitions needs, so that even ``1 / share`` equally frequent values are
all found. The size of the sketch thus depends on the share alone; it merges by addition
and is summed on the JVM. Shares below ``LEAST_SHARE`` are refused.

Two scans are made: one for the sketch, with registers that estimate the number of distinct
rows for the threshold, and one in which the candidates are counted exactly and named.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

REPEATS = 4
SPREAD = 1.28  # groups of a repetition for each value that can be frequent
LEAST_SHARE = 1e-4  # a sketch of about 160 MB for each column and task
REGISTERS = 4096  # of the estimate of distinct rows; its standard error is 1.6 %
SYMBOLS = 16
DATA, CHECK = 8, 4
POSITIONS = 2 * (DATA + CHECK)
FLUSH = 20_000  # fingerprints counted at once
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _field() -> tuple[np.ndarray, list[int]]:
    """Products and inverses of GF(16) with the polynomial x^4 + x + 1."""
    exp, x = [], 1
    for _ in range(15):
        exp.append(x)
        x = (x << 1) ^ (0b10011 if x & 8 else 0)
    log = {v: i for i, v in enumerate(exp)}
    mul = np.zeros((16, 16), np.int64)
    for a in range(1, 16):
        for b in range(1, 16):
            mul[a, b] = exp[(log[a] + log[b]) % 15]
    inv = [0] + [exp[-log[a] % 15] for a in range(1, 16)]
    return mul, inv


_MUL, _INV = _field()


@lru_cache(maxsize=None)
def _lagrange(known: tuple[int, ...], at: int) -> list[int]:
    """Weights that give the value at point ``at`` from the values at the points ``known``."""
    out = []
    for i in known:
        w = 1
        for j in known:
            if j != i:
                w = int(_MUL[w, _MUL[at ^ j, _INV[i ^ j]]])
        out.append(w)
    return out


_PARITY = np.array([_lagrange(tuple(range(DATA)), DATA + c) for c in range(CHECK)])


def encode(fp: np.ndarray) -> np.ndarray:
    """The 24 symbols of each fingerprint, as an array (n, 24)."""
    u = fp.astype(np.uint64)
    out = np.empty((len(u), POSITIONS), np.int64)
    for half in range(2):
        at = half * (DATA + CHECK)
        for i in range(DATA):
            out[:, at + i] = ((u >> np.uint64(4 * (half * DATA + i))) & np.uint64(15)).astype(np.int64)
        for c in range(CHECK):
            acc = np.zeros(len(u), np.int64)
            for i in range(DATA):
                acc ^= _MUL[_PARITY[c, i]][out[:, at + i]]
            out[:, at + DATA + c] = acc
    return out


def groups_for(share: float) -> int:
    """Groups of each repetition for values of at least ``share``."""
    if not LEAST_SHARE <= share <= 1:
        raise ValueError(f"share must lie between {LEAST_SHARE} and 1")
    return max(128, ceil(SPREAD / share))


def group_of(fp: np.ndarray, repeat: int, groups: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = fp.astype(np.uint64) * np.uint64(_ODD[repeat])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_ODD[(repeat + 1) % REPEATS])
    return ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _decode_half(symbols: np.ndarray, margin: np.ndarray) -> list[int] | None:
    """Data symbols of the code word within two symbols of ``symbols``, if there is one."""
    n = DATA + CHECK
    doubtful = list(np.argsort(margin))
    for drop in combinations(doubtful, CHECK):
        keep = tuple(i for i in range(n) if i not in drop)
        values = [int(symbols[i]) for i in keep]
        word = list(map(int, symbols))
        wrong = 0
        for p in drop:
            acc = 0
            for w, v in zip(_lagrange(keep, p), values):
                acc ^= int(_MUL[w, v])
            wrong += acc != word[p]
            word[p] = acc
        if wrong <= CHECK // 2:
            return word[:DATA]
    return None


def _decode_cell(cell: np.ndarray) -> int | None:
    """The fingerprint whose code word lies within reach of the heaviest symbols."""
    top = np.sort(cell, axis=1)
    symbols, margin = cell.argmax(axis=1), top[:, -1] - top[:, -2]
    n = DATA + CHECK
    a = _decode_half(symbols[:n], margin[:n])
    b = _decode_half(symbols[n:], margin[n:]) if a is not None else None
    return None if b is None else sum(s << (4 * i) for i, s in enumerate(a + b))


def _clean_words(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the cells (n, 24, 16), the fingerprints of their heaviest symbols, and whether these are code words as they stand."""
    symbols = cells.argmax(axis=2)
    fps = np.zeros(len(symbols), np.uint64)
    for half in range(2):
        for i in range(DATA):
            fps |= symbols[:, half * (DATA + CHECK) + i].astype(np.uint64) << np.uint64(4 * (half * DATA + i))
    return fps, (encode(fps) == symbols).all(axis=1)


def decode(counts: np.ndarray, least: float) -> list[int]:
    """Fingerprints whose count may reach ``least``; counts is (REPEATS, groups, 24, 16).

    Cells whose heaviest symbols are a code word are read off first, all at once; the others
    are corrected one by one. What is found is taken off in every repetition, and the cells
    it was in are looked at again.
    """
    groups = counts.shape[1]
    counts = counts.astype(np.float64).copy()
    found: dict[int, float] = {}
    places = np.arange(POSITIONS)

    def take(fp: int, r: int, g: int) -> list[tuple[int, int]]:
        """Note the fingerprint and take it off; the cells that changed."""
        one = np.array([fp], np.uint64)
        if fp in found or int(group_of(one, r, groups)[0]) != g:
            return []
        word = encode(one)[0]
        homes = [(q, int(group_of(one, q, groups)[0])) for q in range(REPEATS)]
        size = min(counts[q, h][places, word].min() for q, h in homes)
        if size < least:
            return []
        found[fp] = size
        for q, h in homes:
            counts[q, h][places, word] -= size
        return homes

    def alive(cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
        # most positions of a value that reaches the threshold do
        if not cells:
            return []
        r, g = map(np.array, zip(*cells))
        high = np.sort(counts[r, g].max(axis=2), axis=1)[:, CHECK] >= least
        return [c for c, ok in zip(cells, high) if ok]

    todo = [(r, g) for r in range(REPEATS) for g in range(groups)]
    hard: set[tuple[int, int]] = set()
    while todo or hard:
        todo = alive(todo)
        changed: set[tuple[int, int]] = set()
        if todo:
            r, g = map(np.array, zip(*todo))
            fps, clean = _clean_words(counts[r, g])
            for cell, fp, ok in zip(todo, fps, clean):
                moved = take(int(fp), *cell) if ok else []
                changed.update(moved)
                if not moved:
                    hard.add(cell)
        elif hard:
            cell = hard.pop()
            fp = _decode_cell(counts[cell]) if alive([cell]) else None
            if fp is not None:
                changed.update(take(fp, *cell))
        hard -= changed
        todo = list(changed)
    return list(found)


def _signed(fp: int) -> int:
    return fp - (1 << 64) if fp >= 1 << 63 else fp


def _sketch_batches(fields: int, groups: int):
    """Partial sketches. The last column of a batch is the hash of the row's identity, null for
    a row of its own. Slots below zero hold, by field, how many values and how many of rows of
    their own there were, and the registers: how often each of 32 ranks was seen."""

    def run(batches):
        total = [None] * fields
        waiting: list[list[np.ndarray]] = [[] for _ in range(fields)]
        ranks = np.zeros((fields, REGISTERS, 2 * SYMBOLS), np.int64)
        plain = np.zeros((fields, 2), np.int64)

        def flush(f: int) -> None:
            if not waiting[f]:
                return
            if total[f] is None:
                total[f] = np.zeros(REPEATS * groups * POSITIONS * SYMBOLS, np.int64)
            fp, n = np.unique(np.concatenate(waiting[f]), return_counts=True)
            waiting[f] = []
            for at in range(0, len(fp), FLUSH):
                some, weight = fp[at : at + FLUSH], n[at : at + FLUSH]
                code = encode(some) + SYMBOLS * np.arange(POSITIONS)
                for r in range(REPEATS):
                    cell = ((r * groups + group_of(some, r, groups)) * (POSITIONS * SYMBOLS))[:, None] + code
                    slots, inverse = np.unique(cell.ravel(), return_inverse=True)
                    total[f][slots] += np.bincount(inverse, np.repeat(weight, POSITIONS), len(slots)).astype(np.int64)

        for batch in batches:
            row = batch.column(fields)
            own = row.is_null().to_numpy(zero_copy_only=False)
            h = row.fill_null(0).to_numpy().view(np.uint64)
            register = (h & np.uint64(REGISTERS - 1)).astype(np.int64)
            rest = (h >> np.uint64(12)).astype(np.float64)
            rank = np.clip(51 - np.floor(np.log2(np.maximum(rest, 1))), 0, 2 * SYMBOLS - 1).astype(np.int64)
            for f in range(fields):
                col = batch.column(f)
                there = col.is_valid().to_numpy(zero_copy_only=False)
                plain[f] += (there.sum(), (there & own).sum())
                seen = there & ~own
                ranks[f, register[seen], rank[seen]] = 1
                if there.any():
                    waiting[f].append(col.drop_null().to_numpy().view(np.uint64))
                if sum(map(len, waiting[f])) >= 4 * FLUSH:
                    flush(f)

        def rows(f: int, slots, table):
            return pa.RecordBatch.from_pydict({"f": np.full(len(slots), f, np.int32), "slot": slots.astype(np.int32), **{f"c{s}": table[:, s] for s in range(SYMBOLS)}})

        for f in range(fields):
            flush(f)
            if total[f] is not None:
                table = total[f].reshape(-1, SYMBOLS)
                slots = np.flatnonzero(table.any(axis=1))
                for at in range(0, len(slots), FLUSH):
                    yield rows(f, slots[at : at + FLUSH], table[slots[at : at + FLUSH]])
            yield rows(f, np.array([-1]), np.pad(plain[f], (0, SYMBOLS - 2))[None, :])
            halves = ranks[f].reshape(-1, SYMBOLS)
            used = np.flatnonzero(halves.any(axis=1))
            if len(used):
                yield rows(f, -2 - used, halves[used])

    return run


def _distinct(halves: np.ndarray) -> float:
    """Distinct rows by the registers' highest ranks (0: none), with linear counting for few."""
    seen = halves.reshape(REGISTERS, 2 * SYMBOLS) > 0
    top = np.where(seen.any(axis=1), 2 * SYMBOLS - seen[:, ::-1].argmax(axis=1), 0)
    empty = int((top == 0).sum())
    whole = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2 / np.sum(2.0**-top)
    return REGISTERS * np.log(REGISTERS / empty) if empty and whole < 2.5 * REGISTERS else float(whole)


def _value(name: str):
    return F.when(F.col(name) != "", F.col(name))


def _hash(name: str):
    return F.when(_value(name).isNotNull(), F.xxhash64(_value(name)))


def candidates(df: DataFrame, columns: list[str], share: float, row_id: str | None) -> list[list[int]]:
    """For each column, fingerprints (signed) that hold every value of at least ``share``."""
    groups = groups_for(share)
    identity = F.when(F.col(row_id).isNotNull(), F.xxhash64(row_id)) if row_id else F.lit(None).cast("long")
    hashes = df.select(*[_hash(c).alias(f"h{i}") for i, c in enumerate(columns)], identity.alias("i"))
    ints = ", ".join(f"c{s} long" for s in range(SYMBOLS))
    partial = hashes.mapInArrow(_sketch_batches(len(columns), groups), f"f int, slot int, {ints}")
    merged = partial.groupBy("f", "slot").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(SYMBOLS)])

    def solve(key, pdf):
        slot, table = pdf["slot"].to_numpy(), pdf[[f"c{s}" for s in range(SYMBOLS)]].to_numpy()
        counts = np.zeros((REPEATS * groups * POSITIONS, SYMBOLS), np.int64)
        counts[slot[slot >= 0]] = table[slot >= 0]
        halves = np.zeros((2 * REGISTERS, SYMBOLS), np.int64)
        halves[-2 - slot[slot < -1]] = table[slot < -1]
        values, alone = table[slot == -1][0, :2]
        # the threshold must hold for distinct rows, not for delivered ones
        views = min(values, 0.9 * _distinct(halves) + alone) if row_id else values
        fps = decode(counts.reshape(REPEATS, groups, POSITIONS, SYMBOLS), max(1.0, share * views))
        return pd.DataFrame({"f": int(key[0]), "fp": np.array([_signed(x) for x in fps], np.int64)})

    # the sketch and the candidates have a greatest size given by the share
    found = merged.groupBy("f").applyInPandas(solve, "f int, fp long").collect()
    out: list[list[int]] = [[] for _ in columns]
    for row in found:
        out[row.f].append(row.fp)
    return out


def frequent(df: DataFrame, columns: list[str], share: float = 0.01, row_id: str | None = "id") -> DataFrame:
    """``(field, item, n, total)``: values on at least ``share`` of the rows that have one.

    Null and '' are no values. Rows with an equal ``row_id`` count once (the value of a
    copy is that of its original); a null ``row_id`` is a row of its own. ``n`` and
    ``total`` are exact. Ties at the threshold are all in. An empty table or a column
    without values gives no rows. Other columns are ignored. ``share`` below ``LEAST_SHARE``
    is an error. Both scans run when this is called: the result is a small local table.
    """
    spark = df.sparkSession
    fps = candidates(df, columns, share, row_id)
    fields = range(len(columns))
    wanted = spark.createDataFrame([(i, k, fp) for i, some in enumerate(fps) for k, fp in enumerate(some)], "f int, k int, fp long")
    coded = df.select(
        F.struct(F.col(row_id), F.when(F.col(row_id).isNull(), F.monotonically_increasing_id())).alias("i") if row_id else F.lit(None).alias("i"),
        *[_value(c).alias(f"v{i}") for i, c in enumerate(columns)],
        *[_hash(c).alias(f"fp{i}") for i, c in enumerate(columns)],
    )
    # values become small numbers before the shuffle that removes copies; candidates have a
    # greatest number given by the share
    for i in fields:
        own = wanted.where(F.col("f") == i).select(F.col("fp").alias(f"fp{i}"), F.col("k").alias(f"k{i}"))
        coded = coded.join(F.broadcast(own), f"fp{i}", "left")
    # the candidates' names are noted in passing; two values of one fingerprint would show
    named = Observation()
    coded = coded.observe(named, *[F.collect_set(F.when(F.col(f"k{i}").isNotNull(), F.struct(F.col(f"k{i}").alias("k"), F.col(f"v{i}").alias("v")))).alias(f"s{i}") for i in fields])
    coded = coded.select("i", *[F.when(F.col(f"v{i}").isNotNull(), F.coalesce(f"k{i}", F.lit(-1))).alias(f"k{i}") for i in fields])
    if row_id:
        coded = coded.groupBy("i").agg(*[F.min(f"k{i}").alias(f"k{i}") for i in fields])
    melted = coded.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"k{i}").alias("k")) for i in fields])).alias("x")).select("x.f", "x.k")
    # one row for each candidate and field
    counted = {(r["f"], r["k"]): r["n"] for r in melted.where(F.col("k").isNotNull()).groupBy("f", "k").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = {f: sum(n for (g, _), n in counted.items() if g == f) for f in fields}
    out = []
    for i in fields:
        names: dict[int, list[str]] = {}
        for s in (named.get[f"s{i}"] or []) if counted else []:
            names.setdefault(s["k"], []).append(s["v"])
        for k, values in names.items():
            if len(values) > 1:
                raise ArithmeticError(f"two values share a fingerprint: {values}")
            n = counted.get((i, k), 0)
            if n >= share * totals[i]:
                out.append((columns[i], values[0], n, totals[i]))
    return spark.createDataFrame(out, "field string, item string, n long, total long")
