"""Evaluation items that leaked into a corpus.

Texts are read as streams of letters and digits only, in one form (case, width, look-alike
letters, accents' encoding), so spacing, line breaks and punctuation cannot hide a quote.
A window is fingerprinted by the SimHash of its character shingles, and windows of three
sizes are compared:

* ``item``: windows as long as the item (items are sorted into size classes, and documents
  are cut by every class that occurs), for items quoted whole, with changed words or not;
* ``half``: windows half as long, at every eighth of their length, for half an item in one
  stretch;
* ``small``: windows of ``WINDOW`` characters, an addition for items in several stretches,
  which no window of the item's size resembles.

A multi-index finds every fingerprint within the radius: it is cut into blocks, and the
items' keys are held with all keys that differ in up to ``slack`` bits, so two fingerprints
at a distance of up to ``blocks * (slack + 1) - 1`` agree in at least one. A candidate pair
is then verified exactly: the shingles of ``SHINGLE`` characters the item and the document
share are joined into runs, and the heaviest chain of runs in the item's order, each shingle
weighted by the characters it newly covers, must hold the required share of the item.

The item table is small and given; its fingerprints go to the workers in blocks of
``BLOCK_ITEMS`` items, one pass over the corpus for each block, so the broadcast has a
fixed greatest size. Documents are never shuffled and nothing is kept about them.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import defaultdict
from math import ceil, log

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from quirelake.llm.lookalike import TO_LATIN
from quirelake.runtime import widen

WINDOW, STRIDE, GRAM = 24, 4, 4
SHINGLE = 12
STEP = 1.25  # ratio of neighbouring size classes of items
PARTS = 16  # windows of an item's size begin at every sixteenth of it, those of half its size too
LEVELS = ("item", "half", "small")
EXPAND = 1 << 20  # candidates looked at together
BLOCK_ITEMS = 5_000
BLOCK_CHARS = 4_000_000
_TABLE = {ord(a): b for a, b in TO_LATIN.items()}
_SKIP = regex.compile(r"[^\p{L}\p{N}]+")


def stream(text: str | None) -> str:
    """Letters and digits of a text in one form."""
    if not text:
        return ""
    flat = unicodedata.normalize("NFKC", text).translate(_TABLE).casefold()
    return _SKIP.sub("", unicodedata.normalize("NFC", flat))


def _gram_bits(s: str) -> np.ndarray:
    """For each shingle of GRAM characters its 64 hashed bits as -1 / 1."""
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def _sums(s: str, longest: int) -> np.ndarray:
    """Running sums of the shingles' bits. They may wrap around: differences over up to ``longest``
    characters are right all the same."""
    kind = np.int16 if longest < 1 << 15 else np.int32
    if len(s) < GRAM:
        return np.zeros((1, 64), kind)
    bits = _gram_bits(s)
    total = np.zeros((len(bits) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
    return total


def fingerprints(total: np.ndarray, window: int, every: int) -> np.ndarray:
    """SimHash of each window of a text, given by its running sums, that starts at a multiple of ``every``."""
    grams = window - GRAM + 1
    starts = np.arange(0, len(total) - grams, every)
    return _pack(total[starts + grams] - total[starts]) if len(starts) else np.empty(0, np.uint64)


class MultiIndex:
    """Fingerprints with owners, found by blocks."""

    def __init__(self, prints: np.ndarray, owner: np.ndarray, blocks: int, slack: int):
        self.prints, self.owner = prints, owner
        self.radius = blocks * (slack + 1) - 1
        edges = np.linspace(0, 64, blocks + 1).round().astype(int)
        self.blocks = []
        for lo, hi in zip(edges, edges[1:]):
            width = int(hi - lo)
            key = self._key(prints, lo, width)
            keys, at = [key], [np.arange(len(prints))]
            for bit in range(width if slack else 0):
                keys.append(key ^ (1 << bit))
                at.append(np.arange(len(prints)))
            keys, at = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(keys, kind="stable")
            self.blocks.append((lo, width, at[order], np.searchsorted(keys[order], np.arange((1 << width) + 1))))

    @staticmethod
    def _key(prints: np.ndarray, lo: int, width: int) -> np.ndarray:
        return ((prints >> np.uint64(lo)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position in prints, owner)`` of all pairs within the radius, in parts of EXPAND candidates."""
        where, who = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for lo, width, at, starts in self.blocks:
            key = self._key(prints, lo, width)
            n = starts[key + 1] - starts[key]
            upto = np.cumsum(n)
            for a in range(0, int(n.sum()), EXPAND):
                i = np.arange(a, min(a + EXPAND, int(upto[-1])))
                src = np.searchsorted(upto, i, "right")
                cand = at[starts[key[src]] + i - (upto[src] - n[src])]
                hit = np.bitwise_count(prints[src] ^ self.prints[cand]) <= self.radius
                where.append(src[hit])
                who.append(self.owner[cand[hit]])
        return np.concatenate(where), np.concatenate(who)


def size_class(n: int) -> int:
    """The window length for items of ``n`` characters; neighbours differ by STEP."""
    return round(WINDOW * STEP ** round(log(n / WINDOW, STEP)))


class Index:
    """Items' fingerprints by window size, and the items too short for windows."""

    def __init__(self, items: list[tuple[int, str]], levels=LEVELS):
        streams = [(k, stream(t)) for k, t in items]
        self.items = [(k, s) for k, s in streams if len(s) >= WINDOW]
        self.short = Short([(k, s) for k, s in streams if 0 < len(s) < WINDOW])
        found: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for at, (_, s) in enumerate(self.items):
            total = _sums(s, max(len(s), WINDOW))
            size = size_class(len(s))
            if "item" in levels:
                found[size, max(1, size // PARTS), 1].append((at, _pack(total[-1:] - total[:1])))
            if "half" in levels and size // 2 >= WINDOW:
                every = max(1, size // PARTS)
                found[size // 2, every, 1].append((at, np.unique(fingerprints(total, size // 2, every))))
            if "small" in levels:
                found[WINDOW, STRIDE, 0].append((at, np.unique(fingerprints(total, WINDOW, 1))))
        self.indexes = []
        for (window, every, slack), own in found.items():
            owner = np.concatenate([np.full(len(p), at, np.int32) for at, p in own])
            self.indexes.append((window, every, MultiIndex(np.concatenate([p for _, p in own]), owner, 6 if slack else 4, slack)))
        self.longest = max((w for w, _, _ in self.indexes), default=WINDOW)


class Short:
    """Items of fewer than WINDOW characters: one leaks where a stretch of at least the share of it stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items

    def held(self, s: str, share: float):
        for k, item in self.items:
            for size in range(len(item), max(1, ceil(share * len(item))) - 1, -1):
                if any(item[i : i + size] in s for i in range(len(item) - size + 1)):
                    yield k, size / len(item)
                    break


def held_share(item: str, places: dict[str, list[int]]) -> float:
    """Share of the item's characters on the heaviest in-order chain of shared shingles.

    ``places``: the document's shingles with their positions.
    """
    if not item:
        return 0.0
    runs: list[list[int]] = []
    last: dict[int, list[int]] = {}
    for i in range(len(item) - SHINGLE + 1):
        for j in places.get(item[i : i + SHINGLE], ()):
            run = last.get(j - i)
            if run is not None and run[1] == i - 1:
                run[1] = i
            else:
                last[j - i] = run = [i, i, j - i]
                runs.append(run)
    if not runs:
        return 0.0
    table = np.array(sorted((a, b + SHINGLE, a + d, b + SHINGLE + d) for a, b, d in runs))
    a0, a1, b0, b1 = table.T
    best = (a1 - a0).astype(float)
    for y in range(1, len(table)):
        ok = (b0[:y] < b0[y]) & (b1[:y] <= b1[y]) & (a1[:y] <= a1[y])
        if ok.any():
            overlap = np.maximum(0, np.maximum(a1[:y] - a0[y], b1[:y] - b0[y]))
            gain = np.where(ok, best[:y] - overlap, -1.0)
            best[y] += max(0.0, gain.max())
    return min(1.0, float(best.max()) / len(item))


def may_hold(item: str, places: dict, share: float) -> bool:
    """Whether the shared shingles, in any order, cover enough of the item."""
    covered, upto = 0, 0
    for i in range(len(item) - SHINGLE + 1):
        if item[i : i + SHINGLE] in places:
            covered += i + SHINGLE - max(i, upto)
            upto = i + SHINGLE
    return covered >= share * len(item)


_SEGMENT = 1 << 16  # characters of a long text whose windows are made together
_INDEXES: dict[str, Index] = {}


def _scan(shared, tag: str, share: float, levels):
    def run(batches):
        index = _INDEXES.get(tag)
        if index is None:
            _INDEXES.clear()
            index = _INDEXES[tag] = Index(shared.value, levels)
        for pdf in batches:
            out = []
            ids, streams = pdf["doc_id"].tolist(), [stream(t) for t in pdf["text"]]
            pairs: set[tuple[int, int]] = set()
            waiting = [([], []) for _ in index.indexes]

            def flush():
                for (_, _, own), (prints, origin) in zip(index.indexes, waiting):
                    if prints:
                        at = np.concatenate(origin)
                        where, who = own.near(np.concatenate(prints))
                        pairs.update(zip(at[where].tolist(), who.tolist()))
                        prints.clear()
                        origin.clear()

            size = 0
            for at, s in enumerate(streams):
                out += [(ids[at], k, held) for k, held in index.short.held(s, share)]
                for a in range(0, len(s), _SEGMENT) if index.indexes else ():
                    total = _sums(s[a : a + _SEGMENT + index.longest - 1], index.longest)
                    for (window, every, _), (prints, origin) in zip(index.indexes, waiting):
                        # windows that begin in this segment; the next one begins at a multiple too
                        own = fingerprints(total, window, every)[: -(-_SEGMENT // every)]
                        prints.append(own)
                        origin.append(np.full(len(own), at))
                        size += len(own)
                    if size > 50_000:
                        flush()
                        size = 0
            flush()
            by_doc = defaultdict(list)
            for at, who in pairs:
                by_doc[at].append(who)
            for at, some in by_doc.items():
                s = streams[at]
                needed = {index.items[w][1][i : i + SHINGLE] for w in some for i in range(len(index.items[w][1]) - SHINGLE + 1)}
                places: dict[str, list[int]] = {}
                for j in range(len(s) - SHINGLE + 1):
                    g = s[j : j + SHINGLE]
                    if g in needed:
                        places.setdefault(g, []).append(j)
                for w in some:
                    if not may_hold(index.items[w][1], places, share):
                        continue
                    held = held_share(index.items[w][1], places)
                    if held >= share:
                        out.append((ids[at], index.items[w][0], held))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "held"])

    return run


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, levels=LEVELS) -> DataFrame:
    """``(doc_id, item_id, held)``: documents that hold at least ``share`` of an item's text.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, text``. Null and empty
    texts hold nothing and leak nothing. An item shorter than a window is searched for as it
    is, and leaks where one stretch of at least ``share`` of it stands. A document row given
    twice is reported once; items with equal texts are each reported. ``levels`` are the
    window sizes used. A document shorter than an item's window is compared by the smaller
    ones.
    """
    spark = documents.sparkSession
    rows = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").dropDuplicates().toLocalIterator() if r["text"]]
    blocks: list[list] = [[]]
    size = 0
    for row in rows:
        if len(blocks[-1]) >= BLOCK_ITEMS or size + len(row[1]) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
        size += len(row[1])
    source = widen(documents.select("doc_id", "text"))
    found = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        part = source.mapInPandas(_scan(shared, uuid.uuid4().hex, share, tuple(levels)), "doc_id long, item_id long, held double")
        found = part if found is None else found.unionAll(part)
    return found.dropDuplicates(["doc_id", "item_id"])
