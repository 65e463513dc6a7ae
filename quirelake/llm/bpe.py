"""Byte-level BPE encoding of a corpus with a public rank file.

Text is cut into words by the vocabulary's pattern. A word's bytes are held as a
contiguous array of part boundaries with the rank of the pair that starts at each of
them; the smallest rank is looked up by a scan, its right boundary deleted and the two
ranks beside it refreshed, until no pair has a rank. Long words (a blank page, a run of
one character) would make the scan quadratic, so above ``SCAN`` bytes the same merges are
taken from a heap over linked parts. Words repeat, so each worker remembers the ids of
words it has seen, up to a fixed number.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirelake.runtime import widen

SCAN = 96
REMEMBER = 200_000
_NONE = 1 << 60


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    out = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by scanning the rank array."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    starts = list(range(n + 1))
    pair = [ranks.get(word[i : i + 2], _NONE) for i in range(n - 1)]
    while pair:
        least = min(pair)
        if least == _NONE:
            break
        i = pair.index(least)
        del starts[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[starts[i] : starts[i + 2]], _NONE)
        if i:
            pair[i - 1] = ranks.get(word[starts[i - 1] : starts[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a word of any length, in n log n."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts with one rank table; remembers the words of this worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        seen, out = self.seen, []
        for word in self.words(text):
            ids = seen.get(word)
            if ids is None:
                raw = word.encode("utf-8", "replace")
                rank = self.ranks.get(raw)
                if rank is not None:
                    ids = [rank]
                else:
                    ids = (merge_scan if len(raw) <= SCAN else merge_heap)(raw, self.ranks)
                if len(seen) < REMEMBER and len(raw) <= SCAN:
                    seen[word] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def encode_corpus(df: DataFrame, key: str, text: str, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``(key, ids array<int>)`` of every row; a null or empty text gives an empty list.

    The rank file is read once on the driver and broadcast (its size is that of a
    vocabulary, under a megabyte). Special tokens have no meaning: their strings are
    ordinary text. Rows with equal keys and repeated texts are encoded like any other.
    """
    spark = df.sparkSession
    with open(rank_file, "rb") as f:
        data = f.read()
    shared = spark.sparkContext.broadcast(data)
    tag = hash((data, pattern))

    def run(batches):
        encoder = _ENCODERS.get(tag)
        if encoder is None:
            encoder = _ENCODERS[tag] = Encoder(load_ranks(shared.value), pattern)
        for batch in batches:
            flat: list[int] = []
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            for i, value in enumerate(batch.column(1).to_pylist()):
                flat += encoder(value)
                offsets[i + 1] = len(flat)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, ids])

    source = widen(df.select(key, text))
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")
