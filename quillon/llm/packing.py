"""Best-fit packing by exact-complement hashing over a histogram of lengths.

A first pass encodes each text, cuts what is longer than a sequence, and writes one row per piece with its rank among the
pieces of its length in its task. Lengths are bounded by the capacity, so their histogram is, too (`capacity` counts): the
plan is made from it alone. Sums of single, pair and triple lengths are indexed; from the longest length on, a sequence is
completed by the combination that fills its gap exactly, under the counts still available, and that pattern is taken as
often as the counts allow. Where no combination fits exactly, the longest length that fits goes in first; what remains at
the end is best-fit. Every pattern uses some length up, so there are at most `capacity` patterns and four or more items
each only where lengths are short; the plan's size does not depend on the number of documents.

Pieces then find their place by rank: the rank in the task plus the pieces of that length in earlier tasks.

Edge cases: a null text is empty and has the end id alone; repeated rows are packed each for itself; null ids pass through;
texts longer than a sequence are cut into full pieces, of which the first may be shorter; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tokens as T
from . import _words as W
from ._shared import blocks, map_arrow, materialize, utf8

CAPACITY = 2048
_RANKS = 1 << 44


class SumIndex:
    """Which lengths are available, and how many pairs of them have each sum."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.size = counts, len(counts)
        self.there = counts > 0
        self.lengths = np.flatnonzero(self.there)
        self.pairs = np.zeros(2 * self.size, np.int64)
        for x in self.lengths.tolist():
            partners = self.lengths[self.lengths >= x]
            self.pairs[x + partners] += 1

    def spend(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if self.counts[length] == 0:
            np.subtract.at(self.pairs, length + self.lengths, 1)
            self.there[length] = False
            self.lengths = np.flatnonzero(self.there)

    def _left(self, length: int, used: dict[int, int]) -> int:
        return int(self.counts[length]) - used.get(length, 0) if 0 < length < self.size else 0

    def _pair(self, gap: int, used: dict[int, int]) -> list[int] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        a = self.lengths[(self.lengths < gap) & (2 * self.lengths >= gap)]
        for x in a[self.there[gap - a]].tolist()[::-1]:
            y = gap - x
            if self._left(x, used) > (x == y) and self._left(y, used) > (x == y):
                return [x, y]
        return None

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three available lengths that sum to gap."""
        if gap < self.size and self._left(gap, used) > 0:
            return [gap]
        if found := self._pair(gap, used):
            return found
        a = self.lengths[self.lengths <= gap - 2]
        for x in a[self.pairs[gap - a] > 0].tolist()[::-1]:
            if self._left(x, used) > 0 and (found := self._pair(gap - x, used | {x: used.get(x, 0) + 1})):
                return [x, *found]
        return None

    def longest(self, gap: int, used: dict[int, int]) -> int | None:
        for x in self.lengths[: np.searchsorted(self.lengths, gap, "right")][::-1].tolist():
            if self._left(x, used) > 0:
                return x
        return None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], int]:
    """Patterns (lengths in order, how many sequences) that use every count up, and the number of sequences."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    index, out, total = SumIndex(have), [], 0
    while len(index.lengths):
        first = int(index.lengths[-1])
        pattern, used, gap = [first], {first: 1}, capacity - first
        while gap:
            if (found := index.exact(gap, used)) is None:
                one = index.longest(gap, used)
                if one is None:
                    break
                found = [one]
            for x in found:
                used[x] = used.get(x, 0) + 1
                gap -= x
            pattern += found
        times = min(int(index.counts[x]) // n for x, n in used.items())
        for x, n in used.items():
            index.spend(x, n * times)
        out.append((pattern, times))
        total += times
    return out, total


def _places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each item of each pattern: its key length * 2^44 + first rank, first sequence, and offset; by key."""
    taken: dict[int, int] = {}
    keys, sequences, offsets, sequence = [], [], [], 0
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            rank = taken.get(length, 0)
            keys.append(length * _RANKS + rank)
            sequences.append(sequence)
            offsets.append(at)
            taken[length] = rank + times
            at += length
        sequence += times
    keys, order = np.array(keys, np.int64), np.argsort(keys)
    return {"keys": keys[order], "sequences": np.array(sequences, np.int64)[order], "offsets": np.array(offsets, np.int64)[order]}


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and rank: the piece's task and its place there among its length."""

    def run(batches):
        from pyspark import TaskContext

        coder = T.encoder(path, "byte")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, z in blocks(offsets, W.BLOCK // 2):
                flat, n = coder.encode(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                n = n + 1
                bounds = np.concatenate([[0], np.cumsum(n)])
                ids = np.full(int(bounds[-1]), end_id, "<u4")
                inside = np.ones(len(ids), bool)
                inside[bounds[1:] - 1] = False
                ids[inside] = flat
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                lead = np.repeat(n - (many - 1) * capacity, many)
                start = np.where(piece == 0, 0, lead + (piece - 1) * capacity)
                length = np.where(piece == 0, lead, capacity)
                at = bounds[doc] + start
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                first = np.searchsorted(by, by)
                rank = np.empty(len(length), np.int64)
                rank[order] = seen[by] + np.arange(len(by)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with sequence_id and offset. The driver sees `capacity` counts at most."""
    pieces = materialize(cut_pieces(docs, path, end_id, capacity), "pieces")
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = materialize(counted.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-bases")
    counts = based.groupBy("length").agg(F.sum("n").alias("n")).toPandas()
    patterns, _ = plan_packing(dict(zip(counts["length"].tolist(), counts["n"].tolist(), strict=True)), capacity)
    places = _places(patterns)
    ranked = pieces.join(based.select("length", "part", "base"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            key = length * _RANKS + rank
            at = np.searchsorted(places["keys"], key, "right") - 1
            sequence = places["sequences"][at] + key - places["keys"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(places["offsets"][at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
