"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Learning: the mean, principal axes and rotations (each refined so that its signs lose least, alternating signs and an
orthogonal fit) come from a bounded sample: `sample_rows` vectors of the smallest hashes of vec_id. A code has a bit for each
rotated axis and is cut into substrings of about log2(rows) - 3 bits, so that a value of a substring holds about eight rows whatever
the number of rows. Of `tuned` sample vectors the true neighbours are found in one pass over all rows; from their codes come
the number of substrings, the reach and the number of loose bits: the cheapest for which a share `recall` of true neighbours
is met by some probe.

Index: a row for each distinct vector and substring, keyed by position and value, for every vector.

Search: a query's probes are, in each substring, all values within the reach of its own, and all that differ from it in loose
bits alone, which are those its vector lies closest to the border of. They meet the index in an equi-join. By pigeonhole every
code that differs in fewer than substrings * (reach + 1) bits is met; the loose bits, whose signs neighbours most often
disagree in, meet most of those beyond. What is met stays if its first CHECK bits are within a radius that keeps nearly all
true neighbours, and is reranked by the exact Euclidean distance. Queries that have fewer answers than they could search again
with a larger reach and no radius, in the end over everything.

Vectors that are equal are one entry with their smallest ids (one more than are asked for; no answer can need others), so a
vector that many rows share is no hot key. A key is hot only where many different vectors agree in a whole substring.

Edge cases: vectors that are null, of no length, zero, or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different lengths have no distance, each length is searched by itself; a query's own id is no answer;
repeated rows count once; an id with several vectors is as near as its nearest, and asks with one of them; ties go to the
smaller vec_id; with fewer candidates than k all are returned; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import map_arrow, materialize

MOST_PARTS = 64
MOST_LOOSE = 9
CHECK = 256
PROBES = 1 << 12  # masks at once
_odd = np.random.Generator(np.random.PCG64(41)).integers(1, 1 << 62, (2, 1 << 12), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    axes: np.ndarray  # a column for each bit
    width: int  # bits of a substring
    parts: int
    reach: int
    loose: int
    radius: int

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.axes

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        return self.margins(vectors) > 0

    def values(self, bits: np.ndarray, parts: int | None = None) -> np.ndarray:
        """The substrings of each row as numbers."""
        m = parts or self.parts
        return bits[:, : m * self.width].reshape(len(bits), m, self.width) @ (1 << np.arange(self.width, dtype=np.int64))

    def keys(self, bits: np.ndarray) -> np.ndarray:
        return self.values(bits) + (np.arange(self.parts, dtype=np.int64) << self.width)

    def check(self, bits: np.ndarray) -> list[np.ndarray]:
        """The first CHECK bits as numbers of 64 bits."""
        held = np.zeros((len(bits), CHECK), bool)
        n = min(CHECK, bits.shape[1])
        held[:, :n] = bits[:, :n]
        words = np.packbits(held, axis=1).view(np.int64)
        return [words[:, k].copy() for k in range(CHECK // 64)]


def masks(width: int, reach: int, loose: int = 0) -> np.ndarray:
    """All numbers of `width` bits with `reach` ones or fewer, or with ones in the `loose` lowest bits alone."""
    if reach >= width:
        return np.arange(1 << width, dtype=np.int64)
    all_ = np.arange(1 << width, dtype=np.int32)
    near = np.bitwise_count(all_) <= reach
    near[: 1 << min(loose, width)] = True
    return np.flatnonzero(near)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), d)


def entries(rows: DataFrame, d: int, k: int) -> DataFrame:
    """h1, h2 (128 bits that name a vector), rep (its smallest id), ids (the k + 1 smallest), v: of each distinct vector.

    A batch first keeps the k + 1 smallest ids of each vector, so a vector that many rows share is small before its shuffle.
    """

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), d) + 0.0
            with np.errstate(over="ignore"):
                raw = np.ascontiguousarray(x).view(np.uint64)
                h1, h2 = (W.mix((W.mix(raw * _odd[i, np.arange(d) % _odd.shape[1]]) * (np.arange(d, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(1, dtype=np.uint64)) for i in (0, 1))
            order = np.lexsort((ids, h2, h1))
            h1, h2 = h1[order], h2[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = np.flatnonzero(fresh)
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            keep = rank <= k
            yield pa.RecordBatch.from_arrays([pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), *(batch.column(c).take(pa.array(order[keep])) for c in (0, 1))], names=["h1", "h2", "vec_id", "v"])

    named = map_arrow(rows.select("vec_id", "v"), run, "h1 long, h2 long, vec_id long, v array<double>")
    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    return materialize(named.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), ids.alias("ids"), F.first("v").alias("v")), "ann-entries")


def _rotations(x: np.ndarray, mean: np.ndarray, bits: int) -> np.ndarray:
    """A column for each bit: rotated principal axes, each rotation refined on the sample."""
    d = x.shape[1]
    random = np.random.Generator(np.random.PCG64(11))
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1] if len(x) else np.eye(d)
    projected, turned = centred @ axes, []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(random.normal(size=(d, d)))[0]
        for _ in range(8 if len(x) >= 2 * d else 0):  # too few rows tell nothing about signs
            u, _, vt = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (u @ vt).T
        turned.append(axes @ turn)
    return np.concatenate(turned, 1)


def true_neighbours(rows: DataFrame, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked vector the k nearest distinct ones but itself, over all entries in one pass: their number and vectors."""
    d = asked.shape[1]
    square = (asked * asked).sum(1)

    def run(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, d)))] * len(asked)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            far = square[:, None] - 2 * asked @ x.T + (x * x).sum(1)
            far[far < 1e-12 * (1 + square[:, None])] = np.inf
            for q in range(len(asked)):
                near = np.argpartition(far[q], k)[:k] if far.shape[1] > k else np.arange(far.shape[1])
                near = near[np.isfinite(far[q][near])]
                both = np.concatenate([best[q][0], far[q][near]]), np.concatenate([best[q][1], x[near]])
                order = np.argsort(both[0])[:k]
                best[q] = both[0][order], both[1][order]
        out = [np.concatenate([np.full(len(b[0]), q) for q, b in enumerate(best)]), np.concatenate([b[0] for b in best])]
        vectors = np.concatenate([b[1] for b in best]).reshape(-1)
        n = len(out[0])
        yield pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int32)), pa.array(out[1]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(vectors))], names=["q", "far", "v"])

    found = map_arrow(rows.select("v"), run, "q int, far double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("far"))
    got = found.withColumn("r", rank).where(F.col("r") <= k).orderBy("q", "r").select("q", "v").toArrow()
    return got["q"].to_numpy(), _matrix(got["v"], d) if got.num_rows else np.zeros((0, d))


def learn_codes(rows: DataFrame, d: int, n: int, k: int, sample_rows: int = 4000, tuned: int = 100, recall: float = 0.96) -> Codes:
    """rows: entries; n: how many. The driver gets the sample and the neighbours of `tuned` of it."""
    got = rows.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toArrow()
    x = _matrix(got["v"], d) if got.num_rows else np.zeros((0, d))
    mean = x.mean(0) if len(x) else np.zeros(d)
    width = min(24, max(4, round(float(np.log2(max(n, 2)))) - 3))
    codes = Codes(mean, _rotations(x, mean, MOST_PARTS * width), width, MOST_PARTS, 0, 0, CHECK)
    asked = x[:tuned]
    of, near = true_neighbours(rows, asked, k) if len(asked) else (np.zeros(0, np.int64), near_none(d))
    if not len(of):
        return Codes(mean, codes.axes, width, 1, width, 0, CHECK)
    margins = codes.margins(asked)[of]
    differ = (margins > 0) != codes.bits(near)
    apart = differ[:, : MOST_PARTS * width].reshape(len(of), MOST_PARTS, width)
    order = np.abs(margins[:, : MOST_PARTS * width]).reshape(apart.shape).argsort(2)
    apart = np.take_along_axis(apart, order, 2)  # the bits a query is least sure of first
    ones, last = apart.sum(2), np.where(apart.any(2), width - apart[:, :, ::-1].argmax(2), 0)
    best = None
    for reach in range(1, width + 1):
        for loose in range(min(MOST_LOOSE, width) + 1):
            hit = np.logical_or.accumulate((ones <= reach) | (last <= loose), axis=1).mean(0)
            if hit[-1] < recall:
                continue
            parts = int(np.argmax(hit >= recall)) + 1
            cost = parts * (len(masks(width, reach, loose)) * (1 + n / 2.0**width) + 100)
            if best is None or cost < best[0]:
                best = cost, parts, reach, loose
        if best:
            break
    wide = min(CHECK, differ.shape[1])
    radius = int(np.quantile(differ[:, :wide].sum(1), 0.5 + recall / 2, method="higher"))
    return Codes(mean, codes.axes, width, *best[1:], radius)


def near_none(d: int) -> np.ndarray:
    return np.zeros((0, d))


def build_index(rows: DataFrame, codes: Codes, d: int) -> DataFrame:
    """key, rep, b0, b1 ... (the checked bits): a row for each entry and substring. It is made as it is searched and only lies
    on disk as the join shuffles it."""

    def run(batches):
        for batch in batches:
            bits = codes.bits(_matrix(batch.column(1), d))
            keys = codes.keys(bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *map(pa.array, codes.check(bits))], names=["rep", "keys", *checked])

    checked = [f"b{k}" for k in range(CHECK // 64)]
    coded = map_arrow(rows.select("rep", "v"), run, "rep long, keys array<long>, " + ", ".join(f"{c} long" for c in checked))
    return coded.select(F.explode("keys").alias("key"), "rep", *checked)


def _probes(asked: DataFrame, codes: Codes, d: int, reach: int, loose: int) -> DataFrame:
    parts = 1 if reach >= codes.width else codes.parts

    def run(batches):
        near = masks(codes.width, reach, loose)
        for batch in batches:
            margins = codes.margins(_matrix(batch.column(1), d))
            bits = margins > 0
            check, keys = codes.check(bits), codes.keys(bits)[:, :parts]
            order = np.abs(margins[:, : parts * codes.width]).reshape(len(margins), parts, codes.width).argsort(2)
            for at in range(len(keys)):
                turned = 1 << order[at]
                for a in range(0, len(near), PROBES):
                    picked = (near[a : a + PROBES, None] >> np.arange(codes.width)) & 1
                    out = (keys[at][:, None] ^ (turned @ picked.T)).reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, 1), pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out)), *(pa.array(c[at : at + 1]) for c in check)], names=["q", "keys", *checked]
                    )

    checked = [f"q{k}" for k in range(CHECK // 64)]
    coded = map_arrow(asked.select("rep", "v"), run, "q long, keys array<long>, " + ", ".join(f"{c} long" for c in checked))
    return coded.select(F.explode("keys").alias("key"), "q", *checked)


def _search(asked: DataFrame, rows: DataFrame, index: DataFrame, codes: Codes, d: int, reach: int, loose: int, radius: int) -> DataFrame:
    """q, rep, score: every entry that the probes of asked (rep, v) meet within the radius.

    Spark takes the probes to be as small as the queries they come from and would gather them in the driver to broadcast them;
    they are hundreds of rows for each substring, so both sides are shuffled.
    """
    met = _probes(asked, codes, d, reach, loose).hint("shuffle_merge").join(index, "key")
    if radius < CHECK:
        apart = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(CHECK // 64)), F.lit(0))
        met = met.where(apart <= radius)
    pairs = met.select("q", "rep").distinct()
    both = pairs.join(rows.select("rep", "v"), "rep").join(asked.select(F.col("rep").alias("q"), F.col("v").alias("w")), "q")

    def run(batches):
        for batch in batches:
            far = np.sqrt(((_matrix(batch.column(2), d) - _matrix(batch.column(3), d)) ** 2).sum(1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], names=["q", "rep", "score"])

    return map_arrow(both.select("q", "rep", "v", "w"), run, "q long, rep long, score double")


def _of_length(rows: DataFrame, queries, d: int, k: int) -> DataFrame:
    kinds = entries(rows, d, k)
    n = kinds.count()
    asking = rows.where(queries).select("vec_id").distinct()
    of = kinds.select("rep", F.explode("ids").alias("query_id"))
    # An id past the k + 1 smallest of its vector is in no entry: such queries find their entry by the vector itself.
    asking = asking.join(of, asking["vec_id"] == of["query_id"], "left").select("vec_id", "rep")
    lost = asking.where("rep is null").select("vec_id").join(rows, "vec_id").join(kinds.select("rep", F.col("v").alias("w")), F.col("v") == F.col("w")).select("vec_id", "rep")
    asking = asking.where("rep is not null").unionByName(lost).groupBy("vec_id").agg(F.min("rep").alias("rep"))
    asking = materialize(asking.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")), "ann-asking")
    asked = materialize(kinds.select("rep", "v").join(asking.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi"), "ann-asked")
    codes = learn_codes(kinds, d, n, k)
    index = build_index(kinds, codes, d)
    total = rows.select("vec_id").distinct().count()
    reach, loose, radius, found = codes.reach, codes.loose, codes.radius, None
    sizes = kinds.select("rep", F.size("ids").alias("n"))
    todo = asked
    while True:
        got = materialize(_search(todo, kinds, index, codes, d, reach, loose, radius), "ann-found")
        if reach >= codes.width and radius >= CHECK:
            enough = got
        else:
            have = got.join(sizes, "rep").groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") > min(k, total - 1)).select("q")
            enough = got.join(have, "q", "left_semi")
        found = enough if found is None else found.unionByName(enough)
        if reach >= codes.width and radius >= CHECK:
            break
        todo = todo.join(enough.select(F.col("q").alias("rep")).distinct(), "rep", "left_anti")
        if todo.isEmpty():
            break
        reach, radius = min(reach + 2, codes.width), CHECK
        todo = materialize(todo, "ann-asked")
    near = F.row_number().over(Window.partitionBy("q").orderBy("score", "rep"))
    top = found.withColumn("r", near).where(F.col("r") <= k + 1).select("q", "rep", "score")
    members = top.join(kinds.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = asking.join(members, "q").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row for which the condition `queries` holds."""
    rows = usable(vectors)
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = None
    for d in lengths:
        one = _of_length(rows.where(F.size("v") == d), queries, d, k)
        out = one if out is None else out.unionByName(one)
    return out
