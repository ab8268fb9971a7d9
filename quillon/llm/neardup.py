"""MinHash near-dedup with tensored banding: table keys pair two small collections of half keys, links are confirmed exactly.

A document is the set of its word shingles (64-bit hashes). Two collections of `tables` half keys, each of `HALF` minhashes,
give tables * tables keys from 2 * tables * HALF minhashes instead of 2 * HALF for every key. `tables` is the least number
for which a pair right at the threshold shares a key with probability 0.999 or more.

Documents with equal sets (equal 128-bit sums of two hashes of each shingle, and size) are one class with its smallest doc_id
as representative. In each bucket the smallest representative, its hub, is compared with the others on full sets; found links
give components. Buckets that then hold a single component are done. The other members of what remains meet around their hub:
in bins of their exact Jaccard distance to it, since by the triangle inequality a link can't span more than the threshold's
distance, and in blocks of at most `BLOCK` members. Each pair of blocks is one task that counts intersections of full sets as
a matrix product and returns a spanning forest of the links between different components. So no pair of a bucket is skipped,
nothing emits all pairs, and no task holds more than two blocks.

Edge cases: no words (null, empty, white space): an empty set, linked with nothing; fewer words than a shingle has: the whole
sequence is the one shingle; repeated rows are copies; null doc_ids are never representatives, and such a row's component is
that of its copies, or null; other columns pass through `deduplicate`; very long texts are read whole; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import blocks, map_arrow, materialize, utf8
from .graph import components

HALF = 3
BLOCK = 512
SALTS = 64
_seeds = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def n_tables(threshold: float) -> int:
    m = 1
    while (1 - (1 - threshold**HALF) ** m) ** 2 < 0.999:
        m += 1
    return m


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and their bounds."""
    block = W.Block(data, offsets, lower=True)
    words, n = block.hashes(), len(block.n_words)
    keys, whole = W.windows(words, block.bounds, size)
    text = block.text_of_word()
    few = np.flatnonzero((block.n_words > 0) & (block.n_words < size))
    short = np.zeros(len(few), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size - 1):
            here = block.n_words[few] > k
            short[here] = W.mix(short[here] + words[block.bounds[few[here]] + k] + np.uint64(k + 1))
        short = W.mix(short + block.n_words[few].astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    keys, text = np.concatenate([keys[whole], short]), np.concatenate([text[whole], few])
    order = np.argsort(keys)
    order = order[np.argsort(text[order].astype(np.uint16) if n <= 0xFFFF else text[order], kind="stable")]
    keys, text = keys[order], text[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[fresh], np.searchsorted(text[fresh], np.arange(n + 1))


def signatures(docs: DataFrame, size: int, tables: int) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (the set's sums), a and b (half keys; empty for empty sets)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets, W.BLOCK):
                keys, bounds = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                counts = np.diff(bounds)
                some = counts > 0
                at = bounds[:-1][some]
                sums = []
                with np.errstate(over="ignore"):
                    for k in (1, 2):
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(keys * _seeds[-k] + np.uint64(k)), dtype=np.uint64)])
                        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                    halves = np.zeros((2 * tables, len(at)), np.uint64)
                    for k in range(2 * tables * HALF if len(at) else 0):
                        low = np.minimum.reduceat((keys * _seeds[k]) >> np.uint64(20), at)
                        halves[k // HALF] = W.mix(halves[k // HALF] + low)
                wide = np.where(some, tables, 0)
                ends = pa.array(np.concatenate([[0], np.cumsum(wide)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(halves[s : s + tables].T).reshape(-1).view(np.int64))) for s in (0, tables)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), *map(pa.array, sums), *lists],
                    names=["doc_id", "n_shingles", "f1", "f2", "a", "b"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, a array<long>, b array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """rep, shingles: the distinct shingle hashes of each row."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets, W.BLOCK):
                keys, bounds = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], names=["rep", "shingles"])

    return map_arrow(docs, run, "rep long, shingles array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, rep, shared, total: sizes of the intersection and union of the full sets of each pair."""
    theirs = sets.select(F.col("rep"), F.col("shingles").alias("mine"))
    hubs = sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("hubs"))
    shared = F.size(F.array_intersect("mine", "hubs"))
    # A hub may have a third of all rows: its set goes out to SALTS shares of them, each of which is a key of its own.
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    hubs = pairs.select("hub", "salt").distinct().join(hubs, "hub")
    both = pairs.join(theirs, "rep").join(hubs, ["hub", "salt"])
    return both.select("hub", "rep", shared.alias("shared"), (F.size("mine") + F.size("hubs") - shared).alias("total"))


def _forest(table: pa.Table, num: int, den: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between members of different components. table: rep, c, shingles."""
    reps, labels = table["rep"].to_pylist(), table["c"].to_pylist()
    lists = table["shingles"].combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    values, column, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(reps)), sizes)
    many = often[column] > 1  # what one member has alone is in no intersection
    row, column = row[many], np.cumsum(often > 1)[column[many]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(reps), len(reps)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        slab = np.zeros((len(reps), width), np.float32)
        slab[row[lo:hi], column[lo:hi] - at] = 1
        shared += slab @ slab.T
    union = sizes[:, None] + sizes[None, :] - shared
    x, y = np.nonzero(np.triu(den * shared >= num * union, 1))
    parent = {c: c for c in labels}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    us, vs = [], []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            us.append(reps[i])
            vs.append(reps[j])
    return us, vs


def _block_links(around: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: links among the members around each hub. around: hub, rep, c (component), bin (of the distance to the hub)."""
    counts = around.groupBy("hub", "bin").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    blocks_ = counts.select("hub", "bin", "parts", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    left = blocks_.select("hub", F.col("bin").alias("bin_a"), F.col("part").alias("part_a"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin_b"))
    right = blocks_.select("hub", F.col("bin").alias("bin_b"), F.col("part").alias("part_b"))
    pairs = left.join(right, ["hub", "bin_b"]).where((F.col("bin_a") < F.col("bin_b")) | (F.col("part_a") <= F.col("part_b")))
    alone = (F.col("bin_a") == F.col("bin_b")) & (F.col("part_a") == F.col("part_b"))
    pairs = pairs.withColumn("pair", F.struct("hub", "bin_a", "part_a", "bin_b", "part_b"))
    sides = pairs.select("hub", "pair", F.explode(F.when(alone, F.array(F.struct(F.col("bin_a").alias("bin"), F.col("part_a").alias("part")))).otherwise(
        F.array(F.struct(F.col("bin_a").alias("bin"), F.col("part_a").alias("part")), F.struct(F.col("bin_b").alias("bin"), F.col("part_b").alias("part")))
    )).alias("s"))
    sides = sides.select("hub", F.col("s.bin").alias("bin"), F.col("s.part").alias("part"), "pair")
    placed = around.join(counts, ["hub", "bin"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = placed.select("hub", "bin", "part", "rep", "c").join(sides, ["hub", "bin", "part"]).select("pair", "rep", "c")
    several = met.groupBy("pair").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("pair")
    grouped = met.join(several, "pair").join(sets, "rep").select(F.to_json("pair").alias("pair"), "rep", "c", "shingles")

    def link(table: pa.Table) -> pa.Table:
        u, v = _forest(table, num, den)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return grouped.groupBy("pair").applyInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for each row of docs."""
    tables = n_tables(num / den)
    sigs = materialize(signatures(docs, size, tables), "signatures")
    named = sigs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("a", "b"), "doc_id").alias("h"))
    classes = materialize(classes.select("f1", "f2", F.col("n_shingles").alias("n"), "rep", "h.a", "h.b"), "classes")
    keyed = (
        classes.select("rep", "b", F.posexplode("a").alias("i", "x"))
        .select("rep", "i", "x", F.posexplode("b").alias("j", "y"))
        .select(F.xxhash64("i", "j", "x", "y").alias("key"), "rep")
    )
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub != last")
    members = materialize(keyed.join(hubs.select("key", "hub"), "key"), "buckets")
    asked = members.where(F.col("rep") != F.col("hub")).select("hub", "rep").distinct()
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    unique = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    texts = unique.join(needed.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(full_sets(texts, size), "sets")
    compared = materialize(_compared(asked, sets), "compared")
    links = compared.where(den * F.col("shared") >= num * F.col("total")).select(F.col("hub").alias("u"), F.col("rep").alias("v"))
    found = materialize(components(links), "components")
    labels = found.withColumnRenamed("node", "rep")
    labelled = members.join(labels, "rep", "left").select("key", "hub", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = labelled.where(F.col("rep") != F.col("hub")).groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    around = labelled.join(mixed.select("key"), "key").where(F.col("rep") != F.col("hub")).select("hub", "rep", "c").distinct()
    reach = 1 - num / den
    distance = F.floor((1 - F.col("shared") / F.col("total")) / F.lit(reach + 1e-9)).cast("int")
    around = materialize(around.join(compared.select("hub", "rep", distance.alias("bin")), ["hub", "rep"]), "around")
    more = materialize(_block_links(around, sets, num, den), "links")
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)), "components")
    reached = classes.join(found, classes["rep"] == found["node"], "left").select("f1", "f2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("c"))
    out = sigs.select("doc_id", "n_shingles", "f1", "f2").join(reached, ["f1", "f2", "n_shingles"], "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which no other in their component has a smaller doc_id; of repeated rows one stays.

    Rows with a null doc_id can't be named and stay.
    """
    kept = near_duplicates(docs, size, num, den).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
