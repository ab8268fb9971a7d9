"""Toxicity: subword-bag embeddings averaged into a linear softmax, embeddings and softmax trained jointly in numpy.

A text is the bag of its words and of the byte 3- to 5-grams inside them (one space stands on either side of a word, A-Z are
folded), each hashed to one of 2^16 rows of an embedding table. The mean embedding of the bag goes through a linear softmax
over two classes. A misspelling never seen shares most of its n-grams with the word it comes from, and so its vectors.

After training, the softmax's margin is linear in the mean, so each row of the table becomes one fixed-point number; a text's
margin is an exact integer sum over its bag divided by the bag's size, the same whatever the partitioning.

Training takes at most `rows_a_class` labelled rows of each class (those of the smallest hashes of doc_id), as bags; the
loss weighs the classes back to their shares among all labelled rows. doc_id, lang, source and labels are no inputs.

Edge cases: a null or empty text has an empty bag and gets the softmax of the bias alone; without rows of both classes every
score is the share of label 1 (0 without any); repeated rows get equal scores; whole texts are read, however long; other
columns pass through, and one named like an output gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import annotate, blocks, map_arrow, utf8

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
SCALE = 1 << 12
DIM = 4
LEAST_ROWS = 8
GAIN = 300.0  # the mean is taken times this, so that a few telling words among hundreds can move the margin


@dataclass(frozen=True)
class ToxicityModel:
    margins: np.ndarray  # of each bucket, in fixed point
    bias: float


def _bags(column):
    """For blocks of rows: the first row, the bucket of every feature, and feature bounds by row."""
    data, offsets = utf8(column)
    for a, z in blocks(offsets, W.BLOCK // 2):
        own = offsets[a : z + 1] - offsets[a]
        padded = np.full(len(data[offsets[a] : offsets[z]]) + z - a + 1, 32, np.uint8)
        row = np.repeat(np.arange(z - a), np.diff(own))
        padded[np.arange(own[-1]) + row + 1] = data[offsets[a] : offsets[z]]
        at = own + np.arange(z - a + 1)
        block = W.Block(np.where(W.SPACE[padded], np.uint8(32), padded), np.append(at[:-1], len(padded)), lower=True)
        n = len(padded)
        spaces = np.concatenate([[0], np.cumsum(block.space)])
        starts, keys = [block.starts], [block.hashes()]
        for size in SIZES:
            s = np.arange(max(0, n - size + 1))
            s = s[spaces[s + size - 1] == spaces[s + 1]]
            starts.append(s)
            keys.append(block.slices(s, s + size))
        # a gram may begin with the space before a row's first word, which the row before ends with
        where = np.concatenate([starts[0], *[s + block.space[s] for s in starts[1:]]])
        of = np.searchsorted(at, where, "right") - 1
        buckets = (np.concatenate(keys) >> np.uint64(48)).astype(np.int32)
        yield a, z, of, buckets


def _fit(bags: pa.Table, prior: float, epochs: int, rate: float, decay: float, seed: int = 7):
    """bags: toxic, buckets and values (shares of the bag) of each row. Adam over all of them, at a rate that falls to
    nothing over the latter half of the epochs; returns the margin of each bucket and the bias."""
    n, toxic = bags.num_rows, bags["toxic"].to_numpy() > 0
    lists = bags["buckets"].combine_chunks()
    rows = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.int32), lists.value_lengths().to_numpy())
    buckets = lists.flatten().to_numpy().view(np.uint16)
    value = bags["values"].combine_chunks().flatten().to_numpy()
    del bags, lists
    common = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(buckets), W.BLOCK):  # bincount widens what it is given
        common += np.bincount(buckets[at : at + W.BLOCK], minlength=BUCKETS)
    common = common >= LEAST_ROWS  # what a few rows have alone tells nothing of others
    kept = common[buckets]
    rows, value = rows[kept], np.float32(GAIN) * value[kept]
    used = np.flatnonzero(common)
    column = (np.cumsum(common) - 1).astype(np.uint16)[buckets[kept]]
    del buckets, kept
    if not len(used):
        return np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    random = np.random.Generator(np.random.PCG64(seed))
    table = random.normal(0, 0.05, (DIM, len(used))).astype(np.float32)
    top, bias = random.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.log([1 - prior, prior]).astype(np.float32)
    weight = np.where(toxic, prior / max(toxic.sum(), 1), (1 - prior) / max((~toxic).sum(), 1)).astype(np.float32)
    truth = np.stack([~toxic, toxic], 1).astype(np.float32)
    row_ids, row_at = np.unique(rows, return_index=True)
    by_column = np.argsort(column, kind="stable").astype(np.int32)
    column_at = np.searchsorted(column[by_column], np.arange(len(used)))
    rows_by_column, value_by_column = rows[by_column], value[by_column]
    del rows, by_column
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, top, bias)]
    for epoch in range(1, epochs + 1):
        mean = np.zeros((n, DIM), np.float32)
        for k in range(DIM):
            mean[row_ids, k] = np.add.reduceat(table[k][column] * value, row_at)
        z = mean @ top + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        error = (p - truth) * weight[:, None]
        back = (error @ top.T).T
        gradients = (
            np.stack([np.add.reduceat(back[k][rows_by_column] * value_by_column, column_at) for k in range(DIM)]) + decay * table,
            mean.T @ error + decay * top,
            error.sum(0),
        )
        for x, g, (m, v) in zip((table, top, bias), gradients, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * min(1, 2 * (1 - (epoch - 1) / epochs)) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    margins = np.zeros(BUCKETS)
    margins[used] = GAIN * ((top[:, 1] - top[:, 0]) @ table)
    return margins, float(bias[1] - bias[0])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, rows_a_class: int = 1500, epochs: int = 120, rate: float = 0.05, decay: float = 3e-4, seed: int = 7
) -> ToxicityModel:
    """Learn from the labelled rows given. One task trains on `rows_a_class` bags of each class at most; the driver gets the margins."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    share = known.agg(F.count("*").alias("n"), F.sum((F.col("_toxic") > 0).cast("long")).alias("toxic")).first()
    prior = (share["toxic"] or 0) / max(share["n"], 1)
    if not 0 < prior < 1:
        return ToxicityModel(np.zeros(BUCKETS, np.int32), 40.0 if prior else -40.0)
    pick = lambda one: known.where((F.col("_toxic") > 0) == one).orderBy(F.xxhash64("_id"), "_id").limit(rows_a_class)
    sample = F.broadcast(pick(True).unionByName(pick(False)))
    chosen = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id"), "inner").select("_id", "_toxic", "text")

    def bags(batches):
        for batch in batches:
            for a, z, of, buckets in _bags(batch.column(2)):
                key, counts = np.unique(of * BUCKETS + buckets, return_counts=True)
                bounds = np.searchsorted(key, np.arange(z - a + 1) * BUCKETS).astype(np.int32)
                values = counts / np.bincount(of, minlength=z - a)[key // BUCKETS]
                parts = ((key % BUCKETS).astype(np.uint16).view(np.int16), values.astype(np.float32))
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in parts]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, z - a) for k in (0, 1)), *lists], names=["id", "toxic", "buckets", "values"])

    def train(batches):
        got = list(batches)
        if sum(b.num_rows for b in got):
            held = [pa.Table.from_batches(got).sort_by("id")]
            got.clear()
            margins, bias = _fit(held.pop(), prior, epochs, rate, decay, seed)
            fixed = np.rint(margins * SCALE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([fixed.tobytes()], pa.binary()), pa.array([bias])], names=["margins", "bias"])

    gathered = map_arrow(chosen, bags, "id long, toxic int, buckets array<short>, values array<float>").repartition(1)
    got = map_arrow(gathered, train, "margins binary, bias double").collect()
    if not got:
        return ToxicityModel(np.zeros(BUCKETS, np.int32), float(np.log(prior / (1 - prior))))
    return ToxicityModel(np.frombuffer(bytes(got[0]["margins"]), np.int32), got[0]["bias"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on)."""
    margins, bias = model.margins, model.bias

    def compute(batch):
        column = batch.column(batch.schema.get_field_index("text"))
        score = np.full(len(column), bias, np.float64)
        for a, z, of, buckets in _bags(column):
            order = np.argsort(of, kind="stable")
            run = np.concatenate([[0], np.cumsum(margins[buckets[order]], dtype=np.int64)])
            bounds = np.searchsorted(of[order], np.arange(z - a + 1))
            n = np.diff(bounds)
            score[a:z] += (run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(n, 1) / SCALE
        score = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return annotate(docs, compute, "score double, predicted int")
