"""Quality rules: a hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Every document is a bag of byte 4-grams, hashed to 2^16 buckets. One multinomial is counted over all documents, the other
over those that labels mark as good; a document's score is its mean log ratio, in fixed point so that it is the same
whatever the partitioning. Documents below a fixed threshold fail, as do those that fail the base rules.

The trusted rows are all that labels mark as good; the raw counts take every text. Up to BROADCAST trusted ids are broadcast,
so that no text is shuffled; more are joined.

Edge cases: a null or empty text has no words and fails; texts of fewer than 4 bytes score 0; without any trusted row
every score is 0 and only the base rules decide; repeated rows are judged each by itself; other columns pass through,
and one named like an output gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import annotate, blocks, map_arrow, materialize, utf8

GRAM = 4
BUCKETS = 1 << 16
SCALE = 1 << 16
BROADCAST = 4_000_000
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # fixed-point log ratio of each bucket
    threshold: float


def _grams(block: W.Block) -> np.ndarray:
    """The bucket of the 4-gram from each byte on; -1 where the text ends before."""
    n = len(block.data)
    out = np.full(n, -1, np.int64)
    if n >= GRAM:
        at = np.arange(n - GRAM + 1)
        out[: len(at)] = (block.slices(at, at + GRAM) & np.uint64(BUCKETS - 1)).astype(np.int64)
    for k in range(1, GRAM):
        short = block.offsets[1:] - k
        out[short[short >= block.offsets[:-1]]] = -1
    return out


def _score(block: W.Block, weights: np.ndarray) -> np.ndarray:
    at = _grams(block)
    inside = at >= 0
    total = block.per_text(np.where(inside, weights[at], 0))
    n = block.per_text(inside)
    return total / np.maximum(n, 1) / SCALE


def _rules(block: W.Block) -> dict[str, np.ndarray]:
    words = block.hashes()
    texts = block.text_of_word()
    keys, whole = W.windows(words, block.bounds, 3)
    at = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        keys = W.mix(keys[at] + texts[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    twice = np.zeros(len(words) + 2, bool)
    twice[at[W.repeated(keys)] + 2] = True
    covered = twice[2:] | twice[1:-1] | twice[:-2]

    newline = np.flatnonzero(block.data == 10)
    first = np.union1d(block.offsets[:-1], newline + 1)
    first = first[first < len(block.data)]
    last = np.append(first[1:], len(block.data))
    ends_in_newline = (last > first) & (block.data[last - 1] == 10)
    last = last - ends_in_newline
    has_word = np.searchsorted(block.starts, last) > np.searchsorted(block.starts, first)
    first, last = first[has_word], last[has_word]
    text = np.searchsorted(block.offsets, first, "right") - 1
    with np.errstate(over="ignore"):
        lines = W.mix(block.slices(first, last) + text.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    _, kept = np.unique(lines, return_index=True)
    later = np.ones(len(lines), bool)
    later[kept] = False
    return {
        "n_words": block.n_words.astype(np.int64),
        "word_chars": block.per_text(~block.space & ((block.data & 0xC0) != 0x80)),
        "n_symbols": block.per_text(_SYMBOL[block.data]),
        "n_dup_lines": np.bincount(text[later], minlength=len(block.n_words)).astype(np.int64),
        "n_repeat_words": block.per_words(covered),
    }


def _each(column):
    data, offsets = utf8(column)
    for a, z in blocks(offsets, W.BLOCK):
        yield a, z, W.Block(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])


def trusted_rows(labels: DataFrame, label: str, value: int) -> DataFrame:
    """The distinct ids of all rows with this label."""
    return labels.where(F.col(label) == value).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()


def lower_quantile(rows: DataFrame, column: str, quantile: float) -> float | None:
    """The exact quantile, linear between neighbours, of all values that aren't null. The driver gets one row; the values up to the quantile are sorted."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    at = quantile * (n - 1)
    low = int(at)
    least = rows.where(F.col(column).isNotNull()).select(column).orderBy(column).limit(low + 2)
    ends = least.orderBy(F.desc(column)).limit(2 if n > low + 1 else 1).toPandas()[column].tolist()[::-1]
    return float(ends[0] + (ends[-1] - ends[0]) * (at - low))


def fit_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.001, margin: float = 0.05) -> QualityModel:
    """Count both multinomials and set the threshold: `margin` under the given quantile of all trusted documents' scores.

    Only trusted documents that pass the base rules set it. The driver gets BUCKETS rows of counts and two scores.
    """
    ids = trusted_rows(labels, "quality", 1)
    sample = ids.withColumn("_good", F.lit(True))
    if ids.count() <= BROADCAST:
        sample = F.broadcast(sample)
    marked = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id"), "left").select("text", "_good")

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            is_good = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for a, z, block in _each(batch.column(0)):
                at = _grams(block)
                raw += np.bincount(at[at >= 0], minlength=BUCKETS)
                of_good = np.repeat(is_good[a:z], np.diff(block.offsets)) & (at >= 0)
                good += np.bincount(at[of_good], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "raw", "good"])

    counts = map_arrow(marked, count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    if not good.sum():
        return QualityModel(np.zeros(BUCKETS, np.int32), -np.inf)
    ratio = np.log((good + 0.5) / (good.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))
    weights = np.rint(ratio * SCALE).astype(np.int32)
    sampled = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id"), "inner").select("text")
    scores = score_quality(sampled, QualityModel(weights, -np.inf)).where(~F.col("base_failed")).select("llr")
    bar = lower_quantile(materialize(scores, "trusted-scores"), "llr", quantile)
    threshold = -np.inf if bar is None else bar - margin
    return QualityModel(weights, threshold)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with the counts of the base rules, the log-likelihood ratio and the verdict."""
    weights, threshold = model.weights, model.threshold

    def compute(batch):
        parts = []
        for _, _, block in _each(batch.column(batch.schema.get_field_index("text"))):
            rules = _rules(block)
            n = rules["n_words"]
            failed = (n < 50) | (100 * rules["n_repeat_words"] > 50 * n)
            llr = _score(block, weights)
            parts.append([*rules.values(), failed, llr, ~failed & (llr >= threshold)])
        if not parts:
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            return [pa.array([], k) for k in kinds]
        return [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]

    return annotate(docs, compute, FIELDS)
