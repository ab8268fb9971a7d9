"""Hashes, canonical JSON and the arithmetic of scores, as Columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillon.shipping import packaged

from .text import column

Z95 = 1.959963984540054  # fixed value: the two-sided 95 % quantile
RUN = 1 << 16  # tokens that SimHash holds as shingles at once


def sha256(x) -> Column:
    return F.sha2(column(x), 256)


def canonical_json(**fields) -> Column:
    """Compact JSON of the fields, keys in order, nulls kept, non-ASCII text as it is. Not for floating point."""
    ordered = F.struct(*[column(v).alias(k) for k, v in sorted(fields.items())])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def hash_bucket(salt: str, group) -> Column:
    """sha256(salt, NUL, group) as a fraction: its first 52 bits, exact in a double."""
    digest = F.sha2(F.concat(F.lit(salt), F.lit("\0"), column(group).cast("string")), 256)
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def split_of(salt: str, group, train: float = 0.6, calibration: float = 0.2) -> Column:
    at = hash_bucket(salt, group)
    return F.when(at < train, "train").when(at < train + calibration, "calibration").otherwise("test")


def ratio(part, whole) -> Column:
    """part / whole, null where whole is 0."""
    return column(part).cast("double") / F.nullif(column(whole).cast("double"), F.lit(0.0))


def wilson(successes, trials) -> tuple[Column, Column]:
    """The 95 % interval of a share, within [0, 1]; null without trials."""
    n, p = F.nullif(column(trials).cast("double"), F.lit(0.0)), ratio(successes, trials)
    z2 = Z95 * Z95
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def scaled(x, scale: int = 10_000) -> Column:
    """floor(x * scale + 1/2) as an integer: a rounding that engines agree on."""
    return F.floor(column(x) * scale + 0.5).cast("long")


def linear_decay(hours, window: float = 72.0) -> Column:
    """1 at no distance, 0 from the window on; null stays null."""
    h = column(hours)
    return F.when(h.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(h) / window))


def weighted(parts: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """Score and available weight of parts (value, weight): unavailable (null) parts leave the weights, they aren't zero."""
    have = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts.values()), F.lit(0.0))
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts.values()), F.lit(0.0))
    return total / F.nullif(have, F.lit(0.0)), have


def simhash64(tokens) -> Column:
    """64-bit SimHash of five-token shingles (of the tokens themselves if fewer): big-endian SHA-256 heads, ties set the bit.

    Counting 64 bits over all shingles has no built-in form that hashes each shingle once, so this one is an Arrow function.
    It is made when it is asked for: its type needs no session then, and none is needed to import this module.
    """
    packaged()
    return F.arrow_udf(_simhash, LongType())(column(tokens))


def _simhash(tokens: pa.Array) -> pa.Array:
    """Rows in runs of about RUN tokens, so that the shingles held at once don't grow with the batch."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, parts, first = np.cumsum(sizes), [], 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + RUN, "right")))
        parts.append(_simhash_run(tokens.slice(first, last - first)))
        first = last
    return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())


def _simhash_run(tokens: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().to_pylist()
    ends = np.cumsum(sizes)
    whole = np.flatnonzero(np.repeat(ends, sizes) - np.arange(len(words)) >= 5) if len(words) else np.zeros(0, np.int64)
    short = np.flatnonzero(np.repeat(sizes < 5, sizes))
    at = np.concatenate([whole, short])
    parts = ["\0".join(words[i : i + 5]) for i in whole.tolist()] + [words[i] for i in short.tolist()]
    order = np.argsort(at, kind="stable")
    row = np.repeat(np.arange(len(sizes)), sizes)[at[order]]
    heads = np.frombuffer(b"".join(hashlib.sha256(p.encode()).digest()[:8] for p in parts), np.uint8).reshape(-1, 8)[order]
    held, first = np.unique(row, return_index=True)
    ones = np.zeros((len(sizes), 64), np.int64)
    for k in range(8) if len(held) else ():
        ones[held, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(heads[:, k : k + 1], axis=1).astype(np.int64), first)
    n = np.bincount(row, minlength=len(sizes))
    bits = (ones * 2 >= n[:, None]) & (n[:, None] > 0)
    return pa.array(np.packbits(bits, axis=1).view(">i8").reshape(-1).astype(np.int64))
