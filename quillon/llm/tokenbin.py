"""Token ids in a binary file format: Re-Pair grammar compression per shard, random access by expansion lengths.

Texts are encoded, sorted by doc_id, and cut into shards of about `SHARD_TOKENS` ids. In each shard the most frequent pairs
of neighbouring ids are replaced by new symbols, again and again: a round takes the pairs that occur at least `LEAST` times,
most frequent first, so that no symbol is the left part of one and the right part of another (then no two matches overlap).
A pair of equal symbols is replaced from the start of each run of them. A pair never spans two documents, so every document
starts at a symbol, and the stored expansion lengths find any id. By default a shard has ROUNDS rounds of RULES_A_ROUND pairs
of LEAST occurrences or more, as rules beyond cost time and save little; with rounds=None, least=2 rounds go on until no pair
occurs twice, which is Re-Pair to its end. The ids read back are the same either way.

File format: a table of Parquet files with one row per shard (part, shard, n_tokens, n_docs, payload). The payload is
little-endian: magic `QRP1`; counts of documents, rules, symbols and ids; document ids and null flags; where each
document's symbols and ids start; left and right symbol of each rule and the number of ids it expands to; the symbols.
The final id of a document is a symbol of its own and reads as `end_id`.

Edge cases: a null text is empty and has the end id alone; null doc_ids come first; rows with equal doc_id are in order of
their texts; a text longer than a shard gets a shard of its own; other columns are ignored; an empty table makes no shards.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as T
from . import _words as W
from ._shared import blocks, map_arrow, materialize, utf8

SHARD_TOKENS = 1 << 21
ROUNDS = 8
RULES_A_ROUND = 512
LEAST = 24
MAGIC = b"QRP1"


def _frequent_pairs(seq: np.ndarray, apart: np.ndarray, vocabulary: int, n_symbols: int, rules: int, least: int) -> np.ndarray:
    """Keys left * n_symbols + right of the pairs to replace in this round."""
    slots = (seq[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + seq[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(12)
    inside = seq != vocabulary
    apart &= inside[:-1]
    apart &= inside[1:]
    np.copyto(slots, np.uint32(1 << 20), where=~apart)
    slots = slots.astype(np.int64)
    heavy = np.bincount(slots, minlength=(1 << 20) + 1)
    heavy[1 << 20] = 0
    found, enough = np.zeros(0, np.int64), heavy[heavy >= least]
    for bar in (int(np.partition(enough, -4 * rules)[-4 * rules]) if len(enough) >= 4 * rules else least, least):
        if not len(found):
            at = np.flatnonzero((heavy >= bar).take(slots, mode="clip"))
            found, counts = np.unique(seq[at].astype(np.int64) * n_symbols + seq[at + 1], return_counts=True)
            found, counts = found[counts >= least], counts[counts >= least]
    lefts, rights, doubled, out = set(), set(), set(), []
    for key in found[np.lexsort((found, -counts))].tolist():
        a, b = divmod(key, n_symbols)
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)) or a in doubled or b in doubled:
            continue
        if a == b:
            doubled.add(a)
        lefts.add(a)
        rights.add(b)
        out.append(key)
        if len(out) == rules:
            break
    return np.array(out, np.int64)


def _first_of_runs(seq: np.ndarray) -> np.ndarray:
    """For each pair of neighbours: False where both are equal and an odd number of the same symbol lies before in its run."""
    same = np.flatnonzero(seq[1:] == seq[:-1])
    run = np.concatenate([[True], np.diff(same) > 1])[: len(same)]
    k = np.arange(len(same))
    out = np.ones(len(seq) - 1, bool)
    out[same[(k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 1]] = False
    return out


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, rounds: int | None = ROUNDS, rules: int = RULES_A_ROUND, least: int = LEAST) -> dict[str, np.ndarray]:
    """ids: the documents end to end, each with its final symbol `vocabulary` at ends[k] - 1."""
    seq, n_symbols = ids.astype(np.int32), vocabulary + 1
    left, right = [], []
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(seq) < 2:
            break
        apart = _first_of_runs(seq)
        chosen = _frequent_pairs(seq, apart.copy(), vocabulary, n_symbols, rules, least)
        if not len(chosen):
            break
        a, b = chosen // n_symbols, chosen % n_symbols
        left.append(a)
        right.append(b)
        la, lb = np.unique(a), np.unique(b)
        of_left, of_right = np.zeros(n_symbols, np.int32), np.zeros(n_symbols, np.int32)
        of_left[la] = np.arange(1, len(la) + 1)
        of_right[lb] = np.arange(1, len(lb) + 1)
        rule = np.zeros((len(la) + 1, len(lb) + 1), np.int32)
        rule[of_left[a], of_right[b]] = n_symbols + np.arange(len(chosen))
        of_left *= len(lb) + 1
        # All places exist: with mode="clip" none is checked, which takes half the time.
        wide = seq.astype(np.int64)
        cell = of_left.take(wide[:-1], mode="clip") + of_right.take(wide[1:], mode="clip")
        at = np.flatnonzero((cell > len(lb)) & apart)
        at = at[rule.reshape(-1).take(cell.take(at, mode="clip"), mode="clip") > 0]
        seq[at] = rule.reshape(-1)[cell[at]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        n_symbols += len(chosen)
    left = np.concatenate(left) if left else np.zeros(0, np.int64)
    right = np.concatenate(right) if right else np.zeros(0, np.int64)
    lengths = np.ones(n_symbols, np.int64)
    for k in range(len(left)):
        lengths[vocabulary + 1 + k] = lengths[left[k]] + lengths[right[k]]
    return {"left": left, "right": right, "lengths": lengths[vocabulary + 1 :], "seq": seq, "doc_symbols": np.flatnonzero(seq == vocabulary) + 1}


def write_shard(doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, ends: np.ndarray, vocabulary: int, end_id: int, **grammar) -> bytes:
    got = compress(ids, ends, vocabulary, **grammar)
    wide = np.dtype("<u2") if vocabulary + 1 + len(got["left"]) <= 0xFFFF else np.dtype("<u4")
    head = struct.pack("<4s6q", MAGIC, len(doc_ids), len(got["left"]), len(got["seq"]), len(ids), vocabulary, end_id)
    starts = lambda x: np.concatenate([[0], x[:-1]]).astype("<i8")
    return b"".join(
        [head, struct.pack("<q", wide.itemsize), doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), starts(got["doc_symbols"]).tobytes(), starts(ends).tobytes()]
        + [got[k].astype(wide).tobytes() for k in ("left", "right")]
        + [got["lengths"].astype("<u4").tobytes(), got["seq"].astype(wide).tobytes()]
    )


class Shard:
    """A payload, read without expanding it."""

    def __init__(self, payload: bytes):
        magic, self.n_docs, n_rules, n_symbols, self.n_tokens, self.vocabulary, self.end_id = struct.unpack_from("<4s6q", payload)
        (width,) = struct.unpack_from("<q", payload, 52)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = 60

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        kind = "<u2" if width == 2 else "<u4"
        self.doc_ids, self.nulls = take("<i8", self.n_docs), take(np.uint8, self.n_docs).astype(bool)
        self.doc_symbols, self.doc_starts = take("<i8", self.n_docs), take("<i8", self.n_docs)
        self.left, self.right = take(kind, n_rules).astype(np.int64), take(kind, n_rules).astype(np.int64)
        self.lengths, self.seq = take("<u4", n_rules).astype(np.int64), take(kind, n_symbols)
        self._flat = None

    def _expansions(self):
        if self._flat is None:
            base = self.vocabulary + 1
            sizes = np.concatenate([np.ones(base, np.int64), self.lengths])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = np.zeros(int(sizes.sum()), np.int32)
            flat[:base] = np.arange(base)
            flat[self.vocabulary] = self.end_id
            for k in range(len(self.left)):
                a, b, to = self.left[k], self.right[k], begin[base + k]
                flat[to : to + sizes[a]] = flat[begin[a] : begin[a] + sizes[a]]
                flat[to + sizes[a] : to + sizes[a] + sizes[b]] = flat[begin[b] : begin[b] + sizes[b]]
            self._flat = flat, begin, sizes
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin, sizes = self._expansions()
        return T.gather(flat, begin[symbols], sizes[symbols])

    def tokens(self) -> np.ndarray:
        return self.expand(self.seq)

    def read(self, doc: int, start: int, length: int) -> np.ndarray:
        """ids start to start + length of the doc-th document; only the symbols that cover them are expanded."""
        last = self.doc_symbols[doc + 1] if doc + 1 < self.n_docs else len(self.seq)
        symbols = self.seq[self.doc_symbols[doc] : last]
        sizes = self._expansions()[2][symbols]
        ends = np.cumsum(sizes)
        first = int(np.searchsorted(ends, start, "right"))
        stop = int(np.searchsorted(ends, start + length, "left")) + 1
        skip = start - int(ends[first] - sizes[first]) if first < len(ends) else 0
        return self.expand(symbols[first:stop])[skip : skip + length]


def write_tokens(docs: DataFrame, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, **grammar) -> DataFrame:
    """Encode docs with the word tokenizer at path, write the files, and return the table that reads them.

    grammar: rounds, rules and least of `compress`.
    """

    def run(batches):
        from pyspark import TaskContext

        coder = T.encoder(path, "word")
        vocabulary = coder.tokenizer.get_vocab_size()
        part, shard = TaskContext.get().partitionId(), 0
        ids, sizes, names, nulls, held = [], [], [], [], 0

        def flush():
            nonlocal ids, sizes, names, nulls, held, shard
            ends = np.cumsum(np.concatenate(sizes))
            payload = write_shard(np.concatenate(names), np.concatenate(nulls), np.concatenate(ids), ends, vocabulary, end_id, **grammar)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(ends[-1])], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([payload], pa.binary())]
            ids, sizes, names, nulls, held = [], [], [], [], 0
            shard += 1
            return pa.RecordBatch.from_arrays(row, names=["part", "shard", "n_tokens", "n_docs", "payload"])

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            name = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, z in blocks(offsets, W.BLOCK // 2):
                flat, n = coder.encode(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                ended = np.full(len(flat) + len(n), vocabulary, np.int32)
                inside = np.ones(len(ended), bool)
                inside[np.cumsum(n + 1) - 1] = False
                ended[inside] = flat
                ids.append(ended)
                sizes.append(n + 1)
                names.append(name[a:z])
                nulls.append(null[a:z])
                held += len(ended)
                if held >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(map_arrow(ordered, run, "part int, shard int, n_tokens long, n_docs long, payload binary"), "tokens")


def read_tokens(files: DataFrame, digest) -> DataFrame:
    """For each document of the files, in order: doc_id, start, n_tokens and digest(ids) as ids_crc32.

    Only one number for each written part reaches the driver: how many ids lie before it.
    """
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")
    before = dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))
    from pyspark.sql import Window

    order = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", "shard", "n_tokens").withColumn("_before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    placed = files.select("part", "shard", "payload").join(offsets.select("part", "shard", "_before"), ["part", "shard"])

    def run(batches):
        for batch in batches:
            for part, lead, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held = Shard(payload.as_py())
                ids = held.tokens()
                bounds = np.append(held.doc_starts, len(ids))
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [digest(raw[4 * a : 4 * z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.doc_ids, pa.int64(), mask=held.nulls),
                        pa.array(before[part] + lead + held.doc_starts),
                        pa.array(np.diff(bounds)),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return map_arrow(placed.select("part", "_before", "payload"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def crc(raw) -> int:
    return zlib.crc32(raw)
