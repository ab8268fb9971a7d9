"""LM scoring: online logistic context mixing of hashed-context bit predictors, giving total bits per byte.

A text is its tokens: lower-cased words, then one end. Each token is a path of binary decisions, and each decision is
predicted by four predictors from the counts of zeros and ones that training texts had at it: over everything (exact), in the
class of text that the tokens before point to (exact), after the token before, and after the two tokens before (both hashed).
Their logits are combined by a weight vector that a gate selects (how often either hashed context was seen); an adaptive table
refines the mixed probability. The weights learn online, in rounds, each event predicted from the counts of all others.

Paths. Training tokens that make up 1/SHARE of all or more are symbols, as are the end and one escape for all other tokens.
They stand in order of the class they are most frequent in, and every decision halves what is left by training counts, so the
first decisions mostly tell classes apart and a token costs about as many decisions as it has bits of information.

Other tokens. After the escape the probability of a token seen in training follows from its exact count, by class: a table of
all training tokens, joined by token, that grows with the corpus. What is kept for tokens never seen is the share of tokens
seen once among those that would escape if they were left out (Good-Turing). Such a token is spelled, byte by byte with a space after it: its bits are predicted from the last 1,
2, 3 and 4 bytes and the class and mixed in the same way, learned from the distinct tokens that are no symbols.

Classes are the values of `class_column` in training texts (the CLASSES - 1 most frequent, all others together); a scored
text's own value is not looked at. Only training texts and the scored text itself decide a score: counts, symbols and classes
come from training texts, and sums are in fixed point, so scores depend neither on other texts that are held out nor on the
order of rows or their partitions.

Bounds. At most SHARE symbols are broadcast, whatever the corpus. The two hashed tables have 2^bits slots, where bits follows
the number of training tokens up to TABLE_BITS: beyond that contexts share slots.

Learning. The mixing weights (5 inputs and 16 gates) and the table that refines learn from every event of all training texts
and of all tokens that are no symbols. A hash deals them into ROUNDS rounds, of which each is as large as all before it. A round
is predicted with the weights that the rounds before left, and ends with an online Newton step: its gradient, over the squared
gradients of all events so far. Sums are whole numbers, so it does not matter which task adds up what.

Edge cases: a null or empty text is the end alone; without any training text every score is what the untrained model gives;
repeated rows each get a row; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import annotate, blocks, map_arrow, materialize, utf8
from ._tokens import Table, gather

END = "\n"
END_SYMBOL, ESCAPE = 0, 1
SHARE, LEAST = 1 << 19, 2
CLASSES = 8
TABLE_BITS, SPELL_BITS = 21, 19
FIXED = 1 << 36
EVENT = 1 << 20
_PIECE = 1 << 15
_BLOCK = 1 << 13
_HELD = 1 << 21
_RANGE = 1 << 17
STEPS = 33
ROUNDS, PRIOR = 4, 20.0
_ERROR, _SQUARE, _INPUT = 1 << 24, 1 << 16, 16  # units of errors, squared errors and inputs in sums
_START, _STOP = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_SEEN = np.array([1, 3, 16])  # a hashed context seen never, once or twice, up to 15 times, more often
GATES = 16


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], all of which exist: without the check for that a read takes half the time."""
    return values.take(at, mode="clip")


def _spread(node: np.ndarray) -> np.ndarray:
    return (W.mix((node.astype(np.uint64) >> np.uint64(3)) * _M[0] + _M[1]) >> np.uint64(32)).astype(np.uint32)


def _high(context: np.ndarray) -> np.ndarray:
    return (context >> np.uint64(32)).astype(np.uint32)


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The slot of a node after a context: the first bits of the sum of both hashes. The nodes of a group of three levels (8 numbers)
    lie beside each other, so a path reads memory in few places."""
    return ((_high(context) + _spread(node)) >> np.uint32(32 - bits)).astype(np.int64) ^ (node & 7)


def _logit(one, zero):
    return np.clip(np.log((one + 0.15) / (zero + 0.15)), -7.9, 7.9)


@dataclass
class Mixer:
    """Gated weights of k inputs and a constant, and the table that refines what they give."""

    k: int
    weights: np.ndarray = field(default=None)
    refined: np.ndarray = field(default_factory=lambda: np.zeros((GATES, STEPS, 2)))
    precision: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.precision is None:
            self.precision = np.tile(PRIOR * np.eye(self.k + 1), (GATES, 1, 1))
        if self.weights is None:
            self.weights = np.column_stack([np.full((GATES, self.k), 1.2 / self.k), np.zeros(GATES)])

    def mixed(self, x: list[np.ndarray], of_gate):
        """The mixed probability and its step. of_gate gives a value of each gate to every event."""
        by = self.weights.astype(np.float32).T.copy()
        z = of_gate(by[self.k])
        for k in range(self.k):
            part = of_gate(by[k])
            part *= x[k]
            z += part
        np.clip(z, np.float32(-15.9), np.float32(15.9), out=z)
        step = z + np.float32(16)
        step *= np.float32((STEPS - 1) / 32)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        return np.reciprocal(z, out=z), np.rint(step, out=step).astype(np.int64)

    def step(self, sums: np.ndarray) -> None:
        """An online Newton step with the sums of a round."""
        gradient, squares, seen = _Sums.split(sums, self.k + 1)
        self.refined += seen
        self.precision += squares / (_SQUARE * _INPUT**2)
        self.weights += np.linalg.solve(self.precision, gradient[..., None] / (_ERROR * _INPUT))[..., 0]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """By gate and step: the weight of the mixed probability, and what is added to it."""
        one, total = self.refined[:, :, 1], self.refined.sum(2)
        trust = 0.5 * total / (total + 200)
        return tuple(x.reshape(-1).astype(np.float32) for x in ((1 - trust) + trust / (total + 1), trust * one / (total + 1)))

    def log2(self, table, x: list[np.ndarray], gate: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """log2 of each event's probability."""
        p, cell = self.mixed(x, lambda values: _take(values, gate))
        cell += gate * STEPS
        p *= _take(table[0], cell)
        p += _take(table[1], cell)
        p -= (1 - ones).astype(np.float32)
        np.abs(p, out=p)
        return np.log2(np.clip(p, np.float32(1e-7), np.float32(1), out=p), out=p)


class _Sums:
    """What a round of events adds to a mixer, in whole numbers: by gate the gradient, the squares and how often each step was seen."""

    def __init__(self, mixer: Mixer):
        self.mixer, k = mixer, mixer.k + 1
        self.all = np.zeros(GATES * (k + k * k + STEPS * 2), np.int64)
        self.gradient, self.squares, self.seen = self.split(self.all, k)

    @staticmethod
    def split(sums: np.ndarray, k: int):
        gradient, squares, seen = np.split(sums, [GATES * k, GATES * (k + k * k)])
        return gradient.reshape(GATES, k), squares.reshape(GATES, k, k), seen.reshape(GATES, STEPS, 2)

    def add(self, x: list[np.ndarray], gate: np.ndarray, ones: np.ndarray) -> None:
        """x: inputs, as numbers of 1/_INPUT where they are int8."""
        order = np.argsort(gate.astype(np.uint8, copy=False), kind="stable")
        sizes = np.bincount(gate, minlength=GATES)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        inputs = np.empty((len(x) + 1, len(gate)))
        x = [_take(v if v.dtype == np.int8 else np.rint(v * np.float32(_INPUT)).astype(np.int8), order) for v in x]
        for row, v in zip(inputs, x, strict=False):
            row[:] = v
        inputs[-1] = _INPUT
        ones = _take(ones, order)
        p, step = self.mixer.mixed([v * np.float32(1 / _INPUT) for v in x], lambda values: np.repeat(values, sizes))
        step += np.repeat(np.arange(GATES) * STEPS, sizes)
        step *= 2
        step += ones
        self.seen += np.bincount(step, minlength=GATES * STEPS * 2).reshape(GATES, STEPS, 2)
        error = np.rint((ones.astype(np.float32) - p) * np.float32(_ERROR)).astype(np.float64)
        square = np.rint(error * error * (_SQUARE / _ERROR**2))
        # Products of whole numbers that stay below 2^53: exact in any order.
        right = np.empty((len(x) + 2, len(gate)))
        np.multiply(inputs, square, out=right[:-1])
        right[-1] = error
        for g in np.flatnonzero(sizes):
            both = (inputs[:, bounds[g] : bounds[g + 1]] @ right[:, bounds[g] : bounds[g + 1]].T).astype(np.int64)
            self.gradient[g] += both[:, -1]
            self.squares[g] += both[:, :-1]

    def rows(self):
        cell = np.flatnonzero(self.all)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(self.all[cell])], names=["cell", "n"])


def _learned(rows: DataFrame, by, k: int, events) -> Mixer:
    """A mixer that has learned from all rows. by: columns whose hash deals them into rounds. events: inputs, gate and bits of a
    batch, in pieces."""
    mixer, share = Mixer(k), F.pmod(F.xxhash64(*by), F.lit(1 << (ROUNDS - 1)))
    for r in range(ROUNDS):

        def add(batches, mixer=mixer):
            sums = _Sums(mixer)
            for batch in batches:
                for x, gate, ones in events(batch):
                    sums.add(x, gate, ones)
            yield from sums.rows()

        own = rows.where((share >= (1 << r) // 2) & (share < 1 << r))
        added = map_arrow(own, add, "cell int, n long").groupBy("cell").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
        total = np.zeros(len(_Sums(mixer).all))
        for cell, n in added.collect():  # one row for each cell
            total[cell] = float(n)
        mixer.step(total)
    return mixer


class Paths:
    """Symbols in order and the decisions that lead to each. weight: of each symbol; by_class: the same by class."""

    def __init__(self, weight: np.ndarray, by_class: np.ndarray):
        n = len(weight)
        run = np.concatenate([[0], np.cumsum(weight)]).astype(np.float64)
        runs = np.concatenate([np.zeros((1, by_class.shape[1])), np.cumsum(by_class, 0)])
        low, high, open_ = np.zeros(n, np.int64), np.full(n, n, np.int64), np.arange(n)
        nodes, bits, who, cuts = [], [], [], []
        group, local, groups = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(open_):
            lo, hi = low[open_], high[open_]
            half = (run[lo] + run[hi]) / 2
            at = np.clip(np.searchsorted(run, half), lo + 1, hi - 1)
            before = np.maximum(at - 1, lo + 1)
            at = np.where(half - run[before] < run[at] - half, before, at)
            bit = open_ >= at
            if len(nodes) % 3 == 0:  # a group of nodes starts
                roots, own = np.unique(at, return_inverse=True)
                group[open_], local[open_] = groups + own, 1
                groups += len(roots)
            node = group[open_] * 8 + local[open_]
            local[open_] = local[open_] * 2 + bit
            nodes.append(node)
            bits.append(bit)
            who.append(open_)
            node, first = np.unique(node, return_index=True)
            cuts.append((node, lo[first], at[first], hi[first]))
            low[open_], high[open_] = np.where(bit, at, lo), np.where(bit, hi, at)
            open_ = open_[high[open_] - low[open_] > 1]
        order = np.argsort(np.concatenate(who), kind="stable")
        node, bit = np.concatenate(nodes)[order], np.concatenate(bits)[order]
        self.step = (node * 2 + bit) << 32 | _spread(node)
        left, right = np.ones(groups * 8), np.ones(groups * 8)
        lefts, rights = np.zeros((groups * 8, by_class.shape[1])), np.zeros((groups * 8, by_class.shape[1]))
        for node, lo, at, hi in cuts:
            left[node], right[node] = run[at] - run[lo], run[hi] - run[at]
            lefts[node], rights[node] = runs[at] - runs[lo], runs[hi] - runs[at]
        self.size = np.bincount(np.concatenate(who), minlength=n)
        self.start = np.cumsum(self.size) - self.size
        self.sides, self.class_sides = np.stack([left, right]), np.stack([lefts.T, rights.T])
        logit, own = self.logits(*self.sides, *self.class_sides)
        self.logit, self.class_logit, self.sides, self.class_sides = (x.astype(np.float32, order="C") for x in (logit, own, self.sides, self.class_sides))

    @staticmethod
    def logits(left, right, lefts, rights):
        share, other = ((x + 0.3) / (left + right + 0.6) for x in (right, left))
        own = np.log((rights + 8 * share) / (lefts + 8 * other))
        return np.clip(np.log(share / other), -7.9, 7.9), np.clip(own, -7.9, 7.9)

    @property
    def node(self) -> np.ndarray:
        return self.step >> 33

    @property
    def bit(self) -> np.ndarray:
        return self.step >> 32 & 1

    def left_out(self) -> tuple[np.ndarray, np.ndarray]:
        """Both logits in 1/_INPUT from the counts without the event itself, by node and bit, the second by class and whether that
        is the event's true class, too."""
        kinds, n = self.class_logit.shape
        logit, own = np.zeros((n, 2), np.int8), np.zeros((kinds, 2, n, 2), np.int8)
        for bit in (0, 1):
            sides = [np.maximum(self.sides[k] - np.float32(k == bit), 0) for k in (0, 1)]
            for mine in (0, 1):
                class_sides = [np.maximum(self.class_sides[k] - np.float32(k == bit) * np.float32(mine), 0) for k in (0, 1)]
                whole = [np.rint(x * np.float32(_INPUT)) for x in self.logits(*sides, *class_sides)]
                logit[:, bit], own[:, mine, :, bit] = whole
        self.sides = self.class_sides = None  # not sent to the tasks
        return logit.reshape(-1), own.reshape(-1)


@dataclass
class MixingModel:
    lookup: Table  # word hash to symbol
    paths: Paths
    evidence: np.ndarray  # of each symbol for each class, in fixed point
    prior: np.ndarray
    bits: int
    symbols: dict  # c and base of each symbol
    frozen: np.ndarray = None  # logit and gate of each slot of both hashed tables
    mixer: Mixer = field(default_factory=lambda: Mixer(4))


class _Sequence:
    """The symbols of a block of texts, and the contexts of each."""

    def __init__(self, model: MixingModel, data: np.ndarray, offsets: np.ndarray):
        self.block = block = W.Block(data, offsets, lower=True)
        self.hashes = block.hashes()
        n, texts = len(self.hashes), len(offsets) - 1
        self.at = np.arange(n) + block.text_of_word()
        self.bounds = block.bounds + np.arange(texts + 1)
        first = self.bounds[:-1]
        found = model.lookup.find(self.hashes)
        self.symbol = np.full(n + texts, END_SYMBOL, np.int64)
        self.symbol[self.at] = np.where(found < 0, ESCAPE, found)
        key = np.full(n + texts, _STOP)
        key[self.at] = self.hashes
        one, two = np.full(n + texts, _START), np.full(n + texts, _START)
        one[1:] = key[:-1]
        one[first] = _START
        two[1:] = one[:-1]
        two[first] = _START
        with np.errstate(over="ignore"):
            self.contexts = [_high(W.mix(one)), _high(W.mix(one * _M[3] + two))]
        self.kind = np.zeros(n + texts, np.int64)
        if model.evidence.shape[1] > 1 and texts:
            best = None
            for k, own in enumerate(model.evidence.T.copy()):
                each = _take(own, self.symbol)
                run = np.cumsum(each, dtype=np.int64)
                run -= each
                run -= np.repeat(run[first] - model.prior[k], np.diff(self.bounds))
                if best is None:
                    best = run
                    continue
                self.kind[run > best] = k
                np.maximum(best, run, out=best)

    def events(self, model: MixingModel, low: int, high: int):
        """For the tokens low to high: how many decisions each has; of every one node and bit as one number, and its slots in
        both hashed tables."""
        paths, symbol = model.paths, self.symbol[low:high]
        n = paths.size[symbol]
        ends = np.cumsum(n)
        at = np.repeat(paths.start[symbol] - (ends - n), n)
        at += np.arange(len(at))
        step, shift, slots = _take(paths.step, at), np.uint32(32 - model.bits), []
        spread = step.astype(np.uint32)
        step >>= 32
        local = (step >> 1) & 7
        for c in self.contexts:
            h = np.repeat(c[low:high], n)
            h += spread
            h >>= shift
            slots.append(h ^ local)
        return n, step, slots


def _sequences(model: MixingModel, column, limit: int = W.BLOCK):
    data, offsets = utf8(column)
    for a, z in blocks(offsets, limit):
        yield a, z, _Sequence(model, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])


def _tally(counts: np.ndarray, at: np.ndarray) -> None:
    """Add how often each place occurs in `at`: sorted first, then a range of places at a time, so that memory is met in order."""
    at = np.sort(at)
    cuts = np.searchsorted(at, np.arange(0, len(counts) + _RANGE, _RANGE))
    for k, low in enumerate(range(0, len(counts), _RANGE)):
        own = counts[low : low + _RANGE]
        np.add(own, np.bincount(at[cuts[k] : cuts[k + 1]] - low, minlength=len(own)), out=own, casting="unsafe")


def _sparse(counts: np.ndarray):
    """Rows of the blocks of counts that hold any: up to 255 of each count as bytes, and what lies beyond as a second row."""
    for at in range(0, len(counts), _BLOCK):
        part = counts[at : at + _BLOCK]
        if part.any():
            low = np.minimum(part, 255).astype(np.uint8)
            for raw in (low, part.astype(np.int32) - low):
                if raw.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at // _BLOCK], pa.int32()), pa.array([raw.tobytes()], pa.binary())], names=["block", "counts"])


def _summed(parts: DataFrame, total: int) -> np.ndarray:
    """Blocks of counts summed over all tasks. A task adds up what comes for its blocks, one row after the other; the driver
    gets the fixed number of sums."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = raw.as_buffer()
                part = np.frombuffer(data, np.uint8 if data.size == _BLOCK else np.int32)
                held[number] = part.astype(np.int64) if number not in held else held[number] + part
        for number, part in held.items():
            least = np.minimum(part, (1 << 31) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([least.tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros(-(-total // _BLOCK) * _BLOCK, np.int32)
    got = map_arrow(parts.repartition("block"), add, "block int, counts binary").toArrow()
    for number, raw in zip(got["block"].to_pylist(), got["counts"], strict=True):
        part = np.frombuffer(raw.as_buffer(), np.int32)
        out[number * _BLOCK : number * _BLOCK + len(part)] = part
    return out[:total]


def _packed(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The logit in 1/16 as the low byte, and above it how often a slot was seen, as the gate needs it."""
    out = np.zeros(len(zero), np.int16)
    for at in range(0, len(zero), 1 << 18):
        part = [np.maximum(x[at : at + (1 << 18)], 0).astype(np.float32) for x in (zero, one)]
        logit = np.rint(_logit(part[1], part[0]) * np.float32(_INPUT)).astype(np.int16)
        out[at : at + len(logit)] = (np.searchsorted(_SEEN, part[0] + part[1], "right") << 8) | (logit & 255)
    return out


def _unpacked(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cells.astype(np.int8), cells >> 8


def _frozen(counts: np.ndarray, tables: int) -> np.ndarray:
    """counts: zeros and ones of each slot, table after table. A row of _packed for each table."""
    return np.stack([_packed(*own.T) for own in counts.reshape(tables, -1, 2)])


def _left_out(counts: np.ndarray, tables: int) -> np.ndarray:
    """As _frozen, from the counts without the event itself, for each slot and bit."""
    return np.stack([np.column_stack([_packed(zero - 1, one), _packed(zero, one - 1)]).reshape(-1) for zero, one in (own.T for own in counts.reshape(tables, -1, 2))])


def count_tokens(docs: DataFrame, n_classes: int) -> DataFrame:
    """h (the token's hash), token, c, c0, c1 ... (of each class) for every distinct token of docs (text, class), ends included."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            kinds = batch.column(1).to_numpy()
            for a, z in blocks(offsets, 2 * W.BLOCK):
                block = W.Block(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], lower=True)
                h = block.hashes()
                order = np.argsort(h)
                sorted_ = h[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(h) else np.zeros(0, np.int64)
                kind = np.repeat(kinds[a:z], block.n_words)[order]
                which = np.repeat(np.arange(len(first)), np.diff(first, append=len(h)))
                own = np.bincount(which * n_classes + kind, minlength=len(first) * n_classes).reshape(-1, n_classes).T
                tokens = _spelled_out(block, order[first])
                yield pa.RecordBatch.from_arrays([pa.array(h[order[first]].view(np.int64)), tokens, *map(pa.array, own)], names=names)
                ends = np.bincount(kinds[a:z], minlength=n_classes)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([END]), *(pa.array(ends[k : k + 1].astype(np.int64)) for k in range(n_classes))], names=names)

    classes = [f"c{k}" for k in range(n_classes)]
    names = ["h", "token", *classes]
    partial = map_arrow(docs.select("text", "class"), run, "h long, token string, " + ", ".join(f"{c} long" for c in classes))
    summed = partial.groupBy("h", "token").agg(*(F.sum(c).alias(c) for c in classes))
    return summed.select("h", "token", sum((F.col(c) for c in classes), F.lit(0)).cast("long").alias("c"), *classes)


def _spelled_out(block: W.Block, words: np.ndarray) -> pa.Array:
    starts, sizes = block.starts[words], block.ends[words] - block.starts[words]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(gather(block.folded, starts, sizes))))


# --- spelling of tokens never seen -------------------------------------------------------------------------------------------


def _byte_nodes() -> np.ndarray:
    """Numbers of the decisions of a byte, by its bits before with a 1 in front, in groups of three levels."""
    prefix = np.arange(1, 256)
    depth = np.frexp(prefix)[1] - 1
    above = prefix >> (depth % 3)  # the group's first decision
    return np.append(0, above * 8 + (prefix - (above << (depth % 3)) + (1 << (depth % 3))))


_NODES = _byte_nodes()
_SPREAD, _LOCAL = _spread(_NODES), _NODES & 7


class _Spelling:
    """The bytes of words end to end, each with a space after it, and the contexts of every byte."""

    def __init__(self, words: list[bytes], kinds: np.ndarray):
        spelled = [w + b" " for w in words]
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        sizes = np.array([len(w) for w in spelled], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(self.data))
        depth = at - self.bounds[:-1][word]
        kind = (kinds[word].astype(np.uint64) + np.uint64(1)) * _M[3]
        last = np.zeros(len(at), np.uint64)
        self.contexts = []
        with np.errstate(over="ignore"):
            for k in range(1, 5):
                back = np.zeros(len(at), np.uint64)
                seen = depth >= k
                back[seen] = self.data[at[seen] - k]
                last = last * np.uint64(257) + back + np.uint64(1)
                self.contexts.append(_high(W.mix((last + np.uint64(k)) ^ kind)))

    def events(self, bit: int):
        prefix = (self.data >> np.uint8(8 - bit)) + (1 << bit) if bit else np.ones(len(self.data), np.uint8)
        spread, local = _take(_SPREAD, prefix), _take(_LOCAL, prefix)
        slots = [((c + spread) >> np.uint32(32 - SPELL_BITS)) ^ local for c in self.contexts]
        return ((self.data >> np.uint8(7 - bit)) & np.uint8(1)).astype(np.int64), slots


def _word_pieces(words: list[bytes], limit: int = 1 << 17):
    first, size = 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(words):
        yield first, len(words)


def spell(frozen, mixer: Mixer, words: list[bytes], kinds: np.ndarray) -> np.ndarray:
    """log2 of each word's probability in its class, in fixed point (EVENT)."""
    table, out = mixer.table(), np.zeros(len(words), np.int64)
    for a, z in _word_pieces(words):
        spelled = _Spelling(words[a:z], kinds[a:z])
        total = np.zeros(len(spelled.data), np.int64)
        for bit in range(8):
            ones, slots = spelled.events(bit)
            cells = [_unpacked(_take(own, s)) for own, s in zip(frozen, slots, strict=True)]
            x = [logit * np.float32(1 / _INPUT) for logit, _ in cells]
            gate = cells[2][1].astype(np.int64) * 4 + cells[3][1]
            total += np.rint(mixer.log2(table, x, gate, ones) * EVENT).astype(np.int64)
        out[a:z] = np.add.reduceat(total, spelled.bounds[:-1])
    return out


def fit_spelling(rare: DataFrame, n_classes: int):
    """Bit counts of the distinct tokens of `rare` (token, c0 ...), once for each class that holds them, and learned weights."""
    classes, total = [f"c{k}" for k in range(n_classes)], 4 * (2 << SPELL_BITS)

    def spelled_rows(batch):
        held = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() > 0 for c in classes], 1)
        row, kind = np.nonzero(held)
        words = [w.encode() for w in batch.column(batch.schema.get_field_index("token")).to_pylist()]
        return [words[i] for i in row.tolist()], kind

    def count(batches):
        counts = np.zeros(total, np.int64)
        for batch in batches:
            words, kinds = spelled_rows(batch)
            for a, z in _word_pieces(words, 1 << 18):
                spelled = _Spelling(words[a:z], kinds[a:z])
                met = [*map(spelled.events, range(8))]
                for k in range(4):
                    part = counts[k * (2 << SPELL_BITS) : (k + 1) * (2 << SPELL_BITS)]
                    _tally(part, np.concatenate([(slots[k] * 2 + ones).astype(np.int32) for ones, slots in met]))
        yield from _sparse(counts)

    counts = _summed(map_arrow(rare, count, "block int, counts binary"), total)
    raw = rare.sparkSession.sparkContext.broadcast(_left_out(counts, 4))

    def events(batch):
        words, kinds = spelled_rows(batch)
        for a, z in _word_pieces(words, _PIECE):
            spelled = _Spelling(words[a:z], kinds[a:z])
            for bit in range(8):
                ones, slots = spelled.events(bit)
                cells = [_unpacked(_take(own, s * 2 + ones)) for own, s in zip(raw.value, slots, strict=True)]
                yield [x for x, _ in cells], cells[2][1] * 4 + cells[3][1], ones

    mixer = _learned(rare, ["h", "token"], 4, events)
    raw.destroy()
    return _frozen(counts, 4), mixer


# --- the sequence model ------------------------------------------------------------------------------------------------------


def fit_mixing(trained: DataFrame, often, sizes: dict, docs_of: list[int]) -> MixingModel:
    """trained: doc_id, text, class (a number) of training texts. often: the frequent tokens with c and c0 ... sizes: of all training tokens."""
    classes = [f"c{k}" for k in range(len(docs_of))]
    own = often[classes].to_numpy(np.int64) if len(often) else np.zeros((0, len(classes)), np.int64)
    order = np.lexsort((often["token"].to_numpy(), -own.sum(1), own.argmax(1))) if len(often) else np.zeros(0, np.int64)
    own, words = own[order], [w.encode() for w in often["token"].to_numpy()[order]]
    ends = np.array(docs_of, np.int64)
    by_class = np.array([sizes[c] or 0 for c in classes], np.int64)
    counts = np.concatenate([ends[None], (by_class - ends - own.sum(0))[None], own])
    # In a text left out a token is met once less often: those of the least count then escape. Symbols are discounted by that.
    least = max(LEAST, -(-int(by_class.sum()) // SHARE))
    off = min(0.9, least * (own.sum(1) == least).sum() / max(len(own), 1))
    taken = off * own / np.maximum(own.sum(1, keepdims=True), 1)
    held = counts + np.concatenate([np.zeros((1, len(ends))), taken.sum(0)[None], -taken])
    weight = held.sum(1) + (np.arange(len(counts)) < 2)
    lookup = Table(max(8, (2 * len(words)).bit_length() + 1))
    if words:
        line = b" ".join(words)
        lookup.add(W.Block(np.frombuffer(line, np.uint8), np.array([0, len(line)])).hashes(), np.arange(2, 2 + len(words), dtype=np.int32))
    n_train, distinct = int(by_class.sum()), sizes["v"] or 0
    base = np.rint(np.log10((counts.sum(1) + 0.5) / (n_train + 0.5 * (distinct + 1))) * FIXED).astype(np.int64)
    p = weight / weight.sum()
    evidence = np.log2((held + 50 * p[:, None]) / (by_class + 50) / p[:, None])
    prior = np.log2((ends + 0.5) / (ends.sum() + 0.5 * len(ends)))
    model = MixingModel(
        lookup, Paths(weight, held), np.rint(evidence * 256).astype(np.int32), np.rint(prior * 256).astype(np.int64),
        min(TABLE_BITS, max(14, (2 * n_train).bit_length())), {"c": counts.sum(1), "base": base},
    )
    spark = trained.sparkSession.sparkContext
    left_out = model.paths.left_out()
    bare, size = spark.broadcast(model), 4 << model.bits

    def count(batches):
        own, counts, held, n = bare.value, np.zeros(size, np.int32), ([], []), 0

        def flush():
            for k, parts in enumerate(held):
                if parts:
                    _tally(counts[k * size // 2 : (k + 1) * size // 2], np.concatenate(parts))
                    parts.clear()

        for batch in batches:
            for _, _, seq in _sequences(own, batch.column(0)):
                for low in range(0, len(seq.symbol), _PIECE // 8):
                    _, code, slots = seq.events(own, low, low + _PIECE // 8)
                    bit = code & 1
                    for k, s in enumerate(slots):
                        held[k].append((s * 2 + bit).astype(np.int32))
                    n += len(code)
                    if n >= _HELD:
                        flush()
                        n = 0
        flush()
        yield from _sparse(counts)

    counted = _summed(map_arrow(trained.select("text"), count, "block int, counts binary"), size)
    raw = spark.broadcast((*left_out, *_left_out(counted, 2)))

    def events(batch):
        own, kinds = bare.value, batch.column(batch.schema.get_field_index("class")).to_numpy()
        logit, class_logit, *tables = raw.value
        for a, z, seq in _sequences(own, batch.column(batch.schema.get_field_index("text"))):
            true = np.repeat(kinds[a:z], np.diff(seq.bounds))
            of_class = (seq.kind * 2 + (seq.kind == true)) * len(logit)
            for low in range(0, len(seq.symbol), _PIECE // 8):
                n, code, slots = seq.events(own, low, low + _PIECE // 8)
                bit = code & 1
                cells = [_unpacked(_take(t, s * 2 + bit)) for t, s in zip(tables, slots, strict=True)]
                x = [_take(logit, code), _take(class_logit, np.repeat(of_class[low : low + _PIECE // 8], n) + code)]
                yield [*x, *(v for v, _ in cells)], cells[0][1] * 4 + cells[1][1], bit

    model.mixer = _learned(trained, ["doc_id"], 4, events)
    model.frozen = _frozen(counted, 2)
    raw.destroy()
    bare.destroy()
    return model


def price(model: MixingModel, seq: _Sequence) -> np.ndarray:
    """log2 of each token's probability in fixed point (EVENT); of the escape, where a token is no symbol."""
    table, out = model.mixer.table(), np.zeros(len(seq.symbol), np.int64)
    of_class, own = seq.kind * len(model.paths.logit), model.paths.class_logit.reshape(-1)
    for low in range(0, len(seq.symbol), _PIECE // 8):
        n, code, slots = seq.events(model, low, low + _PIECE // 8)
        node, bit = code >> 1, code & 1
        cells = [_unpacked(_take(t, s)) for t, s in zip(model.frozen, slots, strict=True)]
        x = [_take(model.paths.logit, node), _take(own, np.repeat(of_class[low : low + _PIECE // 8], n) + node), *(v * np.float32(1 / _INPUT) for v, _ in cells)]
        gate = cells[0][1].astype(np.int64) * 4 + cells[1][1]
        fixed = np.rint(model.mixer.log2(table, x, gate, bit) * EVENT).astype(np.int64)
        out[low : low + _PIECE // 8] = np.add.reduceat(fixed, np.cumsum(n) - n)
    return out


def score_texts(docs: DataFrame, trains, class_column: str = "lang") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; a row for each row of docs.

    trains: a column that says whether a row may be learned from.
    """
    kind = F.coalesce(F.col(class_column).cast("string"), F.lit("")) if class_column in docs.columns else F.lit("")
    trained = docs.where(F.coalesce(trains, F.lit(False))).select("doc_id", "text", kind.alias("kind"))
    kinds = trained.groupBy("kind").count()
    rows = kinds.orderBy(F.desc("count"), "kind").limit(CLASSES - 1).collect()
    n_kinds, n_docs = kinds.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    if n_kinds > len(rows):
        warnings.warn(f"{n_kinds - len(rows)} of {n_kinds} classes of text share one", stacklevel=2)
    docs_of = [r["count"] for r in rows]
    if n_kinds > len(rows) or not rows:
        docs_of.append(n_docs - sum(docs_of))
    number = F.lit(len(docs_of) - 1)
    for k, row in enumerate(rows):
        number = F.when(F.col("kind") == row["kind"], F.lit(k)).otherwise(number)
    classes = [f"c{k}" for k in range(len(docs_of))]
    trained = trained.select("doc_id", "text", number.cast("int").alias("class"))
    vocabulary = materialize(count_tokens(trained.select("text", "class"), len(docs_of)), "vocabulary")
    sizes = vocabulary.agg(F.sum("c").alias("c"), F.count("*").alias("v"), *(F.sum(c).alias(c) for c in classes)).first().asDict()
    n_train, distinct = sizes["c"] or 0, sizes["v"] or 0
    frequent = (F.col("c") * SHARE >= n_train) & (F.col("c") >= LEAST) & (F.col("token") != END)
    often = vocabulary.where(frequent).toPandas()  # SHARE rows at most
    rare = vocabulary.where(~frequent & (F.col("token") != END))
    model = fit_mixing(trained, often, sizes, docs_of)
    once = rare.agg(F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("once"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes)).first()
    spelling, speller = fit_spelling(rare, len(docs_of))
    least = max(LEAST, -(-n_train // SHARE))
    edge = least * int((often["c"] == least).sum()) if len(often) else 0
    unseen = min((once["once"] + 0.5) / (once["c"] + edge + 1), 0.999) if once["c"] else 1.0
    spark = docs.sparkSession.sparkContext
    shared, letters = spark.broadcast(model), spark.broadcast((spelling, speller))

    def look(batches):
        from pyspark import TaskContext

        own = shared.value
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, sizes_ = utf8(batch.column(1))
            for a, z, seq in _sequences(own, batch.column(1)):
                block, bounds = seq.block, seq.bounds
                per = lambda values: (lambda run: run[bounds[1:]] - run[bounds[:-1]])(np.concatenate([[0], np.cumsum(values)]))  # noqa: E731, B023
                escaped = seq.symbol == ESCAPE
                known, base = np.where(escaped, 0, own.symbols["c"][seq.symbol] > 0), np.where(escaped, 0, own.symbols["base"][seq.symbol])
                lone = np.flatnonzero(escaped[seq.at])
                texts = block.text_of_word()[lone]
                kinds_ = seq.kind[seq.at[lone]]
                with np.errstate(over="ignore"):
                    key = W.mix(seq.hashes[lone] + texts.astype(np.uint64) * _M[0] + kinds_.astype(np.uint64) * _M[1])
                order = np.argsort(key)
                ranked = key[order]
                new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), ranked[1:] != ranked[:-1]]))
                first, times = order[new], np.diff(new, append=len(key))
                order = np.argsort(texts[first], kind="stable")
                first, times = first[order], times[order]
                ends = pa.array(np.searchsorted(texts[first], np.arange(z - a + 1)).astype(np.int32))
                lone = lone[first]
                fields = [pa.array(seq.hashes[lone].view(np.int64)), _spelled_out(block, lone), pa.array(times.astype(np.int32)), pa.array(kinds_[first].astype(np.int32))]
                rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["h", "token", "times", "kind"]))
                columns = [
                    batch.column(0).slice(a, z - a), pa.array(np.full(z - a, part, np.int32)), pa.array(np.arange(at, at + z - a)), pa.array(np.diff(sizes_[a : z + 1])),
                    pa.array(block.n_words.astype(np.int64) + 1), *(pa.array(per(v)) for v in (known, base, price(own, seq))), rest,
                ]
                at += z - a
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "row", "bytes", "n_tokens", "known", "base", "bits", "rest"])

    schema = "doc_id long, part int, row long, bytes long, n_tokens long, known long, base long, bits long, rest array<struct<h:long,token:string,times:int,kind:int>>"
    stats = materialize(map_arrow(docs.select("doc_id", "text"), look, schema), "text-stats")
    each = stats.select("part", "row", F.inline("rest"))
    joined = each.join(rare, ["h", "token"], "left")
    fixed = lambda x: F.round(x * F.lit(float(FIXED))).cast("long")
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 0.5) / F.lit(n_train + 0.5 * (distinct + 1)))
    own = F.get(F.array(*[F.col(k) for k in classes]), F.col("kind")) + F.col("c") * F.lit(200.0 / max(once["c"], 1))
    held = F.get(F.array(*[F.lit(float(once[k] + 200)) for k in classes]), F.col("kind"))
    seen = F.log10(own * F.lit(1 - unseen) / held)
    added = joined.groupBy("part", "row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("k"), F.sum(fixed(base) * F.col("times")).alias("b"), F.sum(fixed(seen) * F.col("times")).alias("s"),
        F.collect_list(F.when(F.col("c").isNull(), F.struct("token", "kind", "times"))).alias("new"),
    )
    both = stats.drop("rest").join(added, ["part", "row"], "left")

    def finish(batch):
        new = batch.column(batch.schema.get_field_index("new"))
        n = pa.compute.fill_null(pa.compute.list_value_length(new), 0).to_numpy(zero_copy_only=False)
        flat = new.flatten()
        words = [w.encode() for w in flat.field("token").to_pylist()]
        bits = spell(*letters.value, words, flat.field("kind").to_numpy(zero_copy_only=False).astype(np.int64)) if words else np.zeros(0, np.int64)
        times = flat.field("times").to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.concatenate([[0], np.cumsum(bits * times)])
        many = np.concatenate([[0], np.cumsum(times)])
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        return [pa.array(run[ends[1:]] - run[ends[:-1]]), pa.array(many[ends[1:]] - many[ends[:-1]])]

    both = annotate(both, finish, "new_bits long, n_new long").drop("new")
    one, two = F.lit(float(FIXED)), F.lit(math.log10(2) / EVENT)
    score = (F.col("bits") + F.col("new_bits")) * two + F.coalesce("s", F.lit(0)) / one + F.col("n_new") * F.lit(math.log10(unseen))
    return both.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        ((F.col("base") + F.coalesce("b", F.lit(0))) / one).alias("base_score"), score.alias("score"), (-score / F.lit(math.log10(2)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
