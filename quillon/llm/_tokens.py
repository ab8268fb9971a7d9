"""Batch encoding with the tokenizers library, a distinct chunk at a time.

Both tokenizers cut a text into pre-tokens first and merge only inside them. Here the cuts that are certain from ASCII bytes
alone are made with numpy (between white space and words, and between letters, digits and signs of words that are wholly
ASCII and hold no apostrophe); each distinct chunk between such cuts goes to the library once and is then found again by
its 64-bit hash. Texts in which white space runs or non-ASCII white space could matter go to the library whole.
The table of known chunks is bounded and starts anew when full.

Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import numpy as np

from . import _words as W

_CLASS = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other ASCII, 4 non-ASCII, 5 apostrophe
_CLASS[:128] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[39] = 5


class Table:
    """Open addressing from 64-bit hashes to positions, all in numpy."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.arange(len(h))
        while len(at):
            value = self.values[slot]
            hit = (self.keys[slot] == h[at]) & (value >= 0)
            out[at[hit]] = value[hit]
            on = ~hit & (value >= 0)
            at, slot = at[on], (slot[on] + 1) & mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """h: distinct and not held yet."""
        self.used += len(h)
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.values[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = h[won], values[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, values, slot = h[rest], values[rest], (slot[rest] + 1) & mask


class Ragged:
    """Known chunks: a hash table and the ids of each, end to end. Starts anew beyond `limit` chunks."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.table = Table(self.limit.bit_length() + 1)
        self.ids = np.zeros(1 << 20, np.int32)
        self.end = np.zeros(self.limit + 1, np.int64)
        self.n = 0

    def lookup(self, h: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """For each hash: where its ids begin and how many they are. encode(positions) gives the ids of new chunks."""
        found = self.table.find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, first = np.unique(h[missing], return_index=True)
            if self.n + len(fresh) > self.limit:
                self.clear()
                self.limit = max(self.limit, len(fresh))
                self.clear()
                return self._refill(h, encode)
            self._insert(fresh, encode(missing[first]))
            found[missing] = self.table.find(h[missing])
        return self.start(found), self.end[found + 1] - self.start(found)

    def _refill(self, h, encode):
        fresh, first = np.unique(h, return_index=True)
        if len(fresh) > self.limit:
            self.limit = len(fresh)
            self.clear()
        self._insert(fresh, encode(first))
        found = self.table.find(h)
        return self.start(found), self.end[found + 1] - self.start(found)

    def start(self, found: np.ndarray) -> np.ndarray:
        return self.end[found]

    def _insert(self, fresh: np.ndarray, coded: tuple[np.ndarray, np.ndarray]) -> None:
        flat, sizes = coded
        used, n = int(self.end[self.n]), len(fresh)
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)])
        self.ids[used : used + len(flat)] = flat
        self.end[self.n + 1 : self.n + n + 1] = used + np.cumsum(sizes)
        self.table.add(fresh, np.arange(self.n, self.n + n, dtype=np.int32))
        self.n += n


def gather(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start:start+size] of each, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(start - (ends - sizes), sizes)
    at += np.arange(total)
    return flat.take(at, mode="clip")  # all exist: what is not checked takes half the time


class Encoder:
    """kind "word" drops white space and folds case; kind "byte" keeps a space with the word after it."""

    def __init__(self, path: str, kind: str, limit: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind, self.known = kind, Ragged(limit)

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        of = np.array(coded.word_ids, np.int64)
        return np.array(coded.ids, np.int32), np.bincount(of, minlength=len(chunks))

    def _cuts(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start and end."""
        data, n = block.data, len(block.data)
        kind = _CLASS[data]
        odd = np.zeros(n + 1, np.int64)
        np.cumsum(kind >= 4, out=odd[1:])
        plain_word = odd[block.ends] == odd[block.starts]
        plain = np.zeros(n, bool)
        plain_at = np.repeat(plain_word, block.ends - block.starts)
        plain[~block.space] = plain_at
        cut = np.zeros(n + 1, bool)
        cut[block.offsets] = True
        change = kind[1:] != kind[:-1]
        if self.kind == "word":
            change |= (kind[1:] == 2) & (kind[:-1] == 2)
            cut[1:n] |= change & plain[1:] & plain[:-1]
            cut[block.starts] = True
            starts = np.flatnonzero(cut[:n] & ~block.space)
            stop = cut.copy()
            stop[block.ends] = True
            ends_all = np.flatnonzero(stop)
            return starts, ends_all[np.searchsorted(ends_all, starts, "right")]
        cut[1:n] |= change & plain[1:] & plain[:-1]
        cut[:n] |= block.space
        cut[1:n] |= block.space[:-1] & (data[:-1] != 32)
        starts = np.flatnonzero(cut[:n])
        return starts, np.append(starts[1:], n)

    def _odd_texts(self, block: W.Block) -> np.ndarray:
        """Texts whose white space needs the whole pattern."""
        if self.kind == "word":
            return np.zeros(len(block.n_words), bool)
        d, s = block.data, block.space
        flag = np.zeros(len(d), bool)
        flag[1:] = s[1:] & s[:-1]
        if len(d) > 2:
            a, b, c = d[:-2], d[1:-1], d[2:]
            wide = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
            wide |= (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
            flag[:-2] |= wide
            flag[-2] |= d[-2] == 0xC2
        return block.per_text(flag) > 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        block = W.Block(data, offsets, lower=self.kind == "word")
        n = len(block.n_words)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        starts, ends = self._cuts(block)
        raw = (block.folded if self.kind == "word" else data).tobytes()

        def new(at):
            return self._library([raw[starts[k] : ends[k]].decode() for k in at])

        begin, sizes = self.known.lookup(block.slices(starts, ends), new)
        flat = gather(self.known.ids, begin, sizes)
        run = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes, out=run[1:])
        bounds = run[np.searchsorted(starts, offsets)]
        counts = np.diff(bounds)
        odd = self._odd_texts(block)
        if odd.any():
            parts = []
            for k in range(n):
                part = flat[bounds[k] : bounds[k + 1]]
                if odd[k]:
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    part = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                    counts[k] = len(part)
                parts.append(part)
            flat = np.concatenate(parts)
        return flat, counts


_held: dict = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process; its table of chunks outlives tasks."""
    if (path, kind) not in _held:
        _held[path, kind] = Encoder(path, kind)
    return _held[path, kind]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
