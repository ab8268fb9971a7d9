"""SentencePiece BPE encoding and decoding: exact, by backtracking over longest matches.

An encoding by merges is the one sequence of pieces in which every neighbouring pair is stable: merging the pair's text anew
gives the pair back. So, from the left, the longest piece that matches is taken; if it isn't stable beside the piece before
it, shorter ones are tried; if none is, the piece before is given up and its end is marked in a bitfield of positions that
lead nowhere. An Aho-Corasick automaton over the reversed pieces finds all pieces that start at each position in one pass.
Pieces that merging never yields are not candidates. Characters outside the vocabulary become their byte pieces.

A text is cut beforehand wherever no piece holds the two bytes beside the cut next to each other: no merge can cross it.
Distinct chunks are encoded once and found again by their 64-bit hash, in a bounded table.

Edge cases: a null or empty text has no ids; U+2581 in a text is the same as a space, as in the library; a lone part of a
character never occurs, as texts are valid UTF-8; other columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _tokens as T
from . import _words as W
from ._shared import blocks, map_arrow, utf8

MARK = "▁"
_STOP = "￿"  # between chunks in the automaton's input; no piece holds it


class PieceBpe:
    """An encoder for the model file at path."""

    def __init__(self, path: str, limit: int = 1 << 20):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("this encoder takes models with identity normalisation, a dummy prefix and byte pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        normal = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type == proto.ModelProto.SentencePiece.NORMAL}
        self.rank = {piece: -score for piece, (_, score) in normal.items()}
        self.ids = {piece: k for piece, (k, _) in normal.items()}
        self.stable: dict[tuple[str, str], bool] = {}
        yielded = [p for p in normal if len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for piece in yielded:
            self.automaton.add_word(piece[::-1], piece)
        self.automaton.make_automaton()
        joins = np.zeros((256, 256), bool)
        joins[:, 0x80:0xC0] = True
        for piece in normal:
            raw = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
            joins[raw[:-1], raw[1:]] = True
        self.joins = joins
        self.known = T.Ragged(limit)

    def merge(self, text: str) -> list[str]:
        """The pieces that merging yields: best score first, then leftmost. Used to judge pairs and pieces."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.rank

        def offer(i, j):
            if i >= 0 and j >= 0 and (r := rank.get(joined := parts[i] + parts[j])) is not None:
                heappush(queue, (r, i, joined))

        queue = [(r, i, x) for i in range(n - 1) if (r := rank.get(x := parts[i] + parts[i + 1])) is not None]
        heapify(queue)
        while queue:
            _, i, joined = heappop(queue)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        found = self.stable.get((left, right))
        if found is None:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            found = self.stable[left, right] = self.merge(left + right) == [left, right]
        return found

    def backtrack(self, text: str, starts: list[list[str]]) -> list[str]:
        """starts: for each position, the pieces that begin there, longest first; a lone unknown character stands for itself."""
        n, at, out, tried = len(text), 0, [], []
        if n and starts[0] and len(starts[0][0]) == n:
            return [starts[0][0]]
        dead = 0  # bitfield of positions from which no stable sequence goes on
        k = 0
        while at < n:
            options = starts[at] or [text[at]]
            while k < len(options):
                piece = options[k]
                end = at + len(piece)
                if not dead >> end & 1 and (not out or self.fits(out[-1], piece)):
                    break
                k += 1
            if k < len(options):
                out.append(piece)
                tried.append(k)
                at, k = end, 0
            elif not out:
                raise ValueError("no stable sequence")
            else:
                dead |= 1 << at
                at -= len(out.pop())
                k = tried.pop() + 1
        return out

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (spaces as U+2581) end to end, and how many each has."""
        whole = _STOP.join(chunks)
        total = len(whole)
        starts: list[list[str]] = [[] for _ in range(total)]
        for end, piece in self.automaton.iter(whole[::-1]):
            starts[total - 1 - end].append(piece)
        flat, sizes, at = [], [], 0
        ids = self.ids
        for chunk in chunks:
            n = len(chunk)
            before = len(flat)
            own = starts[at : at + n]
            for options in own:
                if len(options) > 1:
                    options.sort(key=len, reverse=True)
            for piece in self.backtrack(chunk, own):
                k = ids.get(piece)
                if k is not None:
                    flat.append(k)
                else:
                    flat.extend(self.byte_ids[list(piece.encode())].tolist())
            sizes.append(len(flat) - before)
            at += n + 1
        return np.array(flat, np.int32), np.array(sizes, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        n = len(offsets) - 1
        if (data == 0xE2).any() and MARK.encode() in (raw := data.tobytes()):
            texts = [raw[a:z].replace(MARK.encode(), b" ") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        full = np.diff(offsets) > 0  # each text that isn't empty gets one space before it
        lead = np.concatenate([[0], np.cumsum(full)])
        led = np.full(len(data) + int(lead[-1]), 32, np.uint8)
        text_of = np.repeat(np.arange(n), np.diff(offsets))
        led[np.arange(len(data)) + lead[text_of + 1]] = data
        offsets = offsets + lead
        if not len(led):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        cut = np.zeros(len(led), bool)
        cut[offsets[:-1][full]] = True
        cut[1:] |= ~self.joins[led[:-1], led[1:]]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(led))
        block = W.Block(led, offsets)
        raw = led.tobytes()

        def new(at):
            return self.encode_chunks([raw[starts[k] : ends[k]].decode().replace(" ", MARK) for k in at])

        begin, sizes = self.known.lookup(block.slices(starts, ends), new)
        run = np.concatenate([[0], np.cumsum(sizes)])
        return T.gather(self.known.ids, begin, sizes), np.diff(run[np.searchsorted(starts, offsets)])


_held: dict[str, PieceBpe] = {}


def encoder(path: str) -> PieceBpe:
    if path not in _held:
        _held[path] = PieceBpe(path)
    return _held[path]


def code_texts(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """For each row: doc_id, ids array<int> and decoded text; with digest, n_tokens and the digests of both instead."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, z in blocks(offsets, W.BLOCK // 2):
                flat, n = coder.encode(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
                lists = flat.tolist()
                each = [lists[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                texts = [coder.library.decode(ids) for ids in each]
                ids = batch.column(0).slice(a, z - a)
                if digest:
                    spelled = [hashlib.sha256(str(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in each]
                    decoded = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                    out = [ids, pa.array(n), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists_column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([ids, lists_column, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)
