"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Of all ways to cut a text into pieces, the one with the highest sum of scores is taken; among equals, each piece begins
as early as can be. A space is the marker U+2581 in pieces, and a text gets one in front. A character with no piece of
its own costs UNKNOWN less than the lowest score and falls back to one piece a byte. A literal U+2581 in a text falls
back to bytes too, so decode(encode(text)) is the text, always.

No piece crosses from a character to a following marker (checked when a model is read), so the best cut of a text is
that of its space-led units, one by one. Units repeat, so each is cut once (UnitCache); thousands of new units go
through the trie and the Viterbi steps together, as numpy arrays.

Edge cases: null and empty texts have no pieces and decode to an empty text; null ids and repeated rows pass through;
an empty table gives an empty result; other columns are not read. Texts of any length are encoded whole, in slices of
rows of a few MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textnum import UnitCache, flat, pieces, ragged

MARKER = "▁"
#: What an unknown character costs below the lowest score.
UNKNOWN = 10.0
#: Scores at or below this mark pieces that are never to be chosen; they don't lower the score of unknown characters.
NEVER = -1e8
#: States that the trie's builder looks at together for a free place.
SPAN = 1024


@dataclass
class Trie:
    """A double array over bytes: child c of state s is base[s] + c + 1 if check of that is s. value: a key's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> Trie:
        ordered = sorted(keys)
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        todo, low = [(0, 0, len(ordered), 0)], 1
        while todo:
            state, i, j, depth = todo.pop()
            if i < j and len(ordered[i]) == depth:
                value[state] = keys[ordered[i]]
                i += 1
            groups, k = [], i
            while k < j:
                c, e = ordered[k][depth], k
                while e < j and ordered[e][depth] == c:
                    e += 1
                groups.append((c, k, e))
                k = e
            if not groups:
                continue
            wanted = np.array([c for c, _, _ in groups]) + 1
            at = -1
            while at < 0:
                if low + 2 * SPAN >= size:
                    base, check, value = np.resize(base, 2 * size), np.resize(check, 2 * size), np.resize(value, 2 * size)
                    check[size:], value[size:], size = -1, -1, 2 * size
                free = np.flatnonzero(check[low : low + SPAN] < 0) + low
                if not len(free):
                    low += SPAN
                    continue
                low = max(low, int(free[0]))
                free = free[free >= wanted[0]] - wanted[0]
                free = free[(check[free[:, None] + wanted] < 0).all(1)]
                if len(free):
                    at = int(free[0])
                else:
                    low += SPAN // 4
            base[state] = at
            check[at + wanted] = state
            todo += [(at + c + 1, b, e, depth + 1) for c, b, e in groups]
        return cls(base, check, value)

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every key in data that begins at one of starts and ends by its end: (start, end, id)."""
        out, at, state = [], starts, np.zeros(len(starts), np.int64)
        while len(at):
            ok = at < ends
            starts, ends, at, state = starts[ok], ends[ok], at[ok], state[ok]
            child = self.base[state] + data[at].astype(np.int64) + 1
            ok = (child < len(self.check)) & (self.check[np.minimum(child, len(self.check) - 1)] == state)
            starts, ends, at, state = starts[ok], ends[ok], at[ok] + 1, child[ok]
            hit = self.value[state] >= 0
            out.append((starts[hit], at[hit], self.value[state[hit]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


@dataclass
class PieceModel:
    trie: Trie
    scores: np.ndarray
    unknown: float
    byte_ids: np.ndarray  # id of each byte's piece
    out_bytes: np.ndarray  # what ids decode to, one after another
    out_starts: np.ndarray
    out_sizes: np.ndarray

    @classmethod
    def of(cls, names: list[str], scores: list[float], kinds: list[str]) -> PieceModel:
        """kinds: normal, byte or control. Byte pieces are named <0x00> to <0xFF>; a model needs all 256."""
        keys, outs, byte_ids = {}, [b""] * len(names), np.full(256, -1, np.int64)
        for i, (name, kind) in enumerate(zip(names, kinds)):
            if kind == "byte":
                byte_ids[int(name[3:5], 16)] = i
                outs[i] = bytes([int(name[3:5], 16)])
            elif kind == "normal":
                if MARKER in name.lstrip(MARKER) or " " in name:
                    raise ValueError(f"a marker inside the piece {name!r}: units can't be cut one by one")
                outs[i] = name.replace(MARKER, " ").encode()
                keys[outs[i]] = i
        if (byte_ids < 0).any():
            raise ValueError("no byte fallback: a byte has no piece")
        sizes = np.array([len(x) for x in outs], np.int64)
        real = [s for s, k in zip(scores, kinds) if k == "normal" and s > NEVER]
        return cls(Trie.build(keys), np.array(scores, np.float64), min(real, default=0.0) - UNKNOWN, byte_ids, np.frombuffer(b"".join(outs), np.uint8), np.cumsum(sizes) - sizes, sizes)

    @classmethod
    def read(cls, path: str) -> PieceModel:
        """Pieces and scores of a SentencePiece model file."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls.of([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], [kind(i) for i in n])

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and how many each has. Units are cut as they are, with no marker added."""
        data, bounds = flat(pa.array(units, pa.large_string()))
        n, size = len(units), np.diff(bounds)
        unit = np.repeat(np.arange(n), size)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        char_end = np.append(chars[1:], len(data))
        start, end, piece = self.trie.matches(data, chars, bounds[1:][unit[chars]])
        alone = np.zeros(len(data) + 1, bool)  # characters with a piece of their own
        width = np.zeros(len(data) + 1, np.int64)
        width[chars] = char_end - chars
        alone[start[end - start == width[start]]] = True
        lost = ~alone[chars]
        start, end = np.concatenate([start, chars[lost]]), np.concatenate([end, char_end[lost]])
        score = np.concatenate([self.scores[piece], np.full(lost.sum(), self.unknown)])
        piece = np.concatenate([piece, np.full(lost.sum(), -1)])
        of = unit[start]
        # node p of unit u is p + u: an end of one unit and the start of the next are two nodes
        local = end - bounds[of]
        order = np.lexsort((start, of, local))
        start, end, piece, score, of, local = (x[order] for x in (start, end, piece, score, of, local))
        best, back = np.full(len(data) + n + 1, -np.inf), np.full(len(data) + n + 1, -1, np.int64)
        best[bounds[:-1] + np.arange(n)] = 0.0
        steps = np.append(np.flatnonzero(np.append(True, local[1:] != local[:-1])), len(local)) if len(local) else np.zeros(1, int)
        for i, j in zip(steps[:-1], steps[1:]):
            total = best[start[i:j] + of[i:j]] + score[i:j]
            first = np.flatnonzero(np.append(True, of[i + 1 : j] != of[i : j - 1]))
            top = np.maximum.reduceat(total, first)
            hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(first, j - i))))
            owner = of[i + hit]
            hit = hit[np.append(True, owner[1:] != owner[:-1])]
            node = end[i + hit] + of[i + hit]
            best[node], back[node] = total[hit], i + hit
        node, units_at, taken, owners, depth = bounds[1:] + np.arange(n), np.arange(n), [], [], []
        live = size > 0
        node, units_at, k = node[live], units_at[live], 0
        while len(node):
            m = back[node]
            taken.append(m)
            owners.append(units_at)
            depth.append(np.full(len(m), -k))
            go = start[m] > bounds[units_at]
            node, units_at, k = (start[m] + units_at)[go], units_at[go], k + 1
        if not taken:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        taken, owners, depth = np.concatenate(taken), np.concatenate(owners), np.concatenate(depth)
        order = np.lexsort((depth, owners))
        taken, owners = taken[order], owners[order]
        got, lost = piece[taken], piece[taken] < 0
        lengths = np.where(lost, end[taken] - start[taken], 1)
        ids = np.repeat(got, lengths)
        raw = data[ragged(start[taken], lengths)]
        ids = np.where(np.repeat(lost, lengths), self.byte_ids[raw], ids)
        return ids.astype(np.int32), np.bincount(owners, lengths, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts from their ids, one after another, and the n + 1 bounds; the first marker is dropped."""
        sizes = self.out_sizes[ids]
        data = self.out_bytes[ragged(self.out_starts[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        some = bounds[:-1] < bounds[1:]
        firsts = bounds[:-1][some]
        firsts = firsts[data[firsts] == 0x20]
        drop = np.zeros(len(data) + 1, np.int64)
        drop[firsts + 1] = 1
        keep = np.ones(len(data), bool)
        keep[firsts] = False
        return data[keep], bounds - np.cumsum(drop)[bounds]


def with_marker(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space in front of every text that isn't empty."""
    some = np.diff(bounds) > 0
    before = np.concatenate([[0], np.cumsum(some)])
    out = np.full(len(data) + int(before[-1]), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(before[1:], np.diff(bounds))] = data
    return out, bounds + before


def encode(docs: DataFrame, model: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes (pieces from byte fallback), round_trip (the ids decode to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = UnitCache(model.encode_units)
        is_byte = np.zeros(len(model.scores), bool)
        is_byte[model.byte_ids] = True
        for batch in batches:
            for part in pieces(batch, "text"):
                data, bounds = flat(part.column("text"))
                ids, counts = cache(*with_marker(data, bounds))
                ends = np.concatenate([[0], np.cumsum(counts)])
                back, at = model.decode(ids, counts)
                same = np.diff(at) == np.diff(bounds)
                differs = np.flatnonzero(back != data) if same.all() else None
                if differs is None:
                    same = [back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(at, at[1:], bounds, bounds[1:])]
                else:
                    same[np.searchsorted(bounds, differs, "right") - 1] = False
                n_bytes = np.concatenate([[0], np.cumsum(is_byte[ids])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(counts), pa.array(np.diff(n_bytes[ends])), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_pieces", "n_bytes", "round_trip"],
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, n_bytes long, round_trip boolean")


def decode(coded: DataFrame, model: PieceModel, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and text from ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("ids")
            counts = np.array([len(x) if x.is_valid else 0 for x in rows], np.int64)
            data, bounds = model.decode(rows.flatten().to_numpy(zero_copy_only=False), counts)
            text = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    rows = coded.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def default_model() -> PieceModel:
    import public_tokenizers

    return PieceModel.read(public_tokenizers.path("piece_bpe_32k.model"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
