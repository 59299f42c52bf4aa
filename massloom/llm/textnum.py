"""Text in numpy: words, hashes and units of an Arrow string column, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; bounds the working arrays (about 40 bytes each) whatever the length of a text.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(0x5EED).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            row = np.full(n, np.uint64(b))
            row[0] = 1
            _POWERS[k] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 bounds between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        s, e = int(starts[i]), int(ends[j - 1])
        up, down = _powers(e - s + 1)
        sums = np.zeros(e - s + 1, np.uint64)
        np.cumsum(_RANDOM[data[s:e]] * up[: e - s], out=sums[1:])
        a, b = starts[i:j] - s, ends[i:j] - s
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and how many each text has."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def windows(hashes: np.ndarray, counts: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of width words within each text: (text, first word, hash), in order.

    short: a text of 1 to width - 1 words gives its whole sequence as one window.
    """
    n = len(hashes)
    first = np.cumsum(counts) - counts
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    text = np.repeat(np.arange(len(counts)), counts)
    left = (first + counts)[text] - np.arange(n) if n else np.zeros(0, np.int64)  # words from here to the text's end
    sums = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        part = hashes[k:] * factors[k]
        ok = left[: n - k] > k
        sums[: n - k][ok] += part[ok]
    whole = left >= width
    if short:
        at_first = np.zeros(n, bool)
        at_first[first[counts > 0]] = True
        whole |= at_first & (counts[text] < width)
    at = np.flatnonzero(whole)
    return text[at], at - first[text[at]], mix(sums[at] + np.minimum(left[at], width).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def distinct(text: np.ndarray, values: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, sorted by both."""
    order = np.argsort(values)
    order = order[np.argsort(text[order].astype(np.uint16 if n_texts < 65536 else np.int64), kind="stable")]
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return text[new], values[new]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, or one row."""
    _, bounds = flat(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for every (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


class UnitCache:
    """Ids of text units, each computed once while the cache lasts.

    Texts are cut into units that a coder treats alone: at a space between two characters that are surely no white
    space (the space opens a unit). Units repeat far more than texts do. encode(list of str) gives all their ids, one
    after another, and how many each has.

    Bounds: a call adds the new units of its texts; a call that finds more than most units, or more than 16 * most ids,
    first drops those that were not met again since the last such call (all, if half of the bound is still held then).
    """

    def __init__(self, encode, most: int = 400_000, fine: bool = False):
        self.encode, self.most, self.fine = encode, most, fine
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self.starts, self.used, self.again = np.zeros(1 << 12, np.int64), 0, np.zeros(1 << 12, bool)

    def _learn(self, units: list[str]) -> None:
        for i in range(0, len(units), 20_000):
            part = units[i : i + 20_000]
            ids, sizes = self.encode(part)
            need, k = self.used + int(sizes.sum()), len(self.known)
            if need > len(self.ids):
                self.ids = np.resize(self.ids, max(need, 2 * len(self.ids)))
            if k + len(part) > len(self.sizes):
                more = max(k + len(part), 2 * len(self.sizes))
                self.sizes, self.starts, self.again = (np.resize(x, more) for x in (self.sizes, self.starts, self.again))
            self.ids[self.used : need] = ids
            self.sizes[k : k + len(part)] = sizes
            self.starts[k : k + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.again[k : k + len(part)] = False
            self.known.update(zip(part, range(k, k + len(part))))
            self.used = need

    def _shrink(self) -> None:
        """Keep the units that were met again, and forget that they were."""
        keep = np.flatnonzero(self.again[: len(self.known)])
        sizes = self.sizes[keep]
        if 2 * len(keep) > self.most or sizes.sum() > 8 * self.most:
            return self.clear()
        names, at = list(self.known), ragged(self.starts[keep], sizes)
        ids = self.ids[at]
        self.clear()
        self.known = dict(zip((names[k] for k in keep.tolist()), range(len(keep))))
        self.ids, self.used = np.append(ids, np.zeros(1 << 16, np.int32)), len(ids)
        self.sizes, self.starts, self.again = sizes, np.cumsum(sizes) - sizes, np.zeros(len(keep), bool)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        cuts = unit_cuts(data, bounds, self.fine)
        units = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > self.most or self.used > 16 * self.most:
            self._shrink()
        old = len(self.known)
        self._learn([x for x in names if x not in self.known])
        place = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.again[place[place < old]] = True
        place = place[coded.indices.to_numpy()]
        sizes = self.sizes[place]
        ids = self.ids[ragged(self.starts[place], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.searchsorted(cuts, bounds)])


_SURE = np.zeros(256, bool)  # ASCII that is no white space
_SURE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = _SURE & ~_LETTER
_SIGN[48:58] = False
_TWO = np.zeros(256, bool)  # first bytes of characters U+00C0 to U+07FF, none of which is white space
_TWO[0xC3:0xE0] = True


def unit_cuts(data: np.ndarray, bounds: np.ndarray, fine: bool = False) -> np.ndarray:
    """Where units begin, and the end: text bounds, and spaces between characters that are surely no white space.

    Sure are ASCII 0x21-0x7E and two-byte characters from U+00C0; other neighbours leave the space inside a unit. fine:
    also between an ASCII letter and a sign after it, and on both sides of a line feed between sure characters; the
    byte-level pre-tokenizers split there in every context.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True

    def single(byte: int) -> np.ndarray:
        at = np.flatnonzero(data == byte)
        at = at[(at > 0) & (at < len(data) - 1)]
        before, after = data[at - 1], data[at + 1]
        two = (before >= 0x80) & (before < 0xC0) & _TWO[data[np.maximum(at - 2, 0)]]
        return at[(_SURE[before] | two) & (_SURE[after] | _TWO[after])]

    cut[single(0x20)] = True
    if fine:
        feeds = single(0x0A)
        cut[feeds] = cut[feeds + 1] = True
        cut[1:-1] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    return np.flatnonzero(cut)
