"""Vectorised helpers over Arrow batches of texts, used inside Spark tasks.

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Words, line breaks and hashes are
found for a whole slice of a batch at once with numpy, so no loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
"""Texts are worked on in slices of about this many bytes, to bound a task's memory."""

_PAIR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """A different hash of ``x`` for each seed."""
    return mix(x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK))


def unit_interval(h: np.ndarray) -> np.ndarray:
    """Hashes as floats in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix(a * np.uint64(_PAIR) + b)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values that start at each position; only the first len(h) - n + 1 are given.

    Windows of 1, 2, 4, ... values are mixed from two of half the size, and n from those of its binary digits. Nothing is a
    polynomial, so no pattern of the values makes two windows meet.
    """
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out, at, size = None, 0, 1
    while True:
        if n & size:
            own = h[at : at + count]
            out = own if out is None else combined(out, own)
            at += size
        size *= 2
        if size > n:
            return mix(out + np.uint64(n))
        h = combined(h[: -(size // 2)], h[size // 2 :])


def _chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes as 64-bit numbers of eight bytes each, filled up with zeros: the numbers, each one's place in its run, and each run's first."""
    lens = ends - starts
    count = np.maximum((lens + 7) >> 3, 1)
    first = np.cumsum(count) - count
    if len(data) < 8 or len(starts) == 0:
        held = np.zeros(8, np.uint8)
        held[: len(data)] = data
        data = held
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    at = np.repeat(starts, count) + 8 * place
    left = np.minimum(np.repeat(ends, count) - at, 8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) if data.flags.c_contiguous else np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    late = np.maximum(at - (len(data) - 8), 0)  # the last bytes are read with what is before them
    back = np.minimum(late, 8).astype(np.uint64) << np.uint64(3)
    found = words[np.minimum(at, len(data) - 8)]
    found = np.where(late > 7, np.uint64(0), found >> np.minimum(back, np.uint64(63)))
    keep = np.where(left <= 0, np.uint64(0), ~np.uint64(0) >> (np.uint64(64) - (np.maximum(left, 1).astype(np.uint64) << np.uint64(3))))
    return found & keep, place, first


def _hashed(chunks: np.ndarray, place: np.ndarray, first: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    key = np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    own = mix(chunks + mix(place.astype(np.uint64) + key))
    if len(chunks) > len(first):
        own = np.add.reduceat(own, first)
    return mix(own + lens.astype(np.uint64) * np.uint64(_PAIR))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes. Every eight bytes are mixed with their place before they are added up; each seed gives another hash."""
    if not len(starts):
        return np.empty(0, np.uint64)
    return _hashed(*_chunks(data, starts, ends), ends - starts, seed)


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of runs of bytes that stand for all, and for each run which of those is equal to it.

    Runs are found by their hashes and compared byte by byte. A run whose hash meets another's stands for itself.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chunks, place, first = _chunks(data, starts, ends)
    lens = ends - starts
    _, where, back = np.unique(_hashed(chunks, place, first, lens, 0), return_index=True, return_inverse=True)
    there = where[back]
    other = lens[there] != lens
    if len(chunks) > len(first):
        long = np.diff(np.append(first, len(chunks)))
        own = np.flatnonzero((long > 1) & ~other)
        other |= chunks[first] != chunks[first[there]]
        if len(own):
            n = long[own]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            unlike = chunks[np.repeat(first[own], n) + inside] != chunks[np.repeat(first[there[own]], n) + inside]
            other[own] |= np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    else:
        other |= chunks != chunks[there]
    odd = np.flatnonzero(other)
    back[odd] = len(where) + np.arange(len(odd))
    return np.concatenate((where, odd)), back


class Slice:
    """Some rows of a batch: their texts as one byte array, and their words.

    ``row``: first row in the batch; ``text_at``: byte offsets of the texts (one more than rows);
    ``starts``/``ends``: byte offsets of the words; ``word_at``: for each text the index of its
    first word (one more than rows). ``space``: which bytes are outside words, if not white space.
    """

    def __init__(self, row: int, data: np.ndarray, text_at: np.ndarray, space: np.ndarray | None = None):
        self.row, self.data, self.text_at = row, data, text_at
        self.n = len(text_at) - 1
        self.space = _SPACE[data] if space is None else space
        edge = np.empty(len(data) + 1, bool)  # words never run over the end of a text
        if len(data):
            inside = ~self.space
            edge[0], edge[-1] = inside[0], False
            np.greater(inside[1:], inside[:-1], out=edge[1:-1])
            cut = text_at[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            edge[cut] = inside[cut]
            starts = np.flatnonzero(edge[:-1])
            edge[0] = False
            np.less(inside[1:], inside[:-1], out=edge[1:-1])
            edge[-1] = inside[-1]
            edge[cut] = inside[cut - 1]
            ends = np.flatnonzero(edge)
        else:
            starts = ends = np.empty(0, np.int64)
        self.starts, self.ends = starts, ends
        self.word_at = np.searchsorted(starts, text_at)

    def word_hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, ASCII lower-cased on demand."""
        d = self.data
        if lower:
            d = _LOWER[d]
        return run_hashes(d, self.starts, self.ends, seed)

    def word_doc(self) -> np.ndarray:
        """The text (0..n-1) of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def window_starts(self, n: int) -> np.ndarray:
        """Indexes of the words at which n words of one text start."""
        return starts_of(self.word_at, n)


def starts_of(at: np.ndarray, n: int) -> np.ndarray:
    """Indexes at which n entries of one text start, where the entries of text t are at[t] to at[t + 1]."""
    total = int(at[-1])
    if total < n:
        return np.empty(0, np.int64)
    left = np.repeat(at[1:], np.diff(at))[: total - n + 1]
    return np.flatnonzero(np.arange(total - n + 1) + n <= left)


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a batch in slices of at most ``most`` bytes, or of one text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if len(texts) else texts
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        to = min(max(to, row + 1), len(texts))
        yield Slice(row, held[at[row] : at[to]], at[row : to + 1] - at[row])
        row = to


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a window of n positions that starts at one of ``starts``."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, total), -1)
    return np.cumsum(step[:-1]) > 0
