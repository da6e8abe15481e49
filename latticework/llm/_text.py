"""Vectorised text kernels: word boundaries, word names, rolling hashes, minimisers.

Everything works on one contiguous UTF-8 buffer and its document offsets, the
layout in which Arrow hands strings to Python. A word of up to ``SHORT`` bytes is its own
name, a longer one is named by 63 bits of its BLAKE2b digest. Rolling (Rabin-Karp) hashes are polynomials modulo 2**64 over
such names or over randomised bytes; since strings can be made that share one, they
only *select* what is compared, and the strings or their digests decide.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles (a longer document is one step).
CHUNK = 1 << 20

#: Bytes of a word that is a number as it is, and names of longer ones that a process keeps at a time.
SHORT, MOST_NAMES = 7, 1 << 16

U64 = np.uint64
_rng = np.random.default_rng(0x5EED_1DEA)
_SYMBOL = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_PADDING = np.array([*((1 << 64) - (1 << 8 * n) for n in range(SHORT + 1)), 0], U64)

#: Word characters of the two word definitions in use.
SPACE_SPLIT = np.ones(256, bool)
SPACE_SPLIT[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.ones(256, bool)
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    cache = vars(sys.modules["numpy"]).setdefault("_rolling_powers", [])  # of the process, not of a task; never pickled
    if not cache or len(cache[0]) < n:
        size = max(n, 1 << 16, 2 * len(cache[0]) if cache else 0)
        tables = [np.full(size, base, U64) for base in (_BASE, _INVERSE)]
        for p in tables:
            p[0] = 1
        cache[:] = [np.multiply.accumulate(p) for p in tables]
    return cache[0][:n], cache[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits of a hash are usable."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; any span's hash follows from two of them."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the half-open spans, independent of where they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def rolling(sums: np.ndarray, size: int) -> np.ndarray:
    """Mixed hashes of every window of the given size."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, U64)
    return mix((sums[size:] - sums[:n]) * powers(len(sums))[1][:n])


def sliding(values: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every window of the given size, in linear time."""
    n = len(values)
    if n < size:
        return values[:0]
    fill = values[-1:]
    pad = np.concatenate([values, np.repeat(fill, -n % size)]).reshape(-1, size)
    ahead = op.accumulate(pad, axis=1).ravel()
    behind = op.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - size + 1], ahead[size - 1 : n])


def lengths_to_owner(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


class _Names(dict):
    """Numbers of long words, filled as words come; none has 255 as its last byte."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_NAMES:
            self.clear()
        name = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1
        return name


def names(words: list[bytes]) -> np.ndarray:
    """The number of each long word."""
    known = vars(sys.modules["numpy"]).setdefault("_word_names", _Names())  # of the process, not of a task; never pickled
    return np.fromiter(map(known.__getitem__, words), U64, len(words))


def digest(data: bytes) -> bytes:
    """Sixteen bytes that stand for the string."""
    return hashlib.blake2b(data, digest_size=16).digest()


class Words:
    """Word boundaries and hashes of a buffer; words never cross documents.

    ``start``/``end``: byte spans of the words; ``first``: index of each
    document's first word, with the total at the end; ``hash``: names of words
    that blanks part, else polynomial hashes, to be verified by who uses them.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False):
        data = _LOWER[data] if lower else data
        inside = kind[data]
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        edge = inside.copy()
        edge[1:] &= ~inside[:-1] | begins[1:n]
        self.start = np.flatnonzero(edge)
        edge = inside
        edge[:-1] &= ~inside[1:] | begins[1:n]
        self.end = np.flatnonzero(edge) + 1
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.hash = self._names(data) if kind is SPACE_SPLIT else spans(prefix(_SYMBOL[data]), self.start, self.end)

    def _names(self, data: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        short = np.minimum(size, SHORT + 1)
        at = np.ndarray(len(data) + 1, U64, np.concatenate([data, np.full(8, 255, np.uint8)]), strides=(1,))
        out = at[self.start] | _PADDING[short]  # no byte of UTF-8 is 255, so each short word has a number of its own
        long = np.flatnonzero(size > SHORT)
        for lo in range(0, len(long), 1 << 17):
            part = long[lo : lo + (1 << 17)]
            base = int(self.start[part[0]])
            raw = data[base : int(self.end[part[-1]])].tobytes()
            out[part] = names([raw[a:b] for a, b in zip((self.start[part] - base).tolist(), (self.end[part] - base).tolist(), strict=True)])
        return mix(out)


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix(_SYMBOL[data])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about CHUNK bytes of text, with buffer and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            lo, hi = offsets[row], offsets[to]
            yield batch.slice(row, to - row), data[lo:hi], offsets[row : to + 1] - lo
            row = to


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Mask of the hashes that are the least of some ``width`` consecutive ones.

    Equal stretches of ``width`` hashes always select the same of them, so what
    two texts share is found among selected hashes alone, without loss. With
    fewer than ``width`` hashes none is selected.
    """
    least = sliding(hashes, width, np.minimum)
    if not len(least):
        return np.zeros(len(hashes), bool)
    top = np.concatenate([np.zeros(width - 1, hashes.dtype), least, np.zeros(width - 1, hashes.dtype)])
    return sliding(top, width, np.maximum) == hashes


def cover(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Mask of 0..n-1 under the windows of ``size`` that start at the positions."""
    out = np.zeros(n, bool)
    if len(at):
        at = np.sort(at)
        apart = np.flatnonzero(at[1:] > at[:-1] + size)
        for lo, hi in zip(at[np.append(0, apart + 1)].tolist(), (at[np.append(apart, len(at) - 1)] + size).tolist(), strict=True):
            out[lo:hi] = True
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a mask."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Mask of the values that are among the sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def lowered(data: np.ndarray) -> bytes:
    return _LOWER[data].tobytes()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
