"""Vectorised word work on Arrow string columns.

A whole Arrow batch is tokenised at once with numpy: no Python loop per word. Words are
runs of bytes that a 256-entry table maps to non-zero; the table may fold case. A word's mapped bytes
are a polynomial, whose values at two points modulo a prime make its 62-bit hash; two different words
of n bytes have both values equal for a share of (n / PRIME)**2 of the choices of points at most. Two more points
make a second, independent hash, where a lone hash decides over many words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 18
ROLL, ROLL_2 = 0xD6E8FEB86659FD93, 0xA24BAED4963EE407
#: Sums of bytes times powers stay below 2**64 over any slice: 8 + 31 + 20 bits.
PRIME = (1 << 31) - 1
POINTS = tuple(np.random.default_rng(20240301).integers(1 << 20, PRIME - 1, 4).tolist())

_bytes = np.arange(256, dtype=np.uint8)
#: Words `[^\x20\x09-\x0D]+`, bytes unchanged; 0 separates. A NUL byte is a word byte, so it maps to 255, which UTF-8 never uses.
SPACED = np.where((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)), 0, np.where(_bytes == 0, 255, _bytes)).astype(np.uint8)
#: The same words with A-Z folded to a-z.
SPACED_LOWER = np.where((SPACED >= 65) & (SPACED <= 90), SPACED + 32, SPACED).astype(np.uint8)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after folding A-Z.
_low = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
ALNUM_LOWER = np.where(((_low >= 48) & (_low <= 57)) | ((_low >= 97) & (_low <= 122)) | (_low >= 128), _low, 0).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class _Powers:
    """Powers of a point and of its inverse modulo PRIME, grown on demand."""

    def __init__(self, point: int) -> None:
        self.point = point
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 4096)
            self.up, self.down = self._grown(self.point, size), self._grown(pow(self.point, -1, PRIME), size)
        return self.up, self.down

    @staticmethod
    def _grown(base: int, size: int) -> np.ndarray:
        out = np.ones(1, U)
        while len(out) < size:
            out = np.concatenate((out, out * U(pow(base, len(out), PRIME)) % U(PRIME)))
        return out[:size]


_powers = [_Powers(p) for p in POINTS]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, each value followed by a line feed, and the value offsets. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.binary_join_element_wise(pc.fill_null(pc.cast(column, pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch in order: hashes, byte bounds, and where each value's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each value, and the count of all words last
    other: np.ndarray | None = None  # second hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The value that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (or second ones) of k consecutive words by first word, and a mask of those within one value."""
        n, h, roll = len(self.hash) - k + 1, *((self.other, ROLL_2) if second else (self.hash, ROLL))
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        g = h[:n].copy()
        for j in range(1, k):
            g *= U(roll)
            g += h[j : j + n]
        owner = self.owner()
        return mix(g), owner[:n] == owner[k - 1 :]


def slices(data: np.ndarray, word_byte: np.ndarray):
    """Bounds of slices of about SLICE bytes that end after a separator."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + SLICE, n)
        while to < n and word_byte[data[to - 1]]:
            more = np.flatnonzero(word_byte[data[to : to + 4096]] == 0)
            to = to + int(more[0]) + 1 if len(more) else min(to + 4096, n)
        yield at, to
        at = to


def words(column: pa.Array, table: np.ndarray, second: bool = False) -> Words:
    """The words of a column; second: with second hashes."""
    data, offsets = flat(column)
    pairs = 2 if second else 1
    hashes, starts, ends = [[np.zeros(0, U)] for _ in range(pairs)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(data, table):
        mapped = table[data[a:b]]
        edge = np.diff(np.concatenate(([0], (mapped != 0).astype(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        value = _long if b - a > 2 * SLICE else _values
        for i in range(pairs):
            hashes[i].append(mix((value(mapped, s, e, _powers[2 * i]) << U(32)) | value(mapped, s, e, _powers[2 * i + 1])))
        starts.append(s + a)
        ends.append(e + a)
    start = np.concatenate(starts)
    return Words(data, offsets, np.concatenate(hashes[0]), start, np.concatenate(ends), np.searchsorted(start, offsets), np.concatenate(hashes[1]) if second else None)


def _values(mapped: np.ndarray, s: np.ndarray, e: np.ndarray, powers: _Powers) -> np.ndarray:
    """The polynomials of words at a point, from running sums over a slice."""
    up, down = powers.of(len(mapped) + 1)
    total = np.zeros(len(mapped) + 1, U)
    np.cumsum(mapped * up[: len(mapped)], out=total[1:])
    return (total[e] - total[s]) % U(PRIME) * down[s] % U(PRIME)


def _long(mapped: np.ndarray, s: np.ndarray, e: np.ndarray, powers: _Powers) -> np.ndarray:
    """The same of a slice that a huge word stretches, piece by piece."""
    up, _ = powers.of(SLICE)
    out = []
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        h = 0
        for at in range(a, b, SLICE):
            piece = mapped[at : min(b, at + SLICE)]
            h += int((piece * up[: len(piece)]).sum(dtype=U)) * pow(powers.point, at - a, PRIME)
        out.append(h % PRIME)
    return np.array(out, U)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column: values in order, counts of them for each row."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def spread(mask_or_values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each [first[i], first[i+1])."""
    total = np.zeros(len(mask_or_values) + 1, np.int64)
    np.cumsum(mask_or_values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
