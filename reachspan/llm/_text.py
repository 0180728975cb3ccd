"""Vectorised text primitives on Arrow string buffers.

A block of documents is one byte array plus row offsets.  Words, word hashes and rolling hashes of
k consecutive units come out of a few NumPy passes over that array, so no Python runs per word.

All hashes of spans are polynomials over random unit values modulo the prime 2**61 - 1, with a mixing step.  Two different
spans of n units collide for at most n of the 2**61 bases; unlike a power of two, the prime has no base-free collisions.
They do not depend on the process, so equal text gives equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
U = np.uint64

PRIME = (1 << 61) - 1
_P = U(PRIME)
_BASE = 0x13C6EF372FE94F82 % PRIME
_UNBASE = pow(_BASE, -1, PRIME)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, PRIME, 256, dtype=np.uint64)
_SALT = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[LOWER]

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[0x20] = VISIBLE[0x09:0x0E] = False

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 31 bits: 2**61 is 1 and 2**62 is 2."""
    half, low = U(31), U((1 << 31) - 1)
    xh, xl, yh, yl = x >> half, x & low, y >> half, y & low
    middle = xh * yl
    middle += xl * yh
    out = xh * yh
    out += out
    out += xl * yl
    out += middle >> U(30)
    out += (middle & U((1 << 30) - 1)) << half
    return _reduced(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _powers
    while len(_powers[0]) < n:
        m = len(_powers[0])
        _powers = tuple(np.concatenate([p, times(p, np.full(m, pow(b, m, PRIME), np.uint64))]) for p, b in zip(_powers, (_BASE, _UNBASE), strict=True))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the hashes x."""
    return mix(x * _SALT[salt % len(_SALT)] + _SALT[(salt * 7 + 1) % len(_SALT)])


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers: what `span_hash` reads."""
    terms = times(_reduced(values), powers(len(values))[0])
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    # halves are summed apart, below 2**64 for 2**33 values
    high = np.cumsum(terms >> U(31), dtype=np.uint64)
    terms &= U((1 << 31) - 1)
    np.cumsum(terms, out=terms)
    out[1:] = _reduced((high >> U(30)) + ((high & U((1 << 30) - 1)) << U(31)) + _reduced(terms))
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [begin, end)."""
    return mix(times(_reduced(sums[end] + (_P - sums[begin])), powers(len(sums))[1][begin]))


class Block:
    """Some rows of a string column: `data` bytes, `at` row offsets, `rows` the rows' numbers."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first = data, at, first

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self, kind: np.ndarray, lower: bool) -> Words:
        n = len(self.data)
        is_word = kind[self.data]
        begins, ends = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        full = self.at[:-1] < self.at[1:]
        head, tail = self.at[:-1][full], self.at[1:][full] - 1
        begins[head] = is_word[head]
        ends[tail] = is_word[tail]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = prefix((_LOWER_BYTE if lower else _BYTE)[self.data]) if n else np.zeros(1, np.uint64)
        return Words(begin, end, np.searchsorted(begin, self.at), span_hash(sums, begin, end))

    def text(self, begin: int, end: int) -> bytes:
        return self.data[begin:end].tobytes()


class Words:
    """Words of a block: byte spans, hashes, and `at`, the offsets of each row's words."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, at: np.ndarray, hashes: np.ndarray):
        self.begin, self.end, self.at, self.hashes = begin, end, at, hashes

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def row_end(self) -> np.ndarray:
        return np.repeat(self.at[1:], self.counts)


def grams(units: np.ndarray, row_end: np.ndarray, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all runs of k units that lie within one row."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    start = np.flatnonzero(np.arange(k, n + k) <= row_end[:n])
    return start, span_hash(prefix(units) if sums is None else sums, start, start + k)


def word_hashes(text: str, kind: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of one text's words."""
    return next(blocks(pa.array([text], pa.string()))).words(kind, lower).hashes


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of at most `limit` bytes, but whole rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Block(data[at[first] : at[last]], at[first : last + 1] - at[first], first)
        first = last


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each span, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over each row's span of offsets."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans [begin, end)."""
    step = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
