"""Vectorised scans of UTF-8 text inside Arrow batches.

Texts of a batch are taken in chunks of a few MB, as one byte array with document offsets. Words, lines and
other spans are found with numpy, and get 64-bit hashes from one running sum per chunk, so the cost is a few
nanoseconds a byte and memory is bounded by the chunk (or by the longest text, which is never split).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: White space of the word rule: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = 0x9E3779B97F4A7C15 | 5
_BACK = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
# Modulo 2^64 some texts of 512 bytes and more collide whatever the base is, so long spans are polynomials over two
# prime fields.
LONG_SPAN = 256
_PRIME = (1 << 31) - 1
_BASES = (1_287_346_129, 894_003_817)
_BYTES = np.random.default_rng(20240607).integers(1, _PRIME, (2, 256), dtype=np.uint64)
_field_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64),) * 2] * 2


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows; null is read as empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_STEP, _BACK):
            step = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
            step[0] = 1
            out.append(np.cumprod(step, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def field_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """At least n powers of each base and of its inverse in the prime fields."""
    global _field_powers
    if len(_field_powers[0][0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        _field_powers = [(_power(base, size), _power(pow(base, -1, _PRIME), size)) for base in _BASES]
    return _field_powers


def _power(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, _PRIME)) % np.uint64(_PRIME)
        done += more
    return out


def _folded(x: np.ndarray) -> np.ndarray:
    """Below 2^63, brought below 2^33 without a division; the same modulo the prime."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z and the letters U+00C0 to U+00DE in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


class Hasher:
    """64-bit hashes of any spans of one chunk. Up to 2^30 bytes the sums of long spans stay below 2^63."""

    def __init__(self, data: np.ndarray):
        self._data = data
        self._forward, self._back = powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self._forward[: len(data)], out=self._sum[1:])
        self._fields: list[tuple[np.ndarray, np.ndarray]] = []

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mix((self._sum[ends] - self._sum[starts]) * self._back[starts])
        long = np.flatnonzero(ends - starts >= LONG_SPAN)
        if len(long):
            out[long] = self._long(starts[long], ends[long])
        return out

    def _long(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not self._fields:
            n = len(self._data)
            for (forward, back), weight in zip(field_powers(n + 1), _BYTES, strict=True):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(_folded(weight[self._data] * forward[:n]), out=total[1:])
                self._fields.append((total, back))
        high, low = (
            (total[ends] - total[starts]) % np.uint64(_PRIME) * back[starts] % np.uint64(_PRIME)
            for total, back in self._fields
        )
        return mix((high << np.uint64(32)) | low)


def same_bytes(one: np.ndarray, at: np.ndarray, two: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `one` that begin at `at` hold the same bytes as those of `two` that begin `there`."""
    stop = np.cumsum(size)
    step = np.arange(int(stop[-1]) if len(stop) else 0)
    differs = one[step + np.repeat(at - (stop - size), size)] != two[step + np.repeat(there - (stop - size), size)]
    count = running(differs)
    return count[stop] == count[stop - size]


def running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each position, and in all."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    return running((data & 0xC0) != 0x80)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set bytes; a run ends with its document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    stops = offsets[1:][offsets[1:] > 0] - 1
    last[stops] = inside[stops]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words, in order."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, owners(starts, offsets)


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of that many words, and which of them lie inside one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= np.uint64(_STEP)
        total += hashes[k : k + n]
    return mix(total), doc[:n] == doc[size - 1 :]


def packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
