"""Vectorised scanning of text columns inside Arrow tasks.

Every helper works on one flat ``uint8`` buffer that holds many texts end to end plus their offsets, so that the Python work
per task is a few numpy passes and never a loop over words or bytes. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of text that one numpy pass handles (a single longer text is one pass of its own).
SLICE_BYTES = 2_000_000

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(_GOLD))


BYTE_KEYS = keys(256, 1)
_tables: dict[str, np.ndarray] = {}


def byte_table(ranges: list[tuple[int, int]], inside: bool) -> np.ndarray:
    """A table of 256 booleans; the listed inclusive ranges get ``inside``."""
    t = np.full(256, not inside)
    for a, b in ranges:
        t[a : b + 1] = inside
    return t


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = byte_table([(0x20, 0x20), (0x09, 0x0D)], False)
#: Bytes of words of letters and digits, all of them above 0x7F included; upper case counts, as it is lowered first.
ALNUM = byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)], True)
#: Bytes of folded words ``[a-z0-9]+``.
FOLDED = byte_table([(0x30, 0x39), (0x61, 0x7A)], True)
#: Lowers A-Z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text (or one row), each with its buffer and offsets."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends, start, n = np.cumsum(sizes), 0, batch.num_rows
    while start < n:
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(start, stop - start)
        yield (part, *flat(part.column(column)))
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and len + 1 offsets from 0."""
    a = pa.compute.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true within each text."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1] & ~cut[1:n]
    after[:-1] = inside[1:] & ~cut[1:n]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _places(n: int, salt: int) -> np.ndarray:
    """Random values of the places 0 .. n - 1, the same for any n."""
    have = _tables.get(f"places{salt}")
    if have is None or len(have) < n:
        have = keys(max(n, 4096), 40 + salt)
        if len(have) <= 4 * SLICE_BYTES:
            _tables[f"places{salt}"] = have
    return have[:n]


def sum_at_places(values: np.ndarray, counts: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``counts`` values, end to end: the sum of a mixed value for each value and its place.

    Two different runs agree only if sums of independent random values do, whatever their form: unlike a polynomial modulo
    2^64, no arrangement of two symbols collides by itself.
    """
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, _U)
        ends = np.cumsum(counts)
        place = np.arange(len(values)) - np.repeat(ends - counts, counts)
        np.cumsum(mix(values + _places(int(counts.max(initial=0)), salt)[place]), out=total[1:])
        return mix(total[ends] - total[ends - counts] + counts.astype(_U) * _U(_GOLD))


#: The last bytes of a span: so many low bytes of a word of eight.
_LOW_BYTES = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=_U)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; another salt gives an independent one. Eight bytes are one value."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    words = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    size = ends - starts
    each = (size + 7) >> 3
    last = np.cumsum(each)
    at = np.arange(int(last[-1])) - np.repeat(last - each, each)
    left = np.repeat(size, each) - 8 * at
    with np.errstate(over="ignore"):
        values = words[np.repeat(starts, each) + 8 * at] & _LOW_BYTES[np.minimum(left, 8)]
        return mix(sum_at_places(values, each, salt) + size.astype(_U) * _U(_GOLD))


def window_hashes(h: np.ndarray, n: int, seed: int = 3, linear: bool = False) -> np.ndarray:
    """Hash of h[i:i+n] for each i, by doubling; len(h) - n + 1 values (none if shorter).

    Each joining of two halves ends in a shift by which it is not linear, so that no pattern of two symbols collides by itself;
    where equal hashes decide nothing, the shift can be left out (linear).
    """
    if len(h) < n:
        return np.zeros(0, _U)
    base = keys(64, seed) | _U(1)

    def join(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        x = a * base[step]
        x += b
        if not linear:
            x ^= x >> _U(29)
        return x

    with np.errstate(over="ignore"):
        out, done, block, size, level = None, 0, h, 1, 0
        while True:
            if n & size:
                if out is None:
                    out = block
                else:  # out covers the first `done`, block the next `size`
                    m = min(len(out), len(block) - done)
                    out = join(out[:m], block[done : done + m], 32 + level)
                done += size
            if done == n:
                return mix(out[: len(h) - n + 1])
            m = len(block) - size
            block, size, level = join(block[:m], block[size:], level), size * 2, level + 1


def slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i:i+n] for each i; len(x) - n + 1 values."""
    if len(x) < n:
        return x[:0]
    block, size = x, 1
    while size * 2 <= n:
        block, size = np.minimum(block[: len(block) - size], block[size:]), size * 2
    return np.minimum(block[: len(x) - n + 1], block[n - size : n - size + len(x) - n + 1])


def owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.searchsorted(offsets, at, side="right") - 1


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Booleans of length n, true inside any [start, end)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.subtract.at(d, ends, 1)
    return np.cumsum(d[:-1]) > 0
