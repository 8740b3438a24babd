"""Words, grams and anchors of Arrow string columns, computed over whole batches with numpy.

Texts stay UTF-8 bytes in the Arrow buffer. All hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_POWERS = np.ones(1, U64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * _C
    return x ^ (x >> U64(29))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS)), _A, U64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=U64)
    return _POWERS


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes of words ``[^\\x20\\x09-\\x0D]+``; with lowered letters the same bytes count.
SPACED = ~_class(b" \t\n\x0b\x0c\r")
#: Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z: digits, letters and all beyond ASCII.
ALNUM = _class(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


@dataclass
class Texts:
    """Some rows of a batch: their bytes one after the other, and where each row begins."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def of_row(self, r: int) -> bytes:
        return self.data[self.bounds[r]:self.bounds[r + 1]].tobytes()


def chunks(column: pa.Array, most: int = 2_000_000) -> Iterator[Texts]:
    """The rows of a string column, in chunks of about ``most`` bytes; a longer text is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield Texts(at, data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at])
        at = to
    pa.default_memory_pool().release_unused()  # workers live on; what a batch held goes back


@dataclass
class Words:
    starts: np.ndarray  #: byte offsets in the chunk
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  #: of each row, its first word

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(texts: Texts, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    data = texts.data
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(texts.bounds), np.int64))
    inside = table[data]
    begins = texts.bounds[:-1][texts.bounds[:-1] < n]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[begins] = inside[begins]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = begins[begins > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if len(starts):
        values = np.where(table, _BYTE, U64(0))
        if lower:
            values[0x41:0x5B] = values[0x61:0x7B]
        lengths = ends - starts
        spans = np.diff(np.append(starts, n))
        place = np.arange(starts[0], n) - np.repeat(starts, spans)
        longest = int(lengths.max())
        np.minimum(place, longest, out=place)
        hashes = mixed(np.add.reduceat(values[data[starts[0]:]] * _powers(longest + 1)[place], starts - starts[0]) + lengths.astype(U64) * _B)
    else:
        hashes = np.zeros(0, U64)
    return Words(starts, ends, hashes, np.searchsorted(starts, texts.bounds))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a * _A
    a ^= a >> U64(31)
    a += b
    a *= _B
    return a


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values; the last k - 1 places have none."""
    if len(values) < k:
        return np.zeros(0, U64)
    whole, size, power, width = None, 0, values, 1
    while True:
        if k & width:
            if whole is None:
                whole, size = power, width
            else:
                n = min(len(whole) - 0, len(power) - size)
                whole, size = _pair(whole[:n], power[size:size + n]), size + width
        width *= 2
        if width > k:
            break
        power = _pair(power[:len(power) - width // 2], power[width // 2:])
    return mixed(whole[:len(values) - k + 1])


def byte_values(texts: Texts) -> np.ndarray:
    return _BYTE[texts.data]


def in_one_row(bounds: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of the n - k + 1 runs of k places: does it lie in one row? ``bounds`` are those of the rows."""
    ok = np.ones(max(n - k + 1, 0), bool)
    for b in bounds[1:-1][np.diff(bounds)[1:] >= 0] if len(bounds) < 64 else ():
        ok[max(b - k + 1, 0):b] = False
    if len(bounds) >= 64 and len(ok):
        step = np.zeros(n + 1, np.int32)
        inner = bounds[1:-1]
        np.add.at(step, np.maximum(inner - k + 1, 0), 1)
        np.add.at(step, inner, -1)
        ok = np.cumsum(step)[:len(ok)] == 0
    return ok


def anchors(values: np.ndarray, bounds: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first run, last run) of k-grams such that equal runs of ``span`` values choose the gram at the same place.

    Each run within a row chooses its rightmost gram with the smallest hash. The runs that choose one gram follow each
    other, from the first to the last.
    """
    w = span - k + 1
    g = grams(values, k)
    if len(g) < w:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U64), none, none
    low, at = g, np.arange(len(g), dtype=np.int32)
    width = 1
    while width < w:
        step = min(width, w - width)
        right = low[step:] <= low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        width += step
    runs = np.flatnonzero(in_one_row(bounds, len(values), span))
    chosen = at[runs]
    cut = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(runs) else runs
    place = chosen[cut].astype(np.int64)
    return place, g[place], runs[cut], runs[np.append(cut[1:], len(runs)) - 1] if len(runs) else runs
