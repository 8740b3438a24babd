"""Suffix-array de-duplication of byte strings by the interval tree of common prefixes.

Anchors find the places around which strings may repeat (see :mod:`anchored`). The surroundings of open anchors meet by
anchor; each group of them gets an enhanced suffix array whose intervals of common prefixes are scanned with a stack.
Intervals whose suffixes have different characters to their left are maximal repeats: all their occurrences but the
earliest are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm import anchored, arrowtext
from newsloom.llm.common import shuffle_partitions

LENGTH = 100
GRAM = 32
#: Bytes of the surroundings that share one suffix array; a larger group has one of its own.
BLOCK = 1_000_000
_FIRST = 7  #: characters of nine bits in the first ranks


class EnhancedArray:
    """Suffixes of several strings in order, with the common prefixes of neighbours. No suffix goes beyond its string."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, least: int) -> None:
        n = len(data)
        lengths = np.diff(bounds)
        ends = np.repeat(bounds[1:], lengths)
        symbols = data.astype(np.int64) + 1
        key = np.zeros(n, np.int64)
        at = np.arange(n)
        for j in range(_FIRST):
            inside = at + j < ends
            key = key << 9 | np.where(inside, symbols[np.minimum(at + j, n - 1)], 0)
        self.ranks = [(_FIRST, self._ranked(key))]
        size, longest = _FIRST, int(lengths.max()) if len(lengths) else 0
        while size < longest:
            rank = self.ranks[-1][1]
            after = np.where(at + size < ends, rank[np.minimum(at + size, n - 1)].astype(np.int64) + 1, 0)
            size *= 2
            self.ranks.append((size, self._ranked(rank.astype(np.int64) * (n + 2) + after)))
        long_enough = np.flatnonzero(ends - at >= least)
        self.order = long_enough[np.argsort(self.ranks[-1][1][long_enough], kind="stable")]
        self.ends, self.symbols = ends, symbols
        begins = np.zeros(n, bool)
        begins[bounds[:-1][bounds[:-1] < n]] = True
        #: the character to the left; at the beginning of a string one that no other place has
        self.left = np.where(begins, -1 - at, np.append(0, symbols[:-1])) if n else symbols
        self.common = self._common()

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])) if len(key) else 0
        return rank

    def _common(self) -> np.ndarray:
        """Length of the common prefix of each suffix in order and the one before it; 0 for the first."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        room = np.minimum(self.ends[a] - a, self.ends[b] - b)
        common = np.zeros(len(a), np.int64)
        n = len(self.symbols)
        for size, rank in reversed(self.ranks):
            same = (common + size <= room) & (rank[np.minimum(a + common, n - 1)] == rank[np.minimum(b + common, n - 1)])
            common += np.where(same, size, 0)
        for _ in range(_FIRST - 1):
            same = common < room
            same &= self.symbols[np.minimum(a + common, n - 1)] == self.symbols[np.minimum(b + common, n - 1)]
            common += same
        return np.append(0, common)

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of each interval of the order whose suffixes share ``least`` characters or more and
        differ to the left. Inner intervals come before those around them."""
        left = self.left[self.order]
        turns = np.cumsum(np.append(0, left[1:] != left[:-1]))
        high = np.flatnonzero(self.common >= least)
        if not len(high):
            return
        runs = np.flatnonzero(np.append(True, np.diff(high) > 1))
        for a, b in zip(high[runs], high[np.append(runs[1:], len(high)) - 1], strict=True):
            stack: list[tuple[int, int]] = []
            for i, c in enumerate([*self.common[a:b + 1].tolist(), 0], int(a)):
                begin = i - 1
                while stack and stack[-1][0] > c:
                    size, begin = stack.pop()
                    if turns[i - 1] != turns[begin]:
                        yield size, begin, i - 1
                if c and (not stack or stack[-1][0] < c):
                    stack.append((c, begin))


def _repeats(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``data``, length) of every occurrence of a maximal repeat but its earliest; the longest at each place.

    ``starts``: place of each string in its document. Copies of one place (a document's own stretch under two anchors)
    are one occurrence.
    """
    array = EnhancedArray(data, bounds, least)
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[array.order] if len(array.order) else array.order
    place = array.order - bounds[string] + starts[string]
    where = np.lexsort((place, marks[string], ids[string]))
    same = anchored.same_as_before(ids[string][where], marks[string][where], place[where])
    rank = np.empty(len(where), np.int64)
    rank[where] = np.cumsum(~same)
    longest = np.zeros(len(where), np.int64)
    for size, first, last in array.maximal_repeats(least):
        if last - first < 8:
            own = rank[first:last + 1].tolist()
            low = min(own)
            for i, r in enumerate(own, first):
                if r > low and longest[i] < size:
                    longest[i] = size
        else:
            own = rank[first:last + 1]
            later = own > own.min()
            part = longest[first:last + 1]
            np.maximum(part, np.where(later, size, 0), out=part)
    hit = np.flatnonzero(longest)
    return array.order[hit], longest[hit]


def _with_repeats(data: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Which strings hold a run of ``least`` bytes whose hash occurs again; the others have nothing to find."""
    count = np.maximum(np.diff(bounds) - least + 1, 0)
    string = np.repeat(np.arange(len(count)), count)
    at = bounds[string] + np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    h = anchored.Sums(arrowtext._BYTE[data]).ranges(at, at + least)
    order = np.argsort(h)
    same = anchored.same_as_before(h[order])
    same[:-1] |= same[1:]
    found = np.zeros(len(count), bool)
    found[string[order[same]]] = True
    return found


_SNIPPETS = "part int, key binary, row binary, start binary, size binary, data binary, ids binary, marks binary"


def _compared(docs: DataFrame, found: DataFrame, rule: anchored.Rule) -> list[DataFrame]:
    """Spans of the strings around open anchors that occur earlier: by suffix arrays, and for hot anchors by hashes."""
    parts = shuffle_partitions(docs.sparkSession)
    opened = anchored.open_anchors(docs, found)
    names = [c.split()[0] for c in _SNIPPETS.split(", ")]
    pack = anchored._packed

    def each(batch: pa.RecordBatch) -> Iterator[tuple[arrowtext.Texts, int, list[np.ndarray]]]:
        for texts in arrowtext.chunks(batch.column(2)):
            for r in range(texts.rows):
                yield texts, r, anchored.unpacked(batch.column(3)[texts.first_row + r].as_py(), ("<u4", rule.extent, rule.extent, "<u8", "u1"))

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys, rows, starts, sizes, data = [], [], [], [], []
            for texts, r, (pos, left, right, key, hot) in each(batch):
                keep = np.flatnonzero((hot == 0) & (left + right + rule.gram >= rule.length))
                base = int(texts.bounds[r])
                for p, a, b, k in zip(*(x[keep].tolist() for x in (pos, left, right, key)), strict=True):
                    keys.append(k)
                    rows.append(texts.first_row + r)
                    starts.append(p - a)
                    sizes.append(a + rule.gram + b)
                    data.append(texts.data[base + p - a:base + p + rule.gram + b].tobytes())
            if not keys:
                continue
            key, row, start, size = np.array(keys, np.uint64), np.array(rows), np.array(starts), np.array(sizes)
            out = []
            for p, own in anchored.by_part(anchored.part_of(key, parts), parts):
                used, at = np.unique(row[own], return_inverse=True)
                out.append((p, pack(key[own], "<u8"), pack(at, "<u4"), pack(start[own], "<u4"), pack(size[own], "<u4"), b"".join(data[i] for i in own.tolist()),
                            pack(ids[used], "<i8"), pack(marks[used], "<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names)

    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            blobs, measured = anchored.WindowBlobs(parts), None
            for texts, r, (pos, left, right, _, hot) in each(batch):
                keep = hot > 0
                count = np.maximum(left[keep] + right[keep] + rule.gram - rule.length + 1, 0)
                if not count.sum():
                    continue
                if measured is None or measured[0] is not texts:
                    measured = texts, anchored.Measured(texts, rule.unit)
                first = pos[keep] - left[keep]
                starts = np.unique(np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                at = starts + texts.bounds[r]
                blobs.add(measured[1].ranges(at, at + rule.length), texts.first_row + r, starts)
            if out := blobs.rows(ids, marks):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], blobs.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchored.gathered(batches, {"key": "<u8", "row": "<u4", "start": "<u4", "size": "<u4", "data": "u1", "ids": "<i8", "marks": "<i8"})
        order = np.argsort(a["key"], kind="stable")
        key, row, start, size = (a[k][order] for k in ("key", "row", "start", "size"))
        size, start = size.astype(np.int64), start.astype(np.int64)
        ids, marks = a["ids"][row.astype(np.int64)], a["marks"][row.astype(np.int64)]
        offset = (np.cumsum(a["size"].astype(np.int64)) - a["size"])[order]
        groups = np.append(np.flatnonzero(~anchored.same_as_before(key)), len(key))
        total = np.append(0, np.cumsum(size))
        out: list[tuple] = []
        at = 0
        while at < len(groups) - 1:
            to = max(at + 1, int(np.searchsorted(total[groups], total[groups[at]] + BLOCK, "right")) - 1)
            own = np.arange(groups[at], groups[to])
            at = to
            for filtered in (False, True):
                bounds = np.append(0, np.cumsum(size[own]))
                source = np.repeat(offset[own] - bounds[:-1], size[own]) + np.arange(bounds[-1])
                if not filtered:
                    own = own[_with_repeats(a["data"][source], bounds, rule.length)]
            if not len(own):
                continue
            place, longest = _repeats(a["data"][source], bounds, ids[own], marks[own], start[own], rule.length)
            string = np.searchsorted(bounds, place, "right") - 1
            begin = place - bounds[string] + start[own][string]
            out.append((ids[own][string], marks[own][string], begin, begin + longest))
        if out:
            i, m, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
            yield from anchored.span_rows(i, m, s, e, np.zeros(len(i), np.int64))

    by_array = opened.mapInArrow(snippets, _SNIPPETS).repartitionById(parts, F.col("part")).mapInArrow(scan, anchored.SPANS)
    by_hash = opened.mapInArrow(hot_windows, anchored._WINDOWS).repartitionById(parts, F.col("part")).mapInArrow(
        lambda b: anchored.first_windows(b, rule), anchored.SPANS)
    return [by_array, by_hash]


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                  hot: int = anchored.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes, if asked for) of every row.

    Removed is every byte covered by a string of ``length`` bytes that also starts earlier: in a document with a smaller
    id, or before in the same one; judged on the input. Null and empty texts have no bytes. Rows with equal id and text
    are one document and give equal rows; equal ids with other texts are ordered by a hash of the text; null ids come
    first. Extra columns are left out.
    """
    rule = anchored.Rule("bytes", length, gram, inside=True, hot=hot)
    rows = anchored.rows_of(docs, id_col, text_col)
    found = anchored.search(rows, rule)
    spanned = anchored.with_spans(rows, found, *_compared(rows, found, rule))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in arrowtext.chunks(batch.column(2)):
                out: list[list] = [[] for _ in names[1:]]
                for r in range(texts.rows):
                    text, removed, at, kept, spans = texts.of_row(r), 0, 0, [], 0
                    cell = batch.column(3)[texts.first_row + r]
                    if cell.is_valid:
                        s, e, _ = anchored.united(*anchored.unpacked(cell.as_py(), ("<u4", "<u4", "<i8")))
                        for a, b in zip(s.tolist(), e.tolist(), strict=True):
                            kept.append(text[at:a])
                            at, removed, spans = b, removed + b - a, spans + 1
                    rest = b"".join([*kept, text[at:]])
                    for column, v in zip(out, (len(text), removed, spans, hashlib.sha256(rest).hexdigest(), rest), strict=False):
                        column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [anchored.null_id(ids.slice(texts.first_row, texts.rows)), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names)

    return spanned.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
