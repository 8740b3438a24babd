"""Search for repeated runs of words or bytes, shared by the two removers of repeats.

Each text chooses anchors (grams picked by their hash) such that equal runs of ``length`` units hold an anchor at the
same place. Anchors meet by their hash, packed into binary columns. Two occurrences of an anchor with equal
surroundings (all runs that chose it) need no further look: the later one is covered. Occurrences with other
surroundings stay *open* and are compared run by run by the operator.

Rows are known by (doc_id, hash of the text): rows that are equal in both are the same document. Null ids order first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm import arrowtext
from newsloom.llm.arrowtext import U64
from newsloom.llm.common import checkpointed, keyed_texts, null_first, shuffle_partitions

_INVERSE = U64(pow(int(arrowtext._A), -1, 2**64))
_INVERSES = np.ones(1, U64)
#: Anchors with more different surroundings than this are compared by window hashes alone.
HOT = 10_000


@dataclass(frozen=True)
class Rule:
    """Runs of ``length`` units (``words`` or ``bytes``) are repeats; ``gram`` units make an anchor.

    ``hot``: anchors with more different surroundings are compared by window hashes alone. ``inside``: an earlier start in the same document counts, not only a smaller id.
    """

    unit: str
    length: int
    gram: int
    inside: bool
    hot: int = HOT

    @property
    def extent(self) -> str:
        """Kind of number that holds how far a run reaches from its anchor."""
        return next(kind for kind, most in (("u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32)) if self.length < most)


class Sums:
    """Hashes of any range of a sequence of values, from running sums."""

    def __init__(self, values: np.ndarray) -> None:
        global _INVERSES
        n = len(values) + 1
        if len(_INVERSES) < n:
            p = np.full(max(n, 2 * len(_INVERSES)), _INVERSE, U64)
            p[0] = 1
            _INVERSES = np.cumprod(p, dtype=U64)
        self.sums = np.zeros(n, U64)
        np.cumsum(values * arrowtext._powers(n)[:n - 1], out=self.sums[1:])

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return arrowtext.mixed((self.sums[b] - self.sums[a]) * _INVERSES[a])


class Measured(Sums):
    """Units of a chunk of texts: a value each, row bounds, and hashes of any range."""

    def __init__(self, texts: arrowtext.Texts, unit: str) -> None:
        if unit == "words":
            self.words = arrowtext.words(texts)
            self.values, self.bounds = self.words.hashes, self.words.bounds
        else:
            self.values, self.bounds = arrowtext.byte_values(texts), texts.bounds
        super().__init__(self.values)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null as the lowest), mark (hash of the text) and text."""
    return keyed_texts(docs, id_col, text_col).select(null_first(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its entries in order)."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            yield p, order[cut[p]:cut[p + 1]]


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U64(33)) % U64(parts)).astype(np.int64)


_ANCHORS = "part int, h binary, high binary, low binary, row binary, pos binary, left binary, right binary, ids binary, marks binary"


def _anchor_blobs(docs: DataFrame, rule: Rule, parts: int) -> DataFrame:
    names = [c.split()[0] for c in _ANCHORS.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found: list[tuple] = []
            for texts in arrowtext.chunks(batch.column(2)):
                m = Measured(texts, rule.unit)
                pos, grams, first, last = arrowtext.anchors(m.values, m.bounds, rule.gram, rule.length)
                if not len(pos):
                    continue
                row = np.searchsorted(m.bounds, pos, "right") - 1
                left, right = pos - first, last + rule.length - pos - rule.gram
                around = m.ranges(pos - left, pos + rule.gram + right) + arrowtext.mixed(((left << 32) + right).astype(U64))
                found.append((grams, arrowtext.mixed(around), row + texts.first_row, pos - m.bounds[row], left, right))
            if not found:
                continue
            h, g, row, pos, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            out = []
            for p, own in by_part(part_of(h, parts), parts):
                rows, at = np.unique(row[own], return_inverse=True)
                out.append((p, _packed(h[own], "<u8"), _packed(g[own] >> U64(32), "<u4"), _packed(g[own] >> U64(16) & U64(0xFFFF), "<u2"), _packed(at, "<u4"),
                            _packed(pos[own], "<u4"), _packed(left[own], rule.extent), _packed(right[own], rule.extent), _packed(ids[rows], "<i8"), _packed(marks[rows], "<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names)

    return docs.mapInArrow(find, _ANCHORS)


def gathered(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """All packed columns of a partition, one array each; ``row`` is moved to places in all ``ids``."""
    got: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    base = 0
    for batch in batches:
        columns = {k: batch.column(batch.schema.get_field_index(k)) for k in kinds}
        for i in range(batch.num_rows):
            for k, kind in kinds.items():
                a = np.frombuffer(columns[k][i].as_buffer(), kind)
                got[k].append(a.astype(np.int64) + base if k == "row" else a)
            base += len(got["ids"][-1])
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in got.items()}


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    return same


SPANS = "doc_id long, mark long, starts binary, stops binary, firsts binary"
_FOUND = f"{SPANS}, pos binary, lefts binary, rights binary, keys binary, hot binary"


def _by_document(ids: np.ndarray, marks: np.ndarray) -> Iterator[np.ndarray]:
    order = np.lexsort((marks, ids))
    if not len(order):
        return
    cut = np.flatnonzero(~same_as_before(ids[order], marks[order]))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield order[a:b]


def _judge(rule: Rule):
    kinds = {"h": "<u8", "high": "<u4", "low": "<u2", "row": "<u4", "pos": "<u4", "left": rule.extent, "right": rule.extent, "ids": "<i8", "marks": "<i8"}
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = gathered(batches, kinds)
        if not len(a["h"]):
            return
        order = np.argsort(a["h"], kind="stable")
        same = same_as_before(a["h"][order])
        several = same | np.append(same[1:], False)
        own = order[several]
        if not len(own):
            return
        h, row, pos, left, right = (a[k][own] for k in ("h", "row", "pos", "left", "right"))
        g = a["high"][own].astype(np.int64) << 16 | a["low"][own]
        ids, marks = a["ids"][row], a["marks"][row]
        order = np.lexsort((pos, marks, ids, g, h))
        h, g, ids, marks, pos, left, right = (x[order] for x in (h, g, ids, marks, pos, left, right))
        fresh = ~same_as_before(h, g, ids, marks, pos)  # repeated rows are one document
        h, g, ids, marks, pos, left, right = (x[fresh] for x in (h, g, ids, marks, pos, left, right))
        begins = ~same_as_before(h, g)
        group = np.cumsum(begins) - 1
        first = ids[np.flatnonzero(begins)][group]
        covered = ~begins if rule.inside else ids > first
        of_h = ~same_as_before(h)
        anchor = np.cumsum(of_h) - 1
        contexts = np.bincount(anchor, weights=begins)[anchor]
        spread = contexts > 1
        if not rule.inside:  # runs of one document only never cover anything
            smallest = np.minimum.reduceat(ids, np.flatnonzero(of_h))[anchor]
            largest = np.maximum.reduceat(ids, np.flatnonzero(of_h))[anchor]
            spread &= smallest < largest
        useful = covered
        open_ = ~covered & spread
        keep = np.flatnonzero(useful | open_)
        out: list[list] = [[] for _ in names]
        for own in _by_document(ids[keep], marks[keep]):
            own = keep[own]
            c, o = own[useful[own]], own[open_[own]]
            values = (int(ids[own[0]]), int(marks[own[0]]), _packed(pos[c].astype(np.int64) - left[c], "<u4"), _packed(pos[c].astype(np.int64) + rule.gram + right[c], "<u4"),
                      _packed(first[c], "<i8"), _packed(pos[o], "<u4"), _packed(left[o], rule.extent), _packed(right[o], rule.extent), _packed(h[o], "<u8"),
                      _packed(contexts[o] > rule.hot, "u1"))
            for column, v in zip(out, values, strict=True):
                column.append(v)
            if len(out[0]) >= 5000:
                yield _batch(out, names)
                out = [[] for _ in names]
        if out[0]:
            yield _batch(out, names)

    return judge


def _batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(columns)], names)


def search(docs: DataFrame, rule: Rule) -> DataFrame:
    """Covered spans and open anchors, packed, in some rows for each document that has any."""
    parts = shuffle_partitions(docs.sparkSession)
    blobs = _anchor_blobs(docs, rule, parts)
    return checkpointed(blobs.repartitionById(parts, F.col("part")).mapInArrow(_judge(rule), _FOUND))


def open_anchors(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that have open anchors, with these in ``anchors``."""
    some = found.where(F.octet_length("pos") > 0).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("pos", "lefts", "rights", "keys", "hot")).alias("anchors"))
    return docs.join(some, ["doc_id", "mark"]).select("doc_id", "mark", "text", "anchors")


def unpacked(cell, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The packed fields of a list of structs, each as one array."""
    parts = [[np.frombuffer(v, kind) for v, kind in zip(x.values(), kinds, strict=True)] for x in cell or ()]
    return [np.concatenate([p[i] for p in parts] or [np.zeros(0, kind)]).astype(np.int64 if kind != "<u8" else U64) for i, kind in enumerate(kinds)]


_WINDOWS = "part int, h binary, row binary, start binary, ids binary, marks binary"


class WindowBlobs:
    """Collects (window hash, document, start) and packs them by part."""

    names = [c.split()[0] for c in _WINDOWS.split(", ")]

    def __init__(self, parts: int) -> None:
        self.parts, self.found = parts, []

    def add(self, hashes: np.ndarray, row: int, starts: np.ndarray) -> None:
        self.found.append((hashes, np.full(len(starts), row, np.int64), starts))

    def rows(self, ids: np.ndarray, marks: np.ndarray) -> list[tuple]:
        if not self.found:
            return []
        h, row, start = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found = []
        out = []
        for p, own in by_part(part_of(h, self.parts), self.parts):
            rows, at = np.unique(row[own], return_inverse=True)
            out.append((p, _packed(h[own], "<u8"), _packed(at, "<u4"), _packed(start[own], "<u4"), _packed(ids[rows], "<i8"), _packed(marks[rows], "<i8")))
        return out


def first_windows(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that occur earlier, of all windows of a part."""
    a = gathered(batches, {"h": "<u8", "row": "<u4", "start": "<u4", "ids": "<i8", "marks": "<i8"})
    h, ids, marks, start = a["h"], a["ids"][a["row"].astype(np.int64)], a["marks"][a["row"].astype(np.int64)], a["start"].astype(np.int64)
    order = np.lexsort((start, marks, ids, h))
    h, ids, marks, start = (x[order] for x in (h, ids, marks, start))
    fresh = ~same_as_before(h, ids, marks, start)
    h, ids, marks, start = (x[fresh] for x in (h, ids, marks, start))
    begins = ~same_as_before(h)
    first = ids[np.flatnonzero(begins)][np.cumsum(begins) - 1] if len(h) else ids
    covered = np.flatnonzero(~begins if rule.inside else ids > first)
    yield from span_rows(ids[covered], marks[covered], start[covered], start[covered] + rule.length, first[covered])


def span_rows(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, stops: np.ndarray, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed spans by document; overlapping ones with one first document are united."""
    names = [c.split()[0] for c in SPANS.split(", ")]
    out: list[list] = [[] for _ in names]
    for own in _by_document(ids, marks):
        own = own[np.lexsort((starts[own], firsts[own]))]
        s, e, f = starts[own], stops[own], firsts[own]
        top = np.maximum.accumulate(e + (np.cumsum(~same_as_before(f)) << 40)) & ((1 << 40) - 1)
        cut = np.ones(len(s), bool)
        cut[1:] = (f[1:] != f[:-1]) | (s[1:] > top[:-1])
        at = np.flatnonzero(cut)
        for column, v in zip(out, (int(ids[own[0]]), int(marks[own[0]]), _packed(s[at], "<u4"), _packed(np.maximum.reduceat(e, at), "<u4"), _packed(f[at], "<i8")), strict=True):
            column.append(v)
        if len(out[0]) >= 5000:
            yield _batch(out, names)
            out = [[] for _ in names]
    if out[0]:
        yield _batch(out, names)


def with_spans(docs: DataFrame, *spans: DataFrame) -> DataFrame:
    """Every document with all its packed spans in ``spans`` (null without any)."""
    names = [c.split()[0] for c in SPANS.split(", ")]
    every = spans[0].select(*names)
    for s in spans[1:]:
        every = every.unionByName(s.select(*names))
    own = every.where(F.octet_length("starts") > 0).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("starts", "stops", "firsts")).alias("spans"))
    return docs.join(own, ["doc_id", "mark"], "left").select("doc_id", "mark", "text", "spans")


def united(starts: np.ndarray, stops: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint maximal spans in order (touching ones united), with the largest first document of each."""
    if not len(starts):
        return starts, stops, firsts
    order = np.argsort(starts, kind="stable")
    s, e, f = starts[order], stops[order], firsts[order]
    top = np.maximum.accumulate(e)
    cut = np.flatnonzero(np.append(True, s[1:] > top[:-1]))
    return s[cut], np.maximum.reduceat(e, cut), np.maximum.reduceat(f, cut)


def null_id(ids: pa.Array) -> pa.Array:
    """Back from the lowest id to null."""
    import pyarrow.compute as pc

    return pc.if_else(pc.equal(ids, pa.scalar(-(2**63), pa.int64())), pa.scalar(None, pa.int64()), ids)
