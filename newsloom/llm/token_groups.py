"""Exact Jaccard join of shingle sets by a token-group matrix.

Equal sets are one node. Nodes whose rarest shingle is the same form a group. The matrix has a row for each shingle and
a cell for each group whose union of prefix shingles holds it, with the bounds of its members' sizes and of the shingles
left behind that row. Only cells whose bounds allow the wanted overlap are opened and their members compared.

Prefixes: with one order of shingles for all nodes, two sets of likeness t or more share a shingle among their first
n - ceil(t n) + 1. A first matrix by hash order tells which rows are long; their shingles come last in the order of the
second, so that rows of the second are short, but for sets that are all of such shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm import anchored, arrowtext, components
from newsloom.llm.arrowtext import U64
from newsloom.llm.common import checkpointed, keyed_texts, shuffle_partitions

SHINGLE = 5
#: Likeness as a fraction: shared * WHOLE >= PART * union.
PART, WHOLE = 75, 100
#: Rows of the first matrix with more members put their shingle last in the order.
FREQUENT = 16
#: Rows of the second matrix with more members are first linked by leaders, then compared between components only.
LONG_ROW = 64
#: Members of a long row that sit in most long rows; the others are compared with them first.
LEADERS = 3
#: Members of a long row on either side of one comparison across components, about.
BLOCK = 1000
#: Bits of the filters that every task gets, whatever the input. A filter that is too full costs time, not results.
_FILTER_BITS = 1 << 26
_PARITIES = 2048


def sets_of(texts: arrowtext.Texts, size: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each row; a shorter text is one shingle, one without words none."""
    w = arrowtext.words(texts, lower=True)
    grams = arrowtext.grams(w.hashes, size)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            out.append(arrowtext.mixed(arrowtext.grams(w.hashes[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def node_key(s: np.ndarray) -> int:
    """One 64-bit name for equal sets."""
    return int(arrowtext.mixed(np.array([arrowtext.mixed(s).sum(dtype=U64) + U64(len(s))], U64)).view(np.int64)[0])


def planes(values: np.ndarray) -> bytes:
    """Small numbers byte by byte: all lowest bytes first. The upper ones are mostly zero and take no room when compressed."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(packed: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of _PARITIES classes: two sets differ in at least as many shingles as their sketches in bits."""
    return np.packbits((np.bincount((s & U64(_PARITIES - 1)).astype(np.int64), minlength=_PARITIES) & 1).astype(bool)).tobytes()


def prefix(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def _surveyed(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, n, key, sketch) of every document."""
    names = ["doc_id", "mark", "n", "key", "sketch"]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for texts in arrowtext.chunks(batch.column(1)):
                sets = sets_of(texts, size)
                own = [c.slice(texts.first_row, texts.rows) for c in (ids, marks)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(map(len, sets), pa.int64()), pa.array(map(node_key, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary())], names)

    return checkpointed(rows.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(survey, "doc_id long, mark long, n long, key long, sketch binary"))


def _collected_bits(bits: DataFrame) -> dict[int, bytes]:
    """Bitmaps of a column ``bit`` below _FILTER_BITS, by bucket of 32768 bits: a bounded size, whatever the input."""
    placed = F.col("bit") + 1  # bitmap positions count from 1
    found = bits.groupBy(F.bitmap_bucket_number(placed).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(placed)).alias("bits"))
    return {r["bucket"]: bytes(r["bits"]) for r in found.collect()}


def _bit_of(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - (_FILTER_BITS.bit_length() - 1))).astype(np.int64)


def _frequent(rows: DataFrame, size: int, parts: int, most: int) -> np.ndarray:
    """A bit for every shingle with more than ``most`` members in its row of the matrix by hash order."""
    def long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, _, key, _, _ = _gathered_cells(batches)
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        h = h[~anchored.same_as_before(h, key)]  # copies come from several tasks
        begins = np.flatnonzero(~anchored.same_as_before(h)) if len(h) else np.zeros(0, np.int64)
        long_ = begins[np.diff(np.append(begins, len(h))) > most]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit_of(h[long_])), pa.int64())], ["bit"])

    return _flat(_collected_bits(_matrix(rows, None, size, parts).repartitionById(parts, F.col("part")).mapInArrow(long_rows, "bit long")))


def _flat(bits: dict[int, bytes]) -> np.ndarray:
    every = np.zeros(_FILTER_BITS // 8, np.uint8)
    for bucket, packed in bits.items():
        every[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(packed, np.uint8)
    return every


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


_CELLS = "part int, h binary, node binary, pos binary, keys binary, sizes binary, groups binary"


def _matrix(rows: DataFrame, frequent: np.ndarray | None, size: int, parts: int) -> DataFrame:
    """Cells packed by part; without ``frequent`` (bits of the shingles that come last) only shingles and nodes."""
    names = [c.split()[0] for c in _CELLS.split(", ")]
    shared = None if frequent is None else rows.sparkSession.sparkContext.broadcast(frequent)

    pack = anchored._packed

    def packed(sizes: list[int], groups: list[int], keys: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(found)
        length = np.array([len(f) for f in found])
        node = np.repeat(np.arange(len(found)), length)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
        key, n, group = np.array(keys, np.int64), np.array(sizes), np.array(groups, U64)
        out = []
        for p, own in anchored.by_part(anchored.part_of(h, parts), parts):
            used, at = np.unique(node[own], return_inverse=True)
            out.append((p, pack(h[own], "<u8"), planes(np.diff(at, prepend=0)), b"" if shared is None else planes(pos[own]), pack(key[used], "<i8"),
                        b"" if shared is None else planes(n[used]), b"" if shared is None else pack(group[used], "<u8")))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()
            held: tuple[list, list, list, list] = ([], [], [], [])
            cells_held = 0
            for texts in arrowtext.chunks(batch.column(1)):
                for s in sets_of(texts, size):
                    if not len(s) or (k := node_key(s)) in done:
                        continue
                    if shared is not None:
                        late = _is_set(shared.value, _bit_of(s))
                        s = np.concatenate([s[~late], s[late]])
                    done.add(k)
                    for column, v in zip(held, (len(s), s[0], k, s[:prefix(len(s))].copy()), strict=True):
                        column.append(v)
                    cells_held += prefix(len(s))
                if cells_held > 500_000:
                    yield packed(*held)
                    held, cells_held = ([], [], [], []), 0
            if held[0]:
                yield packed(*held)

    return rows.select("doc_id", "text").mapInArrow(cells, _CELLS)


def _pairs_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i <= j, within each of consecutive blocks of these lengths."""
    base = np.cumsum(counts) - counts
    first, second = [], []
    for c in np.unique(counts):
        i, j = np.triu_indices(c)
        own = base[counts == c]
        first.append((own[:, None] + i).ravel())
        second.append((own[:, None] + j).ravel())
    return np.concatenate(first), np.concatenate(second)


def _allowed(na: np.ndarray, nb: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Can sets of these sizes be alike if they share at most ``left`` shingles?"""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (WHOLE * low >= PART * high) & ((WHOLE + PART) * left >= PART * (na + nb))


def _open_cells(batches: Iterator[pa.RecordBatch], long_row: int = LONG_ROW) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (row 0) of the cells worth opening, and the members of long rows (row = shingle)."""
    h, pos, key, n, group = _gathered_cells(batches)
    order = np.lexsort((key, group, h))
    h, pos, key, n, group = (x[order] for x in (h, pos, key, n, group))
    fresh = ~anchored.same_as_before(h, key)  # copies come from several tasks
    h, pos, key, n, group = (x[fresh] for x in (h, pos, key, n, group))
    if not len(h):
        return
    begins = np.flatnonzero(~anchored.same_as_before(h))
    length = np.diff(np.append(begins, len(h)))
    row = np.repeat(np.arange(len(begins)), length)
    is_long = (length > long_row)[row]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    some = np.flatnonzero((length > 1)[row] & ~is_long)
    if len(some):
        h1, p1, k1, n1, g1 = (x[some] for x in (h, pos, key, n, group))
        cell = np.flatnonzero(~anchored.same_as_before(h1, g1))
        members = np.diff(np.append(cell, len(h1)))
        smallest, largest = np.minimum.reduceat(n1, cell), np.maximum.reduceat(n1, cell)
        left = np.maximum.reduceat(n1 - p1, cell)
        rows = np.flatnonzero(~anchored.same_as_before(h1[cell]))
        i, j = _pairs_of(np.diff(np.append(rows, len(cell))))
        bound = np.minimum(left[i], left[j])  # the shingles before this row are no more in common
        worth = (WHOLE * largest[i] >= PART * smallest[j]) & (WHOLE * largest[j] >= PART * smallest[i]) & ((WHOLE + PART) * bound >= PART * (smallest[i] + smallest[j]))
        worth &= (i != j) | (members[i] > 1)
        i, j = i[worth], j[worth]
        total = members[i] * members[j]
        at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        x = np.repeat(cell[i], total) + at // np.repeat(members[j], total)
        y = np.repeat(cell[j], total) + at % np.repeat(members[j], total)
        ok = x < y
        x, y = x[ok], y[ok]
        ok = _allowed(n1[x], n1[y], np.minimum(n1[x] - p1[x], n1[y] - p1[y]))
        found.append((k1[x[ok]], k1[y[ok]]))
    long_ = np.flatnonzero(is_long)
    names = ["row", "a", "b", "n", "left"]
    if found:
        x, y = (np.concatenate(v) for v in zip(*found, strict=True))
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
        zero = np.zeros(len(pairs), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zero, pairs[:, 0], pairs[:, 1], zero, zero)], names)
    if len(long_):
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (h[long_].view(np.int64) | 1, key[long_], key[long_], n[long_], n[long_] - pos[long_])], names)


def _gathered_cells(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    got: list[list[np.ndarray]] = [[], [], [], [], []]
    for batch in batches:
        columns = [batch.column(i) for i in range(1, 7)]
        for i in range(batch.num_rows):
            h, node, pos, keys, sizes, groups = (c[i].as_buffer() for c in columns)
            node = np.cumsum(from_planes(node))
            whole = len(sizes) > 0
            values = (np.frombuffer(h, "<u8"), from_planes(pos), np.frombuffer(keys, "<i8")[node], from_planes(sizes)[node] if whole else node[:0],
                      np.frombuffer(groups, "<u8")[node] if whole else np.zeros(0, U64))
            for column, v in zip(got, values, strict=True):
                column.append(v)
    kinds = (U64, np.int64, np.int64, np.int64, U64)
    return tuple(np.concatenate(v) if v else np.zeros(0, k) for v, k in zip(got, kinds, strict=True))


def _near(pairs: DataFrame, survey: DataFrame) -> DataFrame:
    """The pairs whose sketches allow the likeness. With d shingles in only one of the two sets,

    shared = (na + nb - d) / 2 and union = (na + nb + d) / 2, so the rule is d * (WHOLE + PART) <= (na + nb) * (WHOLE - PART).
    """
    known = survey.where(F.col("n") > 0).groupBy("key").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
            d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((WHOLE + PART) * d <= (WHOLE - PART) * (na + nb), pa.bool_()))

    both = pairs.join(known.withColumnsRenamed({"key": "a", "n": "na", "sketch": "xa"}), "a").join(known.withColumnsRenamed({"key": "b", "n": "nb", "sketch": "xb"}), "b")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(keep, "a long, b long")


def _links(rows: DataFrame, survey: DataFrame, candidates: DataFrame, size: int) -> DataFrame:
    """The candidates (a, b) that are alike, compared shingle by shingle (40 bits of each)."""
    pairs = checkpointed(_near(candidates, survey))
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    marks = _collected_bits(wanted.select(F.pmod(F.col("key"), F.lit(_FILTER_BITS)).alias("bit")))
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def maybe_wanted(key: int) -> bool:
        bit = key % _FILTER_BITS
        bits = shared.value.get(bit // 32768 + 1)
        return bits is not None and bits[bit % 32768 // 8] >> (bit % 8) & 1 == 1

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()
            for texts in arrowtext.chunks(batch.column(1)):
                keys, packed = [], []
                for s in sets_of(texts, size):
                    if len(s) and (k := node_key(s)) not in done and maybe_wanted(k):
                        done.add(k)
                        keys.append(k)
                        packed.append(np.ascontiguousarray((s >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["key", "shingles"])

    made = rows.select("doc_id", "text").mapInArrow(sets, "key long, shingles binary")
    stored = made.groupBy("key").agg(F.first("shingles").alias("shingles"))  # one shuffle for both joins
    full = pairs.join(stored.withColumnsRenamed({"key": "a", "shingles": "sa"}), "a").join(stored.withColumnsRenamed({"key": "b", "shingles": "sb"}), "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(cell: pa.BinaryScalar) -> np.ndarray:
            wide = np.zeros((len(cell.as_buffer()) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, 5)
            return wide.view("<u8").ravel()

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = opened(batch.column(2)[i]), opened(batch.column(3)[i])
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(WHOLE * common >= PART * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long")


def _led(members: DataFrame) -> DataFrame:
    """Pairs of the members of long rows with the row's leaders: those that sit in most long rows."""
    seats = members.groupBy("a").agg(F.count(F.lit(1)).alias("seats"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("seats"), "a"))
    leaders = members.select("row", "a").join(seats, "a").withColumn("rank", rank).where(F.col("rank") <= LEADERS).select("row", F.col("a").alias("leader"))
    met = members.select("row", "a").join(leaders, "row").where(F.col("a") != F.col("leader"))
    return met.select(F.least("a", "leader").alias("a"), F.greatest("a", "leader").alias("b")).distinct()


def _across_cells(members: DataFrame, root: DataFrame, block: int = BLOCK) -> DataFrame:
    """The members of long rows that reach over several components, dealt to cells (row, band, part, seat) of bounded size.

    Of two sets that share at most the ``left`` of either, the smaller has (WHOLE + PART) * left >= PART * (na + nb) >=
    2 * PART * n. So only members of that kind seek, and each seeks those of its own band of sizes and of the next one:
    bands are powers of two, and sizes of alike sets lie within WHOLE / PART. Within a band, seekers and others are dealt
    to blocks by hash, and every block of seekers meets every block of others in a cell of its own.
    """
    seeks = (WHOLE + PART) * F.col("left") >= 2 * PART * F.col("n")
    labelled = checkpointed(members.join(root.withColumnRenamed("node", "a"), "a", "left").select(
        "row", "a", "n", "left", F.coalesce("root", "a").alias("root"), F.length(F.bin("n")).alias("band"), seeks.alias("seeks")))
    mixed = labelled.groupBy("row").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("seeks").alias("some"))
    others = labelled.join(mixed.where((F.col("low") != F.col("high")) & F.col("some")).select("row"), "row")
    seekers = others.where("seeks").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    blocks = lambda frame, name: frame.groupBy("row", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    cells = checkpointed(blocks(seekers, "parts").join(blocks(others, "seats"), ["row", "band"]))

    def dealt(frame: DataFrame, own: str, every: str, role: bool) -> DataFrame:
        number, one = F.pmod(F.xxhash64("a"), own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(every) - 1))
        part, seat = (number, one) if role else (one, number)
        return frame.join(cells, ["row", "band"]).select("row", "band", part.alias("part"), seat.alias("seat"), F.lit(role).alias("seeker"), "a", "n", "left", "root")

    return dealt(seekers, "parts", "seats", True).unionByName(dealt(others, "seats", "parts", False))


def _across(members: DataFrame, root: DataFrame, survey: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of members of one long row that lie in different components and whose sketches allow the likeness."""
    known = survey.where(F.col("n") > 0).groupBy(F.col("key").alias("a")).agg(F.min("sketch").alias("sketch"))

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        seeker = frame["seeker"].to_numpy()
        n, left, key, label = (frame[c].to_numpy() for c in ("n", "left", "a", "root"))
        bits = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
        others = np.flatnonzero(~seeker)
        found = [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(seeker):
            rest = others[((n[others] > n[i]) | (n[others] == n[i]) & (key[others] > key[i])) & (label[others] != label[i])]
            rest = rest[_allowed(n[i], n[rest], np.minimum(left[i], left[rest]))]
            d = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            rest = rest[(WHOLE + PART) * d <= (WHOLE - PART) * (n[rest] + n[i])]
            found.append(np.stack([np.minimum(key[i], key[rest]), np.maximum(key[i], key[rest])], 1))
        every = np.concatenate(found)
        return pd.DataFrame({"a": every[:, 0], "b": every[:, 1]})

    return _across_cells(members, root, block).join(known, "a").groupBy("row", "band", "part", "seat").applyInPandas(pairs, "a long, b long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, long_row: int = LONG_ROW) -> DataFrame:
    """doc_id, mark (hash of the text), n and class of every row; rows of one class reach each other by links.

    The class of a row without shingles is null.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rows = keyed_texts(docs, id_col, text_col)
    survey = _surveyed(rows, size)
    frequent = _frequent(rows, size, parts, FREQUENT)
    cells = _matrix(rows, frequent, size, parts).repartitionById(parts, F.col("part"))
    opened = checkpointed(cells.mapInArrow(lambda b: _open_cells(b, long_row), "row long, a long, b long, n long, left long"))
    candidates = opened.where(F.col("row") == 0).select("a", "b")
    members = opened.where(F.col("row") != 0)
    long_rows = not members.isEmpty()
    links = checkpointed(_links(rows, survey, (candidates.unionByName(_led(members)) if long_rows else candidates).distinct(), size))
    root = components.roots(links)
    if long_rows:
        root = components.roots(links.unionByName(_links(rows, survey, _across(members, root, survey), size)))
    known = survey.join(root.withColumnRenamed("node", "key"), "key", "left")
    return known.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("class"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, long_row: int = LONG_ROW) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row.

    Documents link when their shingle sets have likeness 0.75 or more; no pair is left out. Null and empty texts have no
    shingles and link with nothing, so their class is their own id. Equal sets link. Repeated rows each give a row and
    lie in one class; a null id takes part and counts only where its class has no other. Extra columns are left out.
    """
    placed = classes(docs, id_col, text_col, size, long_row)
    smallest = placed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("class").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.join(smallest, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _caught(docs: DataFrame, told: DataFrame, ident: Column, mark: Column) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: the rows whose (id, mark) is surely not in ``told``, and the others (with ``_told_id``, ``_told_mark``).

    A filter of bounded size tells them apart, so that most rows stay where they are and only the others are joined.
    """
    bit = lambda i, m: F.pmod(F.xxhash64(i, m), F.lit(_FILTER_BITS))
    bits = docs.sparkSession.sparkContext.broadcast(_flat(_collected_bits(told.select(bit(F.col("doc_id"), F.col("mark")).alias("bit")))))
    tagged = docs.select("*", ident.alias("_told_id"), mark.alias("_told_mark"), bit(ident, mark).alias("_told_bit"))

    def side(wanted: bool) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_is_set(bits.value, batch.column(batch.num_columns - 1).to_numpy()) == wanted, pa.bool_()))

        return tagged.mapInArrow(part, tagged.schema).drop("_told_bit")

    return side(False).drop("_told_id", "_told_mark"), side(True)


def _without(docs: DataFrame, gone: DataFrame, ident: Column, mark: Column) -> DataFrame:
    """The rows of ``docs`` whose (id, mark) is not in ``gone``."""
    rest, few = _caught(docs, gone, ident, mark)
    few = few.join(gone, few["_told_id"].eqNullSafe(gone["doc_id"]) & (few["_told_mark"] == gone["mark"]), "left_anti")
    return rest.unionAll(few.drop("_told_id", "_told_mark"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each class: the one with the smallest id.

    Among equal ids a hash of the text decides; of rows with equal id and text one stays; a row with a null id stays only
    where its class has no other. Rows without shingles all stay, repeated ones too.
    """
    placed = checkpointed(classes(docs, id_col, text_col)).where(F.col("class").isNotNull())
    first = placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))).alias("first"))
    gone = placed.join(first, "class").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))))
    mark = lambda df: F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit("")))
    kept = _without(docs, gone.select("doc_id", "mark").distinct(), docs[id_col].cast("long"), mark(docs))
    twice = placed.groupBy("doc_id", "mark").count().where(F.col("count") > 1).select(F.col("doc_id").alias("_own_id"), F.col("mark").alias("_own_mark"))
    if twice.isEmpty():
        return kept
    rest, few = _caught(kept, twice.toDF("doc_id", "mark"), kept[id_col].cast("long"), mark(kept))
    few = few.join(twice, few["_told_id"].eqNullSafe(twice["_own_id"]) & (few["_told_mark"] == twice["_own_mark"]), "left")
    few = few.withColumn("_own_row", F.when(F.col("_own_mark").isNull(), F.monotonically_increasing_id()))  # rows that occur once all differ
    return rest.unionAll(few.dropDuplicates([id_col, text_col, "_own_row"]).select(rest.columns))
