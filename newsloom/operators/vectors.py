"""Vector search by cosine: exact in blocks, and through an inverted file of cells.

Vectors and queries travel as packed blocks. Null vectors, and those without a direction (empty, all zero or not finite),
are neither found nor asked for. Equal similarities are ordered by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from ..session import shared_checkpoint
from .ranking import top_k_per_group

#: Queries that a task holds, and rows of a packed block.
QUERIES, BLOCK = 20_000, 1_000
#: Similarities that a task computes at a time.
CELLS = 4_000_000
#: Vectors from which the coarse centres of an index are learned; every vector is indexed.
SAMPLE = 50_000


def _packed(df: DataFrame, key: str, vector: str, extra: str | None = None) -> DataFrame:
    """(slot, keys, size, data): blocks of unit vectors in the order of the rows; ``extra`` names a long column that a block shares."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer")
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(values, lambda x: x != 0)
    rows = df.filter(F.coalesce(sound, F.lit(False)) & F.col(key).isNotNull()).select(
        (F.col(extra) if extra else F.lit(0)).cast("long").alias("slot"), F.col(key).cast("long").alias("k"), values.alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(0).to_numpy()
            edges = np.unique(np.concatenate([[0, len(slots)], np.flatnonzero(np.diff(slots)) + 1, np.arange(0, len(slots), BLOCK)]).astype(int))
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                sizes = part.column(2).value_lengths().unique()
                if len(sizes) > 1:
                    raise ValueError("vectors of different lengths")
                m = part.column(2).flatten().to_numpy().reshape(b - a, -1)
                m = m / np.abs(m).max(1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(slots[a])]), pa.array([part.column(1).to_numpy().tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32()),
                    pa.array([m.tobytes()], pa.binary())], ["slot", "keys", "size", "data"])

    return rows.mapInArrow(pack, "slot long, keys binary, size int, data binary")


def _matrix(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, size)


class _Tops:
    """The best ``k`` (similarity, key) of each query so far."""

    def __init__(self, keys: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.keys, self.queries, self.k = keys, queries, k
        self.least = np.full(len(keys), -np.inf)
        self.query, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, CELLS // max(len(self.keys), 1))
        for at in range(0, len(keys), step):
            near = np.round(self.queries @ vectors[at:at + step].T, 12)  # equal vectors tie, whatever the order of additions
            q, v = np.nonzero(near >= self.least[:, None])
            query, found, score = np.append(self.query, q), np.append(self.found, keys[at + v]), np.append(self.score, near[q, v])
            order = np.lexsort((found, -score, query))
            query = query[order]
            head = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
            place = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
            kept = place < self.k
            self.query, self.found, self.score = query[kept], found[order][kept], score[order][kept]
            full = place == self.k - 1
            self.least[query[full]] = score[order][full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.keys[self.query]), pa.array(self.found), pa.array(self.score)], ["query", "k", "similarity"])


_FOUND = "query long, k long, similarity double"


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    named = found.select("query", F.col("k").alias(key), "similarity")
    return top_k_per_group(named, ["query"], [F.desc("similarity"), F.col(key)], k)


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 10) -> DataFrame:
    """(query, key, similarity, rank): the exact top ``k`` of every query among all vectors.

    Queries are dealt to rows of at most about ``QUERIES``, vectors to columns of a grid. A task holds the queries of one cell
    and ``k`` rows for each, and streams the vectors of its column through them; the columns' lists are merged at the end.
    """
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = shared_checkpoint(queries.select(F.col(query_key).alias("_q"), F.col(query_vector).alias("_v")))
    rows = max(1, -(-asked.count() // QUERIES))
    columns = max(1, -(-tasks // rows))
    dealt = asked.withColumn("_slot", F.pmod(F.xxhash64("_q"), F.lit(rows))).repartition(min(rows, tasks), "_slot").sortWithinPartitions("_slot")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(dealt, "_q", "_v", "_slot").select(F.lit(0).alias("kind"), "*", grid(columns).alias("column"))
    left = left.withColumn("cell", (F.col("slot") * columns + F.col("column")).cast("int"))
    right = _packed(vectors.select(key, vector), key, vector).select(F.lit(1).alias("kind"), "*")
    right = right.withColumn("column", F.pmod(F.xxhash64("keys"), F.lit(columns)).cast("int")).withColumn("row", grid(rows)).withColumn(
        "cell", (F.col("row") * columns + F.col("column")).cast("int")).drop("row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrices, tops = [], [], None
        for batch in batches:
            for kind, ids, size, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == 0:
                    keys.append(np.frombuffer(ids, np.int64))
                    matrices.append(_matrix(data, size))
                elif keys:
                    tops = tops or _Tops(np.concatenate(keys), np.concatenate(matrices), k)
                    if tops.queries.shape[1] != size:
                        raise ValueError("vectors of different lengths")
                    tops.add(np.frombuffer(ids, np.int64), _matrix(data, size))
        if tops:
            yield tops.batch()

    both = left.select("cell", "kind", "keys", "size", "data").unionByName(right.select("cell", "kind", "keys", "size", "data"))
    found = both.repartitionById(rows * columns, "cell").sortWithinPartitions("kind").select("kind", "keys", "size", "data").mapInArrow(search, _FOUND)
    return _ranked(found, key, k)


@dataclass
class Index:
    """An inverted file: unit centres, and blocks of all vectors by cell (slot, keys, size, data)."""

    centres: np.ndarray
    blocks: DataFrame
    key: str


def _cells(centres: np.ndarray, vector: str, probes: int) -> Column:
    """The ``probes`` nearest cells of a vector."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<long>")
    def cells(v):
        m = np.stack([np.asarray(x, np.float64) for x in v]) if len(v) else np.zeros((0, centres.shape[1]))
        order = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
        return type(v)(list(order))

    return cells(F.transform(F.col(vector), lambda x: x.cast("double")))


def build_index(vectors: DataFrame, key: str, vector: str, lists: int = 64, seed: int = 7) -> Index:
    """Cells around ``lists`` centres: cosine k-means over at most about ``SAMPLE`` vectors, taken by hash of the key.

    Every vector is indexed. Blocks of a cell have a bounded size, so that a cell that holds many rows is many blocks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = vectors.filter(F.coalesce(F.exists(values, lambda x: x != 0) & F.forall(values, lambda x: F.coalesce(~F.isnan(x), F.lit(False))), F.lit(False)))
    total = sound.count()
    if total == 0:
        return Index(np.zeros((1, 1)), _packed(sound.select(key, vector), key, vector), key)
    share = min(1.0, SAMPLE / total)
    sample = sound.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select(array_to_vector(values).alias("features"))
    model = KMeans(k=max(2, min(lists, int(total * share) or 2)), seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample)
    centres = np.array(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    placed = sound.select(key, vector, F.get(_cells(centres, vector, 1), 0).alias("_cell"))
    spread = placed.repartition("_cell", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("_cell")
    return Index(centres, shared_checkpoint(_packed(spread, key, vector, "_cell")), key)


def search_index(index: Index, queries: DataFrame, query_key: str, query_vector: str, k: int = 10, probes: int = 16) -> DataFrame:
    """(query, key, similarity, rank): the best ``k`` of every query in its ``probes`` nearest cells; exact where these are all cells.

    Blocks of queries meet blocks of vectors by an equi-join on the cell, which AQE splits where a cell is hot.
    """
    able = queries.filter(F.coalesce(F.exists(query_vector, lambda x: x != 0), F.lit(False))).select(F.col(query_key).alias("_q"), F.col(query_vector).alias("_v"))
    asked = able.withColumn("_cell", F.explode(_cells(index.centres, "_v", min(probes, len(index.centres)))))
    packed = _packed(asked.repartition("_cell", F.pmod(F.xxhash64("_q"), F.lit(16))).sortWithinPartitions("_cell"), "_q", "_v", "_cell")
    pairs = index.blocks.join(packed.select("slot", F.col("keys").alias("asked"), F.col("data").alias("asks")), "slot").select("size", "keys", "data", "asked", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, keys, data, asked, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tops = _Tops(np.frombuffer(asked, np.int64), _matrix(asks, size), k)
                tops.add(np.frombuffer(keys, np.int64), _matrix(data, size))
                yield tops.batch()

    return _ranked(pairs.mapInArrow(search, _FOUND), index.key, k)


def recall(exact: DataFrame, approximate: DataFrame, key: str) -> DataFrame:
    """One row: queries, and the share of the exact lists that the approximate ones hold."""
    held = exact.select("query", key).join(approximate.select("query", key, F.lit(1).alias("_h")), ["query", key], "left")
    return held.agg(F.count_distinct("query").alias("queries"), (F.count("_h") / F.count(F.lit(1))).alias("recall"))
