"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed: each pass over the centred rows multiplies it with a block of vectors, and a polynomial
in these products damps the part of the spectrum that is not wanted. QR and Rayleigh-Ritz on the driver see matrices of
the vectors' length times the block only. Pairs are locked once their residuals are at rounding level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import checkpointed

COMPONENTS = 32
#: Vectors of the block beyond the wanted ones.
SPARE = 16
SCALE, OFFSET = 64, 1_000_000
#: Largest degree of a filter, and how much more than the lowest wanted pair it may enlarge the highest.
DEGREE, SPREAD = 16, 1e8
LANCZOS = 12
ROUNDS = 200
#: Entries of a matrix that a task holds at a time.
CELLS = 2_000_000
#: Tasks whose partial sums meet in one place.
TOGETHER = 64


@dataclass
class Rows:
    """Integer vectors in blocks (a checkpointed table: data, ids, null_ids), their number and their sums by dimension."""

    blocks: DataFrame
    tasks: int
    n: int
    sums: np.ndarray


def integer_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Rows:
    """The vectors of the fit list as integers: floor(64 c) + 1000000.

    Null and empty vectors and those with null or non-finite entries are left out. All others must have one length, and
    entries below 2**24, so that the integers are exact; else the job ends.
    """
    vector = rows[vector_col].cast("array<double>")
    sound = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    exact = F.when(F.exists(vector, lambda c: F.abs(c) >= 2.0**24), F.raise_error(F.lit("an entry is too large for exact sums"))).otherwise(
        F.transform(vector, lambda c: F.floor(c * SCALE) + OFFSET))
    whole = rows.filter(vector.isNotNull() & (F.size(vector) > 0) & sound).select(rows[id_col].cast("long").alias("vec_id"), exact.alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column(1).value_lengths().unique()
                if len(lengths) > 1:
                    raise ValueError("vectors of different lengths")
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lengths[0].as_py()], pa.int32()), pa.array([batch.column(1).flatten().to_numpy().astype("<i4").tobytes()], pa.binary()),
                    pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                    pa.array([np.array(ids.is_null()).astype(np.uint8).tobytes()], pa.binary()),
                ], ["size", "data", "ids", "null_ids"])

    blocks = checkpointed(whole.mapInArrow(pack, "size int, data binary, ids binary, null_ids binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _matrices(batches):
            sums = np.append(x.sum(0), len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), x.shape[1], np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["size", "i", "y"])

    found = blocks.mapInArrow(add, "size int, i int, y long").groupBy("size", "i").agg(F.sum("y").alias("s")).collect()
    if len({r["size"] for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    values = np.array([s for _, s in sorted((r["i"], r["s"]) for r in found)], np.int64)
    return Rows(blocks, blocks.rdd.getNumPartitions(), int(values[-1]) if len(values) else 0, values[:-1])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple]]:
    """Integer matrices of bounded size, with (batch, row, first vector) of each."""
    for batch in batches:
        for r in range(batch.num_rows):
            size = batch.column(0)[r].as_py()
            x = np.frombuffer(batch.column(1)[r].as_py(), "<i4").reshape(-1, size)
            step = max(1, CELLS // size)
            for at in range(0, len(x), step):
                yield x[at:at + step].astype(np.int64), (batch, r, at)


def _summed(rows: Rows, of_matrix) -> np.ndarray:
    """Sum over all rows of ``of_matrix(centred rows)``: added up in each task, then in groups of ``TOGETHER`` tasks, then here."""
    shared = rows.blocks.sparkSession.sparkContext.broadcast((rows.n, rows.sums))
    groups = -(-rows.tasks // TOGETHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = shared.value
        total = None
        for x, _ in _matrices(batches):
            y = of_matrix((n * x - sums) / n)
            total = y if total is None else total + y
        yield from _sent(TaskContext.get().partitionId() % groups, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = 0, None
        for batch in batches:
            for group, size, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                y = np.frombuffer(data).reshape(size, -1)
                total = y if total is None else total + y
        yield from _sent(group, total)

    kind = "slot long, size int, y binary"
    parts = rows.blocks.mapInArrow(run, kind)
    if groups > 1:
        parts = parts.repartition(groups, "slot").mapInArrow(add, kind)
    total = sum(np.frombuffer(r["y"]).reshape(r["size"], -1) for r in parts.collect())
    shared.unpersist()
    return total


def _sent(slot: int, total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([len(total)], pa.int32()), pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["slot", "size", "y"])


def covariance_times(rows: Rows, q: np.ndarray) -> np.ndarray:
    """One distributed pass: the covariance times the columns of ``q``."""
    return _summed(rows, lambda c: c.T @ (c @ q)) / rows.n


def lowest_bound(times, size: int, seed: int = 5) -> float:
    """A lower bound of the spectrum by a few Lanczos steps: the lowest Ritz value less the last remainder."""
    v = np.random.default_rng(seed).normal(size=size)
    basis, alphas, betas = [v / np.linalg.norm(v)], [], []
    for _ in range(min(size, LANCZOS)):
        w = times(basis[-1][:, None])[:, 0]
        alphas.append(float(w @ basis[-1]))
        for _ in range(2):
            w -= sum((w @ b) * b for b in basis)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-14 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    k = len(alphas)
    low = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:k - 1], 1) + np.diag(betas[:k - 1], -1))[0]
    return max(0.0, float(low) - betas[-1])


def filtered(times, x: np.ndarray, degree: int, low: float, cut: float, top: float, locked: np.ndarray) -> np.ndarray:
    """Chebyshev polynomial of the covariance times ``x``: at most about 1 on [low, cut], growing above, scaled to 1 at ``top``.

    Locked directions lie far above and are taken out after each step, before rounding errors along them can grow.
    """
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - middle)

    def free(y: np.ndarray) -> np.ndarray:
        return y - locked @ (locked.T @ y)

    y = free((times(x) - middle * x) * (first / half))
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        x, y = y, free((times(y) - middle * y) * (2 * after / half) - sigma * after * x)
        sigma = after
    return y


def _orthonormal(x: np.ndarray, locked: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = np.linalg.qr(x - locked @ (locked.T @ x))[0]
    return x


def eigenpairs(times, size: int, wanted: int = COMPONENTS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The highest eigenvalues (falling) and their unit vectors, certified by residuals at rounding level.

    Converged leading pairs are locked; the filter then only has to spread the others. Raises RuntimeError where ``ROUNDS``
    rounds don't certify all.
    """
    block, wanted = min(size, wanted + SPARE), min(size, wanted)
    rng = np.random.default_rng(seed)
    locked, active = np.zeros((size, 0)), np.linalg.qr(rng.normal(size=(size, block)))[0]
    low, last, scale = (lowest_bound(times, size) if block < size else 0.0), math.inf, 0.0
    for _ in range(ROUNDS):
        product = times(active)
        values, turn = np.linalg.eigh(active.T @ product)
        values, turn = values[::-1], turn[:, ::-1]
        active, product = active @ turn, product @ turn
        scale = max(scale, float(abs(values[0])))
        rest = wanted - locked.shape[1]
        residuals = np.linalg.norm(product - active * values - locked @ (locked.T @ product), axis=0)[:rest]
        good = 2e-15 * math.sqrt(size) * scale
        open_pairs = np.flatnonzero(residuals > good)
        worst = float(residuals.max())
        if not len(open_pairs) or (worst >= last / 2 and worst <= 50 * good):  # rounding level: small, or nearly and no longer falling
            break
        last = worst
        ready = int(open_pairs[0])
        locked, active, values = np.hstack([locked, active[:, :ready]]), active[:, ready:], values[ready:]
        top, cut = float(values[0]), float(values[-1])
        if cut - low > 1e-12 * scale and top > cut:
            growth = math.acosh(max((top - (cut + low) / 2) / ((cut - low) / 2), 1 + 1e-9))
            active = filtered(times, active, int(min(DEGREE, max(2, math.log(SPREAD) / growth))), low, cut, top, locked)
        else:
            active = times(active)
        active = _orthonormal(active, locked)
    else:
        raise RuntimeError(f"subspace iteration is not certified after {ROUNDS} rounds: residual {last:.3g} of {scale:.3g}")
    whole = np.linalg.qr(np.hstack([locked, active]))[0]  # locked vectors are turned once more against all others
    values, turn = np.linalg.eigh(whole.T @ times(whole))
    values, vectors = values[::-1][:wanted], (whole @ turn[:, ::-1])[:, :wanted]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(wanted)])


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each remaining row and component.

    Which rows remain is told in :func:`integer_rows`. Components are numbered from 1 by falling eigenvalue; those without
    variance (eigenvalue up to 1e-12 of the highest) cannot be whitened and have no rows, so equal vectors alone, a single
    vector or an empty table give no rows. Repeated rows each count and each have their rows; a null id stays null; extra
    columns are left out. A deviation beyond 64 bits ends the job. Every pass reads the checkpointed blocks once; the driver
    holds matrices of the vectors' length times the block.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    fit = integer_rows(rows, id_col, vector_col)
    if fit.n == 0:
        return spark.createDataFrame([], schema)
    values, vectors = eigenpairs(lambda q: covariance_times(fit, q), len(fit.sums), components)
    kept = int((values > 1e-12 * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if kept == 0:
        return spark.createDataFrame([], schema)
    values, turn = values[:kept], vectors[:, :kept] / np.sqrt(values[:kept])

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ turn
        return np.hstack([w.T @ w, w.sum(0)[:, None], np.full((kept, 1), (c * c).sum())])

    found = _summed(fit, moments) / fit.n
    mean = found[:, kept]
    identity_error = float(np.abs(found[:, :kept] - np.outer(mean, mean) - np.eye(kept)).max())
    explained = values / found[0, kept + 1]
    shared = spark.sparkContext.broadcast((fit.n, fit.sums, turn, explained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, turn, explained = shared.value
        k = turn.shape[1]
        for x, (batch, r, at) in _matrices(batches):
            ids = np.frombuffer(batch.column(2)[r].as_py(), "<i8")[at:at + len(x)]
            null = np.frombuffer(batch.column(3)[r].as_py(), np.uint8)[at:at + len(x)].astype(bool)
            centred = n * x - sums
            if float((centred.astype(np.float64) ** 2).sum(1).max()) >= 2.0**63:
                raise OverflowError("a deviation does not fit 64 bits")
            deviation, whitened = (centred * centred).sum(1), centred / n @ turn
            for a in range(0, len(x), 2000):
                b = min(a + 2000, len(x))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[a:b], k), mask=np.repeat(null[a:b], k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b - a)),
                    pa.array(np.full((b - a) * k, n, np.int64)), pa.array(np.repeat(deviation[a:b], k)), pa.array(whitened[a:b].ravel()),
                    pa.array(np.tile(explained, b - a)), pa.array(np.full((b - a) * k, identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.blocks.mapInArrow(run, schema)
