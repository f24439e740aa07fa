"""Whitening of embeddings from an exact integer scatter matrix.

Every usable entry c becomes the integer floor(256 * c). The distinct integer vectors are
the fit list. Tasks subtract one shift vector, and add up sums and cross-products of their part
of the list without rounding: entries are cut into limbs so small that products of whole
blocks stay below 2^53, where float matrix products are exact, and the blocks' products are
joined with integers of any length. The parts of each limb are added up by Spark; the driver gets
a table of dimensions squared, forms n * X'X - S S' in integers, converts it to
float once, correctly rounded, and decomposes it (numpy's eigh).

Rows are left out if their vector is null, is empty, holds a null or non-finite entry or one
whose integer takes over 62 bits, or has another length than most usable rows have (of equally many, the
longer). Rows with null or repeated ids are each whitened; equal vectors count once in the fit.
A component without variance has whitened 0 and explained 0 (all are, for a single vector). An empty
table, or one without usable rows, gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

SCALE = 256
COMPONENTS = 4
LIMB = 20  # bits of a limb
BLOCK = 1 << 12  # rows of a block: products of two limbs, added up over it, take 2 * 20 + 12 bits
PART = 32  # bits of the parts in which a task's sums go to Spark
EXACT = 1 << 53


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x array<long>) of the rows that are not left out."""
    entry = F.col(vector)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(1 << 62))
    good = rows.where(entry.isNotNull() & (F.size(entry) > 0)).select(F.col(key).alias("id"), entry.cast("array<double>").alias("_c")).where(F.forall("_c", fits))
    lengths = good.groupBy(F.size("_c").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    length = lengths["n"] if lengths else 0
    return good.where(F.size("_c") == length).select("id", F.transform("_c", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list<long> column of rows of one length as a 2-d array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float arrays whose sum, the k-th times 2^(20 k), is x; all but the last are not negative."""
    out = []
    while True:
        if np.abs(x, dtype=np.float64).max(initial=0) < 1 << LIMB:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB


def scatter(blocks: Iterator[np.ndarray], shift: np.ndarray) -> np.ndarray:
    """Integers (numpy objects) of shape (d + 1, d + 1): Z'Z of all rows z = (x - shift, 1) of the blocks, exact."""
    d = len(shift)
    total = np.zeros((d + 1, d + 1), dtype=object)
    for x in blocks:
        for a in range(0, len(x), BLOCK):
            z = np.hstack([x[a : a + BLOCK] - shift, np.ones((len(x[a : a + BLOCK]), 1), np.int64)])
            limbs = _limbs(z)
            for i, p in enumerate(limbs):
                for j, q in enumerate(limbs):
                    total += (p.T @ q).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _parts(shift: list[int]):
    """Rows (cell, part, value) of a task's upper triangle; values of all parts, the k-th times 2^(32 k), add up to a cell's integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = scatter((matrix(b.column("x")) for b in batches), np.array(shift, np.int64))
        cells, parts, values = [], [], []
        for cell, (i, j) in enumerate(zip(*np.triu_indices(len(shift) + 1))):
            v, k = int(total[i, j]), 0
            while v:
                low, more = (v, 0) if -(1 << PART) <= v < 1 << PART else (v & ((1 << PART) - 1), v >> PART)
                cells.append(cell)
                parts.append(k)
                values.append(low)
                v, k = more, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(parts, pa.int32()), pa.array(values, pa.int64())], names=["cell", "part", "value"])

    return run


def exact_scatter(listed: DataFrame, shift: list[int]) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S, and n * X'X - S S' (numpy objects) of the vectors x of a table, as integers."""
    d = len(shift)
    rows = listed.mapInArrow(_parts(shift), "cell int, part int, value long").groupBy("cell", "part").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((d + 1, d + 1), dtype=object)
    places = list(zip(*np.triu_indices(d + 1)))
    for r in rows:
        total[places[r.cell]] += r.value << PART * r.part
    total = np.triu(total) + np.triu(total, 1).T
    n, sums = int(total[d, d]), total[:d, d]
    centred = n * total[:d, :d] - np.outer(sums, sums)  # the same for every shift
    return n, [int(s) + n * int(c) for s, c in zip(sums, shift)], centred


class Fit:
    """Components of a fit list, numbered by falling eigenvalue, and how vectors are put on them."""

    def __init__(self, n: int, sums: list[int], centred: np.ndarray, components: int):
        d = len(sums)
        self.n, self.sums = n, sums
        covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], dtype=float)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = sum(int(centred[i, i]) for i in range(d)) / (n * n)
        kept = np.where(values > d * np.finfo(float).eps * max(values[0], 0), values, 0)[:components]
        self.explained = kept / trace if trace else np.zeros(len(kept))
        self.turn = vectors[:, :components] * np.where(kept > 0, 1 / np.sqrt(np.where(kept > 0, kept, 1)), 0)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, and its squares summed over the dimensions, as integers: of 64 bits where these hold them, else of any length."""
        most = max(int(np.abs(x, dtype=np.float64).max(initial=0)) * 2 * self.n, 2 * max(map(abs, self.sums)))
        kind = np.int64 if 2 * most * most * len(self.sums) < 1 << 62 else object
        far = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return far, (far * far).sum(axis=1)

    def whitened(self, far: np.ndarray) -> np.ndarray:
        return np.array(far / self.n, dtype=float) @ self.turn


def _moments(fit: Fit):
    """Sums and cross-products of a task's whitened, centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.turn.shape[1]
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y = fit.whitened(fit.deviations(matrix(b.column("x")))[0])
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    return run


def identity_error(listed: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = fit.turn.shape[1]
    total = np.zeros((k + 1) ** 2)
    for r in listed.mapInArrow(_moments(fit), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r.cell] = r.value
    total = total.reshape(k + 1, k + 1) / fit.n
    mean = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _projected(fit: Fit, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.turn.shape[1]
        for b in batches:
            far, square = fit.deviations(matrix(b.column("x")))
            rows, m = np.repeat(np.arange(len(far)), k), len(far)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), pa.array([int(s) for s in square[rows]], pa.int64()),
                 pa.array(fit.whitened(far).ravel()), pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): every usable row on each of the first components.

    deviation is the exact sum of squares of n * x - S over the dimensions; one that takes more than 63 bits ends the job with an error.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = usable(rows, key, vector)
    listed = written(good.select("x").distinct())
    first = listed.head()
    if first is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    fit = Fit(*exact_scatter(listed, list(first.x)), components)
    error = identity_error(listed, fit)
    forget(listed)
    return good.mapInArrow(_projected(fit, error), schema).withColumnRenamed("id", key)
