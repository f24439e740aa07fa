"""Vector search in cells: an inverted file of vectors, so that a query meets a few cells and not all rows.

Centres are trained on a sample of at most TRAIN_ROWS rows, the ones with the lowest hash of their
id. Every row is indexed, in the cell of its nearest centre; cells are partitions of a table. A query
looks into the cells of its nearest centres, and rows met there get their exact similarity,
as in retrieve.nearest: with all cells probed the result is the exact one. How many cells to probe is measured: the least number,
doubling, with which a sample of queries finds the wanted share of what the exact search finds.

Vectors that are null, of another length, or without direction (zero, or with entries that are not finite) are indexed in cell -1,
which is looked into only when all cells are. An empty corpus has one cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import cut
from . import retrieve as R

TRAIN_ROWS, TURNS = 20_000, 12
PROBE_ROWS = 200  # queries with which the number of probes is measured
SLICE_ROWS = 80_000  # rows in a slice of all cells, so at most as many in a slice of one


def _directions(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of a column's vectors that have a direction, and the width given or the first one's."""
    rows, at = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or None in v or not v or (width is not None and len(v) != width):
            continue
        width = len(v)
        x = np.asarray(v, float)
        norm = np.linalg.norm(x)
        if np.isfinite(norm) and norm > 0:
            rows.append(x / norm)
            at.append(i)
    return np.array(at, np.int64), np.array(rows).reshape(len(rows), width or 0)


def trained(corpus: DataFrame, cells: int, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Unit centres of at most so many cells, by rounds of assigning and averaging over the sample."""
    n = corpus.count()
    least, step = -(1 << 63), (1 << 64) // max(n, 1)
    sample = corpus if n <= rows else corpus.where(F.xxhash64("id") <= int(least + step * rows * 2))
    vectors = sample.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(rows).select("embedding").toPandas()["embedding"]
    _, x = _directions(pa.array([None if v is None else list(v) for v in vectors], pa.list_(pa.float64())))
    if not len(x):
        return np.zeros((1, 0))
    centres = np.unique(x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)], axis=0)
    for _ in range(TURNS):
        near = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)  # an empty cell keeps its centre
    return centres


def _in_cells(centres: np.ndarray, column: str, probes: int):
    """Rows with cell: the nearest centre's, once for each of the nearest probes; -1 for vectors without a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _directions(batch.column(column), centres.shape[1])
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes] if len(at) else np.zeros((0, probes), int)
            rest = np.setdiff1d(np.arange(batch.num_rows), at)
            rows = np.concatenate([np.repeat(at, near.shape[1]), rest])
            cell = np.concatenate([near.ravel(), np.full(len(rest), -1)]).astype(np.int32)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def in_cells(rows: DataFrame, centres: np.ndarray, column: str, probes: int = 1) -> DataFrame:
    return rows.mapInArrow(_in_cells(centres, column, probes), StructType([*rows.schema.fields, StructField("cell", IntegerType())]))


@dataclass(frozen=True)
class Cells:
    """A stored index: the folder of its rows (id, embedding) by cell, its centres, the probes that it is asked with, and the number of its rows."""

    path: str
    schema: StructType
    centres: np.ndarray
    probes: int
    count: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(q_id, id, similarity, rank), as retrieve.nearest but for rows outside of the probed cells."""
        spark = queries.sparkSession
        probes = min(probes or self.probes, len(self.centres))
        rows = self.rows(spark)
        if probes == len(self.centres):
            return R.nearest(queries, rows.select("id", "embedding"), k)
        asked = in_cells(queries.select("q_id", "q_embedding"), self.centres, "q_embedding", probes)
        slices = -(-self.count // SLICE_ROWS) or 1
        turns = -(-queries.count() // R.QUERY_ROWS) or 1
        rows = R.each_part(R.dealt(rows.where("cell >= 0"), "id", "_slice", slices), "_turn", turns)
        asked = R.each_part(R.dealt(asked, "q_id", "_turn", turns), "_slice", slices)
        return R.best_in_groups(rows, asked, ["cell", "_slice", "_turn"], k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact search's rows (q_id, id) that were found; 1 if there are none."""
    hits = exact.select("q_id", "id").join(found.select("q_id", "id").withColumn("_hit", F.lit(1)), ["q_id", "id"], "left")
    n, hit = hits.agg(F.count("*"), F.count("_hit")).head()
    return hit / n if n else 1.0


def build(corpus: DataFrame, path: str, cells: int, k: int = 10, least: float = 0.95) -> Cells:
    """An index of all rows of corpus (id, embedding) in the folder path, asked with as many probes as PROBE_ROWS of its rows need to find the share least of the exact k nearest."""
    centres = trained(corpus, cells)
    placed = in_cells(corpus.select("id", "embedding"), centres, "embedding")
    placed.write.mode("overwrite").partitionBy("cell").parquet(path)
    index = Cells(path, placed.schema, centres, 1, corpus.sparkSession.read.schema(placed.schema).parquet(path).count())
    rows = index.rows(corpus.sparkSession)
    some = rows.where("cell >= 0").orderBy(F.xxhash64("id")).limit(PROBE_ROWS).select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    some, exact = cut(some), cut(R.nearest(some, rows.select("id", "embedding"), k))
    probes = 1
    while probes < len(centres) and recall(index.nearest(some, k, probes), exact) < least:
        probes = min(2 * probes, len(centres))
    return replace(index, probes=probes)
