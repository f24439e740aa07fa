"""Vector search in cells against the exact search."""

import numpy as np
from pyspark.sql import functions as F

from umbra.operators import cells as V
from umbra.operators import retrieve as R

KIND = "id long, embedding array<double>"


def asked(rows, ids):
    return rows.where(F.col("id").isin(ids)).select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding"))


def found(df):
    return sorted((r.q_id, r.rank, r.id, r.similarity) for r in df.collect())


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(40, 16)) * 4
    rows = spark.createDataFrame([(i, [float(x) for x in heads[i % 40] + rng.normal(size=16) * 0.6]) for i in range(3000)], KIND)
    index = V.build(rows, str(tmp_path / "cells"), 32, 10, 0.95)
    queries = asked(rows, list(range(0, 3000, 100)))
    exact = R.nearest(queries, rows, 10)
    assert index.probes <= 8 and V.recall(index.nearest(queries, 10), exact) >= 0.9
    assert index.rows(spark).count() == 3000 and 10 < index.rows(spark).select("cell").distinct().count() <= 32
    assert found(index.nearest(queries, 10, 32)) == found(exact)


def test_many_queries_meet_slices_of_cells(spark, tmp_path, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = V.build(rows, str(tmp_path / "cells"), 8, 3, 0.9)
    queries = asked(rows, list(range(0, 500, 50)))
    few = found(index.nearest(queries, 3, 3))
    monkeypatch.setattr(R, "QUERY_ROWS", 2)
    assert found(index.nearest(queries, 3, 3)) == few and few
    assert V.recall(index.nearest(queries, 3), R.nearest(queries, rows, 3)) >= 0.9


def test_cells_are_met_by_products_and_not_by_pairs(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = V.build(rows, str(tmp_path / "cells"), 8, 3, 0.9)
    plan = index.nearest(asked(rows, [0, 100]), 3, 3)._jdf.queryExecution().toString()
    assert index.count == rows.count() and "cogroup" in plan.lower() and "BroadcastHashJoin" not in plan


def test_vectors_without_direction(spark, tmp_path):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0]), (6, []), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, -2.0]), (9, [0.1, 0.1])]
    rows = spark.createDataFrame(odd, KIND)
    index = V.build(rows.where("id <> 5"), str(tmp_path / "cells"), 3, 2)
    assert {r.id: r.cell for r in index.rows(spark).collect() if r.cell < 0} == {i: -1 for i in (1, 2, 3, 4, 6)}
    assert [r.id for r in index.nearest(asked(rows, [8]), 1, 1).collect()] == [8]
    empty = V.build(rows.limit(0), str(tmp_path / "none"), 3)
    assert empty.nearest(asked(rows, [7]), 2).count() == 0
