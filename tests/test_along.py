"""Two-level scans against plain windows, and the operators that use them with documents of many pieces."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.operators import along as A
from umbra.operators import detect as D
from umbra.operators import ingest as I

ROWS = "k string, at long, v long, w string"


def table(spark, n):
    dice = random.Random(n)
    rows = [(dice.choice(["a", "b", None]), i + dice.choice([0, 0, 0, 5000]), dice.choice([None, 0, 1, 3, -2]), dice.choice([None, "x", "y"])) for i in range(n)]
    rows += [("b", None, 4, "none"), ("far", 999_999, 1, "z"), ("below", -70, 1, "p"), ("below", -1, 2, "q"), ("below", 3, None, None)]
    return spark.createDataFrame(list({(r[0], r[1]): r for r in rows}.values()), ROWS)


def all_of(rows, way):
    rows = way.before(rows, "before", F.col("w"))
    rows = way.total(rows, "total", F.col("v"))
    return way.most(rows, "most", F.col("v"))


def key(df):
    return sorted((repr(tuple(r)) for r in df.select("k", "at", "v", "w", "before", "total", "most").collect()))


@pytest.mark.parametrize("size", [1, 7, 100, 10**9])
def test_pieces_equal_plain_windows(spark, size):
    rows = table(spark, 400)
    by = W.partitionBy("k").orderBy("at")
    plain = rows.withColumns({"before": F.lag("w").over(by), "total": F.sum(F.coalesce("v", F.lit(0))).over(by), "most": F.max("v").over(by)})
    got = A.along(rows, "k", ["at"], all_of, size)
    assert key(got) == key(plain) and "_piece" not in got.columns


def test_empty_rows(spark):
    assert A.along(spark.createDataFrame([], ROWS), "k", ["at"], all_of, 3).count() == 0


def test_only_long_groups_are_cut_into_pieces(spark):
    rows = spark.createDataFrame([("a", i, 1, "x") for i in range(30)] + [("b", i, 1, "x") for i in range(3)], ROWS)
    seen = []
    A.along(rows, "k", ["at"], lambda x, way: seen.append((way.pieces, sorted({r.k for r in x.collect()}))) or x, 10)
    assert seen == [(False, ["b"]), (True, ["a"])]


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_operators_on_long_documents(spark, monkeypatch):
    dice = random.Random(8)
    lines = ["Ends here.", "goes on", "and on", "", "제3조 (Name)", "제 4 조의 2", "가나다", "1. item", None, "x)"]
    docs = spark.createDataFrame([(d, i, dice.choice(lines)) for d, n in ((1, 400), (2, 5), (None, 90)) for i in range(n)], "doc_id long, ord long, line string")
    sheets = docs.select("doc_id", F.col("ord").alias("page"), F.concat_ws("\n", "line", F.lit("① part"), "line").alias("text"))
    tokens = spark.createDataFrame([(u, i, i * 3, i * 3 + 2, dice.choice(["O", "B-a", "I-a", "I-b"]), 0.5) for u, n in ((1, 300), (2, 4)) for i in range(n)], "unit long, ord long, s long, e long, tag string, prob double")
    run = lambda: [rows_of(x) for x in (I.soft_breaks(docs), I.article_chunks(docs, "doc_id"), I.law_chunks(sheets), D.bio_spans(tokens))]
    whole = run()
    monkeypatch.setattr(A, "PIECE", 16)
    monkeypatch.setattr(I, "PAGES", 9)
    monkeypatch.setattr(D, "CHARACTERS", 50)
    assert run() == whole and all(whole)
