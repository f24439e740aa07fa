"""Work on rows of derived inputs is dealt to tasks, whatever files the base tables are cut into."""

import pytest
from pyspark.sql import functions as F

from umbra.catalog import QUERIES
from umbra.functions.text import held
from umbra.operators import detect as D

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pii_detect_all", "pii_chain", "pii_units", "names_repeated", "phone_methods", "scan_rollup", "scan_status", "mask_lines"])
def test_texts_are_searched_behind_the_dealing(spark, name):
    *_, above, below = _plan(QUERIES[name](spark, FOLDER)).split("REPARTITION_BY_NUM")
    assert "regexp" in above.lower() and "regexp" not in below.lower()


def test_lines_of_equal_rows_and_of_no_text(spark):
    df = spark.createDataFrame([(1, " a@b.com \n x"), (1, " a@b.com \n x"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in D.mask_lines(df, ("p_em",)).collect() if r.text is not None)
    assert got == [(1, "*******\n x"), (1, "*******\n x"), (3, "")] and D.mask_lines(df).where("text is null").count() == 1


def test_a_value_is_held(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = df.orderBy("id").select(held(F.upper("text"), lambda x: F.concat(x, x)).alias("t")).collect()
    assert [r.t for r in got] == ["ABAB", None]
