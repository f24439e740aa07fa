"""What is made for prompts, and where in the plan."""

from umbra.catalog import QUERIES


def test_contents_are_made_of_ranked_rows(spark):
    above, below = QUERIES["context_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split(" Window ")
    assert "repeat(" in above and "repeat(" not in below
