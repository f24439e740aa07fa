"""The k best rows of many queries, found in the rows of the texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbra.operators import covers as C
from umbra.operators import retrieve as R

TEXT, QUERY = "id long, text string", "q_id long, q_text string"


def key(df):
    return sorted((r.q_id, r.rank, r.id is not None, r.id or 0, r.n_hits, r.text_rank) for r in df.collect())


def texts(n, seed):
    dice = random.Random(seed)
    vocabulary = "aa bb cc dd ee ff gg hh x y z é ÀÉ a_b 7".split() + [f"w{i}" for i in range(60)]
    return [(i, " ".join(dice.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))], k=400 if i % 50 == 0 else dice.randint(1, 15)))) for i in range(n)]


ODD = [(9001, None), (9002, ""), (9003, "... !"), (None, "aa bb"), (9004, "aa bb x"), (9004, "bb aa"), (9005, "A_B é É aa"), (9006, "aa " * 5000 + "bb"), (9007, "İstanbul ΣΑΣ aa")]
ASKED = [(9101, ""), (9102, None), (9103, "nowhere aa"), (9104, "nowhere"), (9105, "AA aa"), (9106, "bb aa"), (9107, "aa bb"), (None, "aa"), (9108, "İstanbul"), (9109, "é")]


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_k_best_in_rows_are_those_of_all_ranked_rows(spark, monkeypatch, block):
    """Whole texts, single words and odd rows, in one block of queries and in several."""
    monkeypatch.setattr(R, "BLOCK_WORDS", block)
    monkeypatch.setattr(C, "STRIP", 20_000)
    rows = texts(700, 1)
    corpus = spark.createDataFrame(rows + ODD, TEXT).repartition(5)
    queries = spark.createDataFrame([r for r in rows if r[0] % 10 == 0] + [(i + 5000, t.split()[0]) for i, t in rows if i % 7 == 0] + ASKED, QUERY)
    best = R.top(R.ranked(queries, corpus, 4), "text_rank", 4)
    assert key(best) == key(R.top(R.ranked(queries, corpus), "text_rank", 4)) and best.count() > 400


def test_words_of_texts_are_not_shuffled(spark):
    """Before, each word of a text that may match a query was a row of a shuffle."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(40))) for i in range(600)]
    corpus = spark.createDataFrame(rows, TEXT)
    tracker = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteRecords() for i in range(stages().size()) for s in [stages().apply(i)])
    stages = lambda: tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = written()
    best = R.ranked(corpus.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("text").alias("q_text")), corpus, 10)
    assert sorted((r.q_id, r.id, r.n_hits) for r in best.collect()) == [(q, i, 40) for q in range(0, 600, 100) for i in range(10)]
    assert written() - before < 5 * len(rows)


def test_ids_of_other_kinds(spark):
    for kind, cast in (("string", str), ("int", int)):
        corpus = spark.createDataFrame([(cast(i), "aa bb") for i in range(30)], f"id {kind}, text string")
        queries = spark.createDataFrame([(1, "aa"), (2, "bb aa")], QUERY)
        best = R.ranked(queries, corpus, 3)
        assert best.schema["id"].dataType == corpus.schema["id"].dataType
        assert sorted((r.q_id, r.id) for r in best.collect()) == [(q, i) for q in (1, 2) for i in sorted(cast(i) for i in range(30))[:3]]


def test_no_queries_and_no_texts(spark):
    none, no_queries = spark.createDataFrame([], TEXT), spark.createDataFrame([], QUERY)
    some = spark.createDataFrame([(1, "aa")], TEXT)
    assert R.ranked(no_queries, some, 3).count() == 0 and R.ranked(spark.createDataFrame([(1, "aa")], QUERY), none, 3).count() == 0


def test_long_texts_take_time_in_proportion():
    """Before, each occurrence went through all words of the query: 400,000,000 steps here."""
    n = 20_000
    assert C.cover_rank(list(range(n)), list(range(n)), n) == C.COVER
    assert C.rounded(C.cover_rank([0, 1, 0, 1], [0, 1, 3, 6], 2)) == C.rounded(0.1 + 0.1 / 2 + 0.1 / 3)


def test_words_are_packed_by_how_few_queries_ask_for_them():
    asked = C.packed(pa.array([b"p", b"q", b"r"]), pa.array([["a", "b", "c"], ["a", "b"], ["a"]]))
    words = asked.words.to_pylist()
    assert [words[w] for w in asked.rare[0]] == ["b", "a", "a"] and [words[w] for w in asked.rare[1]] == ["a", "a", "a"]
    assert {words[w]: asked.order[asked.upto[w] : asked.upto[w + 1]].tolist() for w in range(3)} == {"a": [], "b": [1], "c": [0]}
    assert asked.alone.tolist() == [2 if w == "a" else -1 for w in words]
