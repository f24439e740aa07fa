"""The stored word index against the search that reads texts."""

import random

from pyspark.sql import functions as F

from umbra.operators import postings as P
from umbra.operators import retrieve as R

TEXT, QUERY = "id long, text string", "q_id long, q_text string"


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def corpus(n, seed):
    """Texts of few words with like lengths, and some that hold the words far more often."""
    dice = random.Random(seed)
    return [(i, " ".join(dice.choice("aa bb cc dd ee ff gg x y z".split()) for _ in range(300 if i % 97 == 0 else dice.randint(1, 12)))) for i in range(n)]


QUERIES = [(1, "aa"), (2, "aa bb"), (3, "BB cc, dd"), (4, "aa nothing"), (5, ""), (6, None), (7, "gg gg ff"), (8, "a_b"), (9, "aa bb cc dd ee")]


def test_same_rows_and_ranks_as_from_texts(spark, tmp_path):
    odd = [(9001, None), (9002, ""), (9003, "... !"), (None, "aa bb"), (9004, "aa bb"), (9004, "aa bb"), (9005, "A_B é É aa"), (9006, "aa " * 20_000 + "bb")]
    rows, queries = spark.createDataFrame(corpus(800, 3) + odd, TEXT), spark.createDataFrame(QUERIES, QUERY)
    index = P.build(rows, str(tmp_path / "words"), slice_rows=40, parts=4)
    text = R.ranked(queries, rows)
    key = lambda df: sorted((r.q_id, -1 if r.id is None else r.id, r.n_hits, r.text_rank) for r in df.collect())
    assert key(index.ranked(queries)) == key(text)
    assert index.matching(queries).count() == text.count()
    known = index.top(queries, 5).where("id is not null")
    assert found(known, "q_id", "id", "text_rank", "rank") == found(R.top(text, "text_rank", 5).where("id is not null"), "q_id", "id", "text_rank", "rank")


def test_common_words_have_many_blocks_of_bounded_size(spark, tmp_path):
    index = P.build(spark.createDataFrame(corpus(800, 4), TEXT), str(tmp_path / "words"), slice_rows=40, parts=4)
    blocks = index.blocks(spark)
    assert blocks.groupBy("word", "slice").count().where("count > 1").count() == 0
    wide = blocks.where("word = 'aa'").agg(F.count("*"), F.max(F.size("postings"))).head()
    assert wide[0] >= 10 and wide[1] <= 2 * 40


def test_slices_that_can_not_be_among_the_best_are_not_read(spark, tmp_path, monkeypatch):
    rows, queries = spark.createDataFrame(corpus(2000, 5), TEXT), spark.createDataFrame([(1, "aa bb"), (2, "cc")], QUERY)
    index = P.build(rows, str(tmp_path / "words"), slice_rows=20, parts=2)
    asked = index._asked(queries)
    read, met = [], P.WordIndex._met
    monkeypatch.setattr(P, "HEADS", 2)
    monkeypatch.setattr(P.WordIndex, "_met", lambda self, a, pairs=None: read.append(pairs.count()) or met(self, a, pairs))
    best = found(index.top(queries, 3), "q_id", "id", "text_rank", "rank")
    assert best == found(R.top(R.ranked(queries, rows), "text_rank", 3), "q_id", "id", "text_rank", "rank")
    assert 0 < sum(read) < index._live(asked).count() / 4


def test_bounds_hold_for_every_row(spark, tmp_path):
    rows, queries = spark.createDataFrame(corpus(600, 6), TEXT), spark.createDataFrame(QUERIES, QUERY)
    index = P.build(rows, str(tmp_path / "words"), slice_rows=1, parts=2)
    of, _ = P._slices(rows, 1, 0)
    ranks = index.ranked(queries).join(rows.select("id", of.alias("slice")), "id").join(index._live(index._asked(queries)), ["q_id", "slice"], "left")
    assert ranks.count() > 500 and ranks.where("bound is null or text_rank > bound").count() == 0


def test_added_rows_and_an_index_opened_again(spark, tmp_path):
    rows, queries = spark.createDataFrame(corpus(400, 7), TEXT), spark.createDataFrame(QUERIES, QUERY)
    path = str(tmp_path / "words")
    P.build(rows.where("id < 300"), path, slice_rows=50, parts=3)
    index = P.opened(spark, path, 3).add(rows.where("id >= 300"), slice_rows=50)
    assert index.free == P.opened(spark, path, 3).free
    assert found(index.top(queries, 4), "q_id", "id", "text_rank", "rank") == found(R.top(R.ranked(queries, rows), "text_rank", 4), "q_id", "id", "text_rank", "rank")


def test_empty_corpus_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], TEXT)
    index = P.build(none, str(tmp_path / "none"))
    assert index.top(spark.createDataFrame(QUERIES, QUERY), 3).count() == 0
    full = P.build(spark.createDataFrame([(1, "aa")], TEXT), str(tmp_path / "one"))
    assert full.ranked(spark.createDataFrame([], QUERY)).count() == 0 and full.free == 1


def test_words_are_shuffled_in_blocks_and_texts_once(spark, tmp_path):
    """Before, each word of each text was a row of two shuffles when the index was built, and again when it was read."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(40))) for i in range(600)]
    corpus, queries = spark.createDataFrame(rows, TEXT), spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 2}") for q in range(20)], QUERY)
    tracker = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: sum(s.shuffleWriteRecords() for i in range(stages().size()) for s in [stages().apply(i)])
    before = written()
    index = P.build(corpus, str(tmp_path / "words"), slice_rows=100, parts=4)
    built = written()
    assert built - before < 4 * len(rows)
    best = index.top(queries, 3)
    assert written() - built < 8 * len(rows)
    assert found(best, "q_id", "id", "text_rank", "rank") == found(R.top(R.ranked(queries, corpus), "text_rank", 3), "q_id", "id", "text_rank", "rank")


def test_rows_of_one_id_are_one_row_whatever_their_lengths(spark, tmp_path):
    """Before, rows of an id that lay in two slices were lost."""
    odd = [(7001, "aa x"), (7001, "bb cc " * 40), (7001, None), (None, "gg"), (None, "ff " * 30), (7002, "dd " * 9)]
    rows = spark.createDataFrame(corpus(300, 8) + odd, TEXT)
    queries = spark.createDataFrame([*QUERIES, (10, "x cc"), (11, "ff gg")], QUERY)
    index, text = P.build(rows, str(tmp_path / "words"), slice_rows=30, parts=3), R.ranked(queries, rows)
    key = lambda df: sorted((r.q_id, -1 if r.id is None else r.id, r.n_hits, r.text_rank) for r in df.collect())
    assert key(index.ranked(queries)) == key(text) and text.where("id = 7001 and q_id = 10").count() == 1
    assert key(index.top(queries, 400)) == key(text)


def test_many_queries_read_a_slice_in_turns_and_without_a_broadcast_of_slices(spark, tmp_path, monkeypatch):
    rows, queries = spark.createDataFrame(corpus(500, 9), TEXT), spark.createDataFrame(QUERIES, QUERY)
    index = P.build(rows, str(tmp_path / "words"), slice_rows=50, parts=3)
    want = found(R.top(R.ranked(queries, rows), "text_rank", 4), "q_id", "id", "n_hits", "text_rank", "rank")
    monkeypatch.setattr(P, "TURN_QUERIES", 2)
    assert found(index.top(queries, 4), "q_id", "id", "n_hits", "text_rank", "rank") == want
    monkeypatch.setattr(P, "READ_SLICES", 0)
    assert found(index.top(queries, 4), "q_id", "id", "n_hits", "text_rank", "rank") == want


def test_long_rows_have_slices_of_fewer_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SLICE_CHARS", 20_000)
    rows = spark.createDataFrame([(i, "aa bb " * (500 if i % 2 else 1)) for i in range(200)], TEXT)
    blocks = P.build(rows, str(tmp_path / "words"), parts=2).blocks(spark).where("word = 'aa'").collect()
    assert sum(b.rows for b in blocks) == 200 and max(b.rows for b in blocks if b.most == 500) < 30 and max(b.rows for b in blocks if b.most == 1) == 100


def test_tasks_get_slices_in_turn(spark):
    rows = spark.range(300).withColumn("key", P._task(spark, "id", 13)).repartition(13, "key")
    each = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(each) == 13 and max(r["count"] for r in each) == 24
