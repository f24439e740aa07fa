"""Counters of removed noise, first keys of plain values, stretches without tones, orders."""

import re

import pytest
from pyspark.sql import functions as F

from umbra.operators import govern as G
from umbra.operators import ingest as I
from umbra.operators import media as M
from umbra.operators import retrieve as R

LONG = "a line of ninety characters that is repeated on pages, " + "x" * 35
BLOCKS = [  # doc_id, page, y0, y1, text
    *[(1, p, 0.0, 1.0, "Head") for p in (1, 2, 5, 9)], *[(1, p, 10.0, 11.0, "Again  and") for p in (1, 2, 5, 9)], *[(1, p, 12.0, 13.0, "제3조") for p in (1, 2, 5, 9)],
    *[(1, p, 14.0, 15.0, LONG) for p in (5, 9)], (1, 2, 12.0, 13.0, "again and"), (1, 2, 99.0, 100.0, "- 2 -"), (1, 9, 40.0, 41.0, "once"), (1, 9, 41.0, 42.0, ""),
    (2, 7, 50.0, 51.0, "alone"), (2, 7, None, 51.0, "placeless"), (3, 1, 0.0, 1.0, "only a head"), (4, 1, 50.0, 51.0, None),
]
BLOCK = "doc_id long, page int, y0 double, y1 double, text string"


def by_loops(rows):
    """Seven counters of a document's blocks."""
    plain = lambda t: " ".join((t or "").split()).lower()
    unit = lambda t: re.match("제[0-9]+조", (t or "").strip()) is not None
    least = lambda n: max(2, int(n * 0.35))
    kept = [r for r in rows if r[2] is not None and r[3] > 8 and r[2] < 92]
    on = {}
    for r in kept:
        if plain(r[4]) and not unit(r[4]) and len(plain(r[4])) <= 100:
            on.setdefault(plain(r[4]), set()).add(r[1])
    again = {t for t, pages in on.items() if len(pages) >= least(len({r[1] for r in kept}))}
    stay = [r for r in kept if unit(r[4]) or plain(r[4]) not in again]
    pages = len({r[1] for r in rows})
    return pages, len(rows), len(rows) - len(kept), len(kept), len(again), len(stay), least(pages)


def test_noise_counters_equal_loops(spark):
    rows = spark.createDataFrame(BLOCKS, BLOCK)
    names = ("total_pages", "raw_blocks", "removed_by_position", "kept_after_position", "repeated_text_count", "kept_after_repeat", "repeated_threshold_pages")
    got = {r.doc_id: tuple(r[n] for n in names) for r in I.noise_counters(rows, 100.0).collect()}
    assert got == {d: by_loops([r for r in BLOCKS if r[0] == d]) for d in (1, 2, 3, 4)}
    left = {r.doc_id: r.n for r in I.without_noise(rows, 100.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert left == {d: c[5] for d, c in got.items() if c[5]}
    assert I.noise_counters(rows.limit(0), 100.0).count() == 0


@pytest.mark.parametrize("kind, keys, first", [
    ("double", [2.5, None, float("nan"), 10.0, 1.0], "1,2.5,10"), ("string", ["b", "10", None, "9", "a"], "10,9,a,b"), ("long", [10, None, 9, -1, 3], "-1,3,9,10"), ("decimal(5,1)", None, ""),
])
def test_first_keys_by_kind(spark, kind, keys, first):
    rows = spark.createDataFrame([(k, "v") for k in keys or []] + [(None, None)], f"k {kind}, v string")
    got = G.encryption_summary(rows, "k", "v", F.lit(True)).head()
    assert (got.first_keys, got.total_records, got.status) == (first, len(keys or []), "안되어있음" if keys else "판단불가")


def test_plain_rows_without_keys_leave_a_column_encrypted(spark):
    got = G.encryption_summary(spark.createDataFrame([(None, "v"), (4, "w"), (5, "w")], "k long, v string"), "k", "v", F.col("v") == "v").head()
    assert (got.total_records, got.encrypted_records, got.status, got.first_keys) == (3, 2, "되어있음", "")


def test_stretches_without_tones(spark):
    words = spark.createDataFrame([("a", 1, 1.0, 1.5), ("a", 2, 1.2, 1.3), ("a", 3, 2.0, 2.0), ("b", 1, 9.5, 12.0)], "audio string, ord long, start_time double, end_time double")
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "audio string")
    got = sorted(tuple(r) for r in M.untouched(words, files, 10_000).collect())
    assert got == [("a", 0, 975), ("a", 1325, 10_000), ("b", 0, 9475), ("c", 0, 10_000)]


def test_orders(spark):
    sources = spark.createDataFrame([(1, 1, 0.2), (1, 2, None), (1, 3, 0.9), (1, 4, float("nan")), (1, 5, -0.1), (1, 6, 0.9)], "q_id long, rank int, similarity double")
    assert [r["rank"] for r in R.by_similarity(sources).orderBy("place").collect()] == [3, 6, 1, 2, 4, 5]
    counts = spark.createDataFrame([(1, "PH", 1, 0), (1, "EM", 2, 1), (1, "FACE", 0, 3)], "file long, code string, total_count long, masked_count long")
    assert [c.code for c in M.codes_listed(counts).head().codes] == ["EM", "FACE", "PH"]
