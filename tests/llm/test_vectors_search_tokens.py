"""Whitening, ranked search and token counts against brute force, and on rows that are odd on purpose."""

import random
import re
import unicodedata
from collections import Counter
from fractions import Fraction
from math import floor, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import queries as Q, ranked_search, sql
from umbra.llm.ranked_search import Asked, ranked_documents, term_counts
from umbra.llm.token_counts import Merges, token_counts
from umbra.llm.whitening import scatter, whitened

FOLDER = "/root/testdata/sf0.001"
CLASHING = ("n", "term", "row", "item", "x", "n_tokens", "component")
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crowded(df):
    """df with columns whose names clash with those of results."""
    return df.withColumns({c: F.lit("?") for c in CLASHING})


# Whitening


def exact_fit(vectors):
    """n, sums and the covariance as fractions, from the definition."""
    listed = sorted({tuple(floor(256 * c) for c in v) for v in vectors})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    far = [[n * c - s for c, s in zip(v, sums)] for v in listed]
    d = len(sums)
    return n, sums, [[Fraction(sum(r[i] * r[j] for r in far), n**3) for j in range(d)] for i in range(d)]


def test_whitened_rows(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(120)
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in rows.collect()}
    n, sums, covariance = exact_fit(vectors.values())
    values, turn = np.linalg.eigh(np.array([[float(c) for c in r] for r in covariance]))
    got = whitened(crowded(rows)).collect()
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    trace = float(sum(covariance[i][i] for i in range(len(sums))))
    sides = {}
    for r in got:
        far = [n * floor(256 * c) - s for c, s in zip(vectors[r.vec_id], sums)]
        assert r.deviation == sum(c * c for c in far)
        want = np.array([c / n for c in far]) @ turn[:, -r.component] / np.sqrt(values[-r.component])
        assert abs(abs(want) - abs(r.whitened)) < 1e-8
        sides.setdefault(r.component, set()).add(np.sign(want * r.whitened))
        assert abs(r.explained - values[-r.component] / trace) < 1e-9
    assert all(len(s - {0.0}) == 1 for s in sides.values())


def test_scatter_is_exact_for_any_size_and_shift():
    rng = random.Random(3)
    for bits in (3, 19, 20, 40, 61):
        rows = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)]
        shift = rows[7]
        z = [[a - b for a, b in zip(r, shift)] + [1] for r in rows]
        got = scatter(iter([np.array(rows[:20]), np.array(rows[20:])]), np.array(shift))
        assert got.tolist() == [[sum(r[i] * r[j] for r in z) for j in range(4)] for i in range(4)]


def test_large_offsets_keep_their_differences(spark):
    """Entries near 2^40 that differ by one: float sums of squares would lose all of it."""
    rows = spark.createDataFrame([(i, [float(1 << 32) + k / 256, float(1 << 32) - (k * k % 5) / 256]) for i, k in enumerate(range(12))], "vec_id long, embedding array<double>")
    n, _, covariance = exact_fit([r.embedding for r in rows.collect()])
    values = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in covariance]))
    got = whitened(rows).collect()
    assert {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    assert abs({r.component: r.explained for r in got}[1] - values[-1] / values.sum()) < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, nan]), (3, [1.0, None]), (4, [0.5, -0.0]), (4, [0.5, 0.0]), (None, [-0.25, 3.0]), (6, [1.0]), (7, []), (8, [inf, 1.0]), (9, [1e300, 1.0])]
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = whitened(rows).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (4, 1), (4, 1), (4, 2), (4, 2)]
    assert {r.n for r in got} == {2} and {r.whitened for r in got if r.component == 2} == {0.0}
    single = whitened(rows.where("vec_id = 4")).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained) for r in single} == {(1, 0, 0.0, 0.0)}
    assert whitened(rows.limit(0)).collect() == [] and whitened(rows.where("vec_id = 1")).collect() == []


# Ranked search


def ranks(docs, items, k=10):
    """The ranking from its definition; docs: (doc_id, text) rows, items: (item_id, text) rows."""
    held = [(d, Counter(WORD.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total = sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 10 + 90 * c.total() * len(held) // total
            s = sum(floor(1000 * log((2 * len(held) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(WORD.findall((text or "").translate(LOWER))) if w in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_ranked_as_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = in_order(Q.op12_tput_search(spark, FOLDER).collect())
    assert got == in_order(duck.execute(sql.RANKED).fetchall())
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert got == in_order(ranks([(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()], items))


def test_ranked_odd_rows(spark, monkeypatch):
    """Ties, repeated rows and ids, null texts, odd signs; lists over several partitions, rows over several ranges, items in several blocks."""
    for name, value in (("LIST_ROWS", 5), ("RANGE_POSTINGS", 40), ("BLOCK_TERMS", 4), ("CUT", 9), ("FEW_ROWS", 3)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["ÄÖ", "äö", "x_y", "MiXed", "mixed"]
    texts = [None, "", "?! ", *(" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(1, 30))) for _ in range(60))]
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3 + [(100 + i, "w11 w11 mixed") for i in range(25)] + [(200, "w11 " * 400)]
    items = [(1, "w0 w1 W2, w3"), (1, "mixed"), (2, None), (3, "..."), (4, "nowhere"), (5, "w11 Mixed äö ÄÖ x w0"), (None, "w5 w5 w6"), (7, " ".join(words))]
    d = crowded(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    q = crowded(spark.createDataFrame(items, "item_id long, text string"))
    assert in_order(ranked_documents(d, q).collect()) == in_order(ranks(docs, items))
    assert in_order(ranked_documents(d, q, 1).collect()) == in_order(ranks(docs, items, 1))
    assert ranked_documents(d.limit(0), q).collect() == [] and ranked_documents(d, q.limit(0)).collect() == []


def test_threshold_is_the_largest_safe_one():
    asked = Asked([np.array([0, 1, 2])], np.array([100, 7, 3]))
    for least in (1, 2, 11, 60, 109, 110):
        t = asked.threshold(0, least)
        assert int(asked.bound(0, t).sum()) < least
        assert t == 100 or int(asked.bound(0, t + 1).sum()) >= least


def test_terms_of_long_texts(monkeypatch):
    text = ("Alpha beta-GAMMA é1 " * 50).encode()
    whole = term_counts(text)
    monkeypatch.setattr(ranked_search, "CUT", 7)
    assert term_counts(text) == whole == {b"alpha": 50, b"beta": 50, b"gamma": 50, "é1".encode(): 50}


# Token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path())


def test_counts_as_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = Q.op13_heap_token_counts(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_odd_texts(library, monkeypatch):
    monkeypatch.setattr("umbra.llm.token_counts.CUT", 11)
    monkeypatch.setattr("umbra.llm.token_counts.KNOWN", 50)
    merges, rng = Merges(Q.tokenizer_path()), random.Random(1)
    parts = ["a", "B", "'s", "'", "ll", " ", "  ", "\n", "\t", "é", " ", "\x1c", "\x85", "\x00", "7", "٣", "<|endoftext|>", "<|end", "\U0001f600", "한", "　", "x" * 50, chr(0x558), chr(0x2D), "é", "Ġ", "ing", "the"]
    for text in ("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)):
        assert merges.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_splits_every_sign_as_the_library(library):
    merges = Merges(Q.tokenizer_path())
    some = [*range(1, 0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 97)]
    for c in (chr(c) for c in some):
        text = f"a{c}1{c}? {c}{c} b\n{c}"
        assert merges.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], (c, unicodedata.name(c, "?"))


def test_counts_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "one"), (2, "two words"), (2, "two words"), (3, "ab" * 20000), (4, "x" * 30000 + " " * 3000 + "y")]
    docs = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((d or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(docs, Q.tokenizer_path()).collect()) == want
    assert token_counts(docs.limit(0), Q.tokenizer_path()).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Merges(Q.tokenizer_path("word_bpe_49k.json"))
