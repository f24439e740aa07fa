"""Core operators on nulls, empty texts, ties and empty tables."""

import random

from pyspark.sql import functions as F

from umbra.operators import connections as C
from umbra.operators import detect as D
from umbra.operators import dialogue as G
from umbra.operators import ingest as I
from umbra.operators import media as M
from umbra.operators import retrieve as R
from umbra.operators.faces import faces_followed


def test_detectors_without_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (4, "kim@examplecom 010-1234-5678 010.1.2.3 01012345678")], "doc_id long, text string")
    got = {r.doc_id: [(x.label, x.start, x.text) for x in r.f] if r.f else [] for r in df.select("doc_id", D.found_in(F.col("text")).alias("f")).collect()}
    assert got[1] == got[2] == got[3] == []
    assert got[4] == [("p_em", 0, "kim@example.com"), ("p_ph", 15, "010-1234-5678"), ("p_ip", 29, "010.1.2.3")]
    assert D.entities(df.limit(0)).count() == 0


def test_addresses_of_machines_before_other_signs(spark):
    texts = ["The server is 192.168.0.1.", "10.0.0.1.5", "1234.1.2.3.4.5.6.7", "x300.1.1.1 1.2.3.45678 1.2.3", "v1.2.3.4,9.8.7.6"]
    got = [[x.text for x in r.f] for r in spark.createDataFrame(list(enumerate(texts)), "id long, text string").orderBy("id").select(D.found_in(F.col("text"), ("p_ip",)).alias("f")).collect()]
    assert got == [["192.168.0.1"], ["10.0.0.1"], ["1.2.3.4"], [], ["1.2.3.4", "9.8.7.6"]]


def test_places_of_names_in_one_pass():
    assert D.places_in("가나다가나 나다", ["가나", "나다"], []) == [(0, 2, "가나"), (3, 5, "가나"), (6, 8, "나다")]
    assert D.places_in("아아아아아", ["아아"], [(0, 1)]) == [(2, 4, "아아")]
    assert D.places_in("", ["가나"], []) == []
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("가나다", k=rng.randrange(0, 40)))
        terms = sorted({"".join(rng.choices("가나다", k=rng.choice([2, 2, 3]))) for _ in range(rng.randrange(1, 5))})
        taken = [(a, a + rng.randrange(1, 4)) for a in rng.sample(range(40), 2)]
        kept = []
        for t in terms:
            at = text.find(t)
            while at >= 0:
                if all(max(at, a) >= min(at + len(t), b) for a, b in [*taken, *((x, y) for x, y, _ in kept)]):
                    kept.append((at, at + len(t), t))
                at = text.find(t, at + len(t))
        assert D.places_in(text, terms, taken) == kept


def test_overlaps_by_a_sweep(spark):
    rng = random.Random(8)
    some = lambda n: [(rng.randrange(6), a, a + rng.randrange(0, 12)) for a in (rng.randrange(200) for _ in range(n))]
    left, right = [*some(400), (None, 1, 5), (1, None, 5), (7, 1, 2)], [*some(60), (None, 0, 9), (2, None, 9), (3, 4, None)]
    a, b = (spark.createDataFrame(x, "unit long, s int, e int") for x in (left, right))
    clash = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[2] > y[1] and y[2] > x[1]
    assert sorted(map(str, (tuple(r) for r in D.not_overlapping(a.withColumn("_end", F.lit("?")).drop("_end"), b).collect()))) == sorted(str(x) for x in left if not any(clash(x, y) for y in right))
    kept = []
    for x in sorted(r for r in left if None not in r):
        if not any(clash(x, y) for y in kept):
            kept.append(x)
    got = sorted(tuple(r) for r in D.greedy_spans(a.where("unit is not null and s is not null")).collect())
    assert got == sorted(kept)


def test_a_unit_with_very_many_spans(spark):
    hot = spark.range(100_000).selectExpr("1L as unit", "cast(id * 3 as int) as s", "cast(id * 3 + 4 as int) as e")
    assert D.not_overlapping(hot, hot.where("s % 30 = 0")).count() == 100_000 - 10_000 - 10_000 - 9_999
    assert D.greedy_spans(hot).count() == 50_000


def test_greedy_spans_take_no_call_for_each_unit(spark):
    rows = [(u, s, s + 3) for u in [None, *range(300)] for s in (0, 2, 3, 9)] + [(1, None, 4), (1, 4, None), (2, 8, 7)]
    kept = D.greedy_spans(spark.createDataFrame(rows, "unit long, s int, e int"))
    assert sorted((-1 if r.unit is None else r.unit, r.s, r.e) for r in kept.collect()) == [(u, s, s + 3) for u in range(-1, 300) for s in (0, 3, 9)]
    plan = kept._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_names_known_to_units(spark):
    rows = [(1, 1, "성명: 김철수 님", None), (1, 2, "철수가 왔다", None), (1, 2, None, None), (2, 1, "철수가 왔다", None), (None, 1, "성명: 박민수", None), (None, 2, "민수", None), (1, 0, "철수", None), (3, 1, "남궁민은", [("p_nm", 0, 2, "남궁", 0.9), ("p_nm", 1, 3, "궁민", 0.9)])]
    df = spark.createDataFrame(rows, "doc_id long, ord int, text string, m array<struct<label:string,start:int,end:int,text:string,confidence:double>>")
    got = sorted(((r.doc_id or 0, r.ord, r.text or "", [(x.start, x.text, x.confidence, x.method) for x in r.found]) for r in D.detected_in_units(df, "m").collect()))
    assert got == [
        (0, 1, "성명: 박민수", [(4, "박민수", 0.85, "regex_context")]), (0, 2, "민수", []), (1, 0, "철수", []), (1, 1, "성명: 김철수 님", [(4, "김철수", 0.85, "regex_context")]),
        (1, 2, "", []), (1, 2, "철수가 왔다", [(0, "철수", 0.9, None)]), (2, 1, "철수가 왔다", []), (3, 1, "남궁민은", [(0, "남궁민", 0.9, "koelectra")]),
    ]
    assert D.detected_in_units(df.limit(0)).count() == 0


def test_addresses_of_the_wrong_form(spark):
    df = spark.createDataFrame([(1, "강남구 역삼동12"), (2, "서울 강남구 테헤란로 12"), (3, "주소 서울특별시 강남구 테헤란로 12에서")], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.text) for x in r.f] for r in df.select("doc_id", D.addresses(F.col("text")).alias("f")).collect()}
    assert got[1] == [] and (0, "서울 강남구 테헤란로 12") in got[2] and got[3]


def test_lines_of_read_text(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, "a", 1.0), (1, 2, 12.0, 1.0, 20.0, 11.0, "b", 0.5), (1, 3, 60.0, 0.0, 70.0, 10.0, "far", 1.0), (1, 4, 0.0, 40.0, 10.0, 50.0, "below", 1.0), (2, 1, 0.0, 0.0, 0.0, 0.0, "flat", 1.0)]
    df = spark.createDataFrame(rows, "page long, token long, x1 double, y1 double, x2 double, y2 double, text string, confidence double")
    got = sorted((r.page, r.line, r.text, r.x1, r.x2, r.confidence) for r in M.lines_of(df).collect())
    assert got == [(1, 0, "a", 0.0, 10.0, 1.0), (1, 1, "far b", 12.0, 70.0, 0.75), (1, 2, "below", 0.0, 10.0, 1.0), (2, 0, "flat", 0.0, 0.0, 1.0)]
    assert M.lines_of(df.limit(0)).count() == 0


def test_faces_keep_their_track(spark):
    moving = [(1, f * 2 + k, f, 10 * f + 300 * k, 10, 40, 40) for f in range(1, 9) for k in (0, 1)]
    gone = [(1, 99, 40, 10, 10, 40, 40)]
    df = spark.createDataFrame(moving + gone, "video long, id long, frame int, x int, y int, w int, h int")
    tracks = {}
    for r in faces_followed(df).collect():
        tracks.setdefault(r.track, set()).add(r.id)
    assert sorted(len(x) for x in tracks.values()) == [1, 8, 8]
    assert faces_followed(df.limit(0)).count() == 0


def test_replies_without_content(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "점수"), (4, "{broken")], "id long, reply string")
    r = F.col("reply")
    got = {x.id: x for x in df.select("id", G.relevance_of(r).alias("rel"), G.aspects_of(r).alias("asp"), G.data_of(r).alias("data"), G.memory_of(r).alias("m"), G.agent_stopped(r).alias("s")).collect()}
    assert all(x.rel.relevant is False and tuple(x.asp) == (0.5, 0.5, 0.5) and not x.s for x in got.values())
    assert got[1].data is None and got[2].data is None and got[4].data == "{broken"


def test_connections_without_values(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "id long, host string, port int, default_path string, path string")
    assert df.select(C.file_url(*(F.col(c) for c in ("host", "port", "default_path", "path")))).first()[0] == "http://:9000"
    assert df.select(C.table_of(F.lit("a.b.c"), F.lit("mysql"), F.col("host"), F.col("path")).alias("t")).first().t == ("a", "b.c")
    assert C.sampled(df.limit(0), "id", "host").count() == 0


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id long, text string")
    asked = spark.createDataFrame([(1, "A b"), (2, ""), (3, None)], "q_id long, q_text string")
    assert [tuple(r) for r in R.matching(asked, docs).collect()] == [(1, 1, 3)]
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "q_id long, q_embedding array<double>")
    assert [r.id for r in R.nearest(queries, vectors, 2).orderBy("rank").collect()] == [1, 2]
    assert R.nearest(queries.limit(0), vectors, 2).count() == 0


def test_nearest_by_blocks_equals_pairs(spark, monkeypatch):
    """Products of matrices give the similarities, ranks and ties of Spark's own sums, for odd vectors too, in blocks of any size."""
    rng = random.Random(4)
    some = [[rng.choice([0.0, 0.5, 1.0, -1.0, rng.gauss(0, 1)]) for _ in range(5)] for _ in range(60)]
    odd = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 1.0, 0.0, 0.0, 0.0], [1.0, 2.0], [-3.0, 1.0]]
    vectors = [(i, v) for i, v in enumerate([*some, *some[:20], *odd])]
    df = spark.createDataFrame(vectors, "id long, embedding array<float>")
    asked = df.where("id % 4 = 0").union(df.where("id >= 80")).selectExpr("id as q_id", "embedding as q_embedding").distinct()
    pairs = asked.crossJoin(df).select("q_id", "id", R.similarity(F.col("embedding"), F.col("q_embedding")).alias("similarity"))
    key = lambda x: sorted((r.q_id, r.rank, r.id, -9.0 if r.similarity is None else r.similarity) for r in x.collect())
    want = key(R.top(pairs, "similarity", 7))
    assert key(R.nearest(asked, df, 7)) == want
    monkeypatch.setattr(R, "BLOCK_ROWS", 9)
    monkeypatch.setattr(R, "QUERY_ROWS", 5)
    monkeypatch.setattr(R, "UNSURE", 0.5)
    found = R.nearest(asked, df, 7)
    assert key(found) == want and "Cogroup" in found._jdf.queryExecution().toString().replace("CoGroup", "Cogroup")


def test_cover_density(spark):
    docs = spark.createDataFrame([(1, "a b x a y y b"), (2, "b"), (3, "a a b"), (4, "a b c")], "id long, text string")
    asked = spark.createDataFrame([(1, "A b"), (2, "a"), (3, "c b a"), (4, "")], "q_id long, q_text string")
    got = {(r.q_id, r.id): (r.n_hits, round(r.text_rank, 6)) for r in R.ranked(asked, docs).collect()}
    assert got == {(1, 1): (4, 0.183333), (1, 3): (3, 0.1), (1, 4): (2, 0.1), (2, 1): (2, 0.2), (2, 3): (2, 0.2), (2, 4): (1, 0.1), (3, 4): (3, 0.1)}


def test_common_words_cost_no_pairs_of_query_and_text(spark):
    """Queries with the same words are one class, and only rows with a query's rarest word are candidates."""
    docs = spark.createDataFrame([(i, f"the of and w{i} the") for i in range(50)] + [(50, "the of and w3")], "id long, text string")
    asked = spark.createDataFrame([(q, f"The of and w{q % 5}") for q in range(20)] + [(20, "nowhere the"), (21, "the")], "q_id long, q_text string")
    members, words_ = R._classes(asked)
    assert members.count() == 22 and words_.select("_class").distinct().count() == 7
    assert R._met(words_.where("_all > 1"), docs).count() == 6
    assert sorted((r.q_id, r.id, r.n_hits) for r in R.matching(asked, docs).where("q_id < 21").collect()) == sorted([(q, q % 5, 5) for q in range(20)] + [(q, 50, 4) for q in range(20) if q % 5 == 3])
    assert R.ranked(asked, docs, 2).where("q_id = 21").count() == 2 and R.ranked(asked, docs).where("q_id = 21").count() == 51


def test_laws_without_articles(spark):
    rows = [(1, 1, "head\n 제 1 조 a\r\n①b\n1.\n가.  c"), (1, 2, "제 2 항\n\n plain"), (2, 1, None), (3, 1, ""), (4, 1, "나. only\nmore\n제2조"), (5, 1, "word " * 20), (5, 2, "제1조"), (5, 3, None), (6, 1, "no mark")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    got = sorted((r.doc_id, r.chunk, r.article, r.page, r.text) for r in I.law_chunks(pages).collect())
    whole = ("word " * 20) + "\n\n제1조"
    assert got == [(1, 1, "제1조", 1, "제1조 a\n① b\n1.\n가. c\n제 2 항\nplain"), (4, 1, None, 1, "나. only\nmore"), (4, 2, "제2조", 1, "제2조"), (5, 1, "청크 1", 1, whole)]
    paths = spark.createDataFrame([(1, "/a/first law.pdf"), (4, "http://x/y.pdf"), (4, "http://x/y.pdf"), (9, "z.pdf")], "doc_id long, path string")
    about = sorted((r.doc_id, r.chunk, r.title, r.effective_date) for r in I.law_pieces(pages, paths).collect())
    assert about == [(1, 1, "first law", None), (4, 1, "http://x/y.pdf", None), (4, 2, "http://x/y.pdf", None), (5, 1, None, None)]
    assert I.law_chunks(pages.limit(0)).count() == 0


def test_fixed_chunks_of_pages_as_they_come(spark):
    """Equal to cutting the whole text, with no pairs of chunks and pages."""
    rng = random.Random(9)
    docs = {d: [(p, rng.choice([None, "", " \n", "\u3000 ", "x", "word " * rng.randrange(400), "".join(rng.choices("ab. \n", k=rng.randrange(3000)))])) for p in range(1, rng.randrange(2, 14))] for d in range(40)}
    want = []
    for d, pages in docs.items():
        text, begun, end = "\n\n".join(t for _, t in pages if t is not None).strip(), [], 0
        for p, t in pages:
            if t is not None:
                begun.append((end, p))
                end += len(t) + 2
        start, n = 0, 0
        while start < len(text):
            end = min(start + 800, len(text))
            if end < len(text):
                end += next((k + 1 for k, c in enumerate(text[end : end + 100]) if c in ".。\n!?"), 0)
            piece = text[start:end].strip()
            if len(piece) < 50:
                start += 800
                continue
            n += 1
            want.append((d, n, start, max(p for a, p in begun if a <= start), piece))
            start = end - 150 if end - 150 > start else end
    got = I.fixed_chunks(spark.createDataFrame([(d, p, t) for d, pages in docs.items() for p, t in pages], "doc_id long, page int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert "Join" not in got._jdf.queryExecution().toString()


def test_tracks_over_gaps(spark):
    """Numbers go on behind a gap, and equal those of one pass that remembers all tracks."""
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, None]), rnd.choice("ab"), i, rnd.choice([0, 20, 60, 61, 130]) + rnd.randrange(12), rnd.randrange(30), rnd.randrange(30), rnd.randrange(0, 20), rnd.randrange(1, 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "video long, label string, id long, frame int, x int, y int, w int, h int")
    want, seen = {}, {}
    for v, c, i, f, x, y, w, h in sorted(rows, key=lambda r: (r[3], r[4], r[2])):
        if not w:
            continue
        last = seen.setdefault((v, c), [])
        for k, (f2, x2, y2, w2, h2) in enumerate(last):
            both = max(0, min(x + w, x2 + w2) - max(x, x2)) * max(0, min(y + h, y2 + h2) - max(y, y2))
            if 0 < f - f2 <= M.TRACK_GAP and both / (w * h + w2 * h2 - both) >= M.TRACK_IOU:
                last[k] = (f, x, y, w, h)
                break
        else:
            k = len(last)
            last.append((f, x, y, w, h))
        want[i] = k
    assert {r.id: r.track for r in M.tracks(df).collect()} == want
    assert M.tracks(df.limit(0)).count() == 0
