"""Search queries: every row whose id is divisible by 100 is a query against all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cells as V
from ..operators import postings as P
from ..operators import retrieve as R
from ..sources.derived import view
from ..sources.shared import folder


def _knn(spark, d, k):
    rows = view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.nearest(rows.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding")), rows, k)


def _cells(spark, d, probes):
    """The index of all vectors, in a folder of its own; probes: as measured, or all cells."""
    rows = view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = V.build(rows, f"{folder(spark)}/cells-{uuid.uuid4().hex}", 64, 3, 0.9)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    return index.nearest(queries, 3, len(index.centres) if probes else None)


def _text(spark, d, find=R.matching):
    rows = view(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    first = F.coalesce(F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}_]+", 0), F.lit(""))
    return find(rows.where("id % 100 = 0").select(F.col("id").alias("q_id"), first.alias("q_text")), rows)


def _whole(spark, d, k):
    """Whole texts as queries, ranked, the k best of each."""
    rows = view(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.ranked(rows.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("text").alias("q_text")), rows, k)


def _passages(spark, d, find=R.matching):
    """Whole benchmark texts as queries: documents that hold all of their words."""
    queries = view(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q_text"))
    return find(queries, view(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _stored(spark, d):
    """The word index of all documents, in a folder of its own."""
    return P.build(view(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), f"{folder(spark)}/words-{uuid.uuid4().hex}")


def _sentences(spark, d):
    """Each sentence of each benchmark text as a query."""
    rows = view(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]")).alias("k", "q_text"))
    return rows.select((F.col("item_id") * 10000 + F.col("k")).alias("q_id"), "q_text")


def _filtered(spark, d):
    rows = view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    return R.nearest(queries, rows.where("label = 1"), 3)


QUERIES = {
    "knn_top3": lambda s, d: _knn(s, d, 3),
    "knn_filtered": _filtered,
    "knn_in_cells": lambda s, d: _cells(s, d, False),
    "knn_all_cells": lambda s, d: _cells(s, d, True),
    "fulltext_match": _text,
    "fulltext_all_words": _passages,
    "fulltext_ranked": lambda s, d: _passages(s, d, R.ranked).withColumn("text_rank", F.round("text_rank", 6)),
    "fulltext_indexed": lambda s, d: _passages(s, d, lambda q, _: _stored(s, d).ranked(q)).withColumn("text_rank", F.round("text_rank", 6)),
    "fulltext_top": lambda s, d: _stored(s, d).top(_sentences(s, d), 3).withColumn("text_rank", F.round("text_rank", 6)),
    "hybrid_search": lambda s, d: R.hybrid(_knn(s, d, 10), _text(s, d, lambda q, rows: R.ranked(q, rows, 10)), 5),
    "hybrid_whole_texts": lambda s, d: R.hybrid(_knn(s, d, 10), _whole(s, d, 10), 5).withColumn("score", F.round("score", 6)),
    "dict_context": lambda s, d: R.first_seen(_knn(s, d, 3), "id", "q_id", "rank").select("id", "q_id", "rank"),
    "citations_distinct": lambda s, d: view(s, d, "law_lines").select(F.concat_ws(" ", "doc", F.regexp_extract("line", "^제[0-9]+조", 0)).alias("citation")).where("citation like '%조'").distinct(),
}

_PAIRS = "select q.vec_id as q_id, c.vec_id as id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as similarity from embeddings q, embeddings c where q.vec_id % 100 = 0"
_TOP = lambda rows, score, k: f"select * from (select *, row_number() over (partition by q_id order by {score} desc, id) as rank from ({rows})) where rank <= {k}"
_WORDS = "with w as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as word from documents), q as (select doc_id as q_id, regexp_extract(lower(text), '[\\p{L}\\p{N}_]+') as word from documents where doc_id % 100 = 0)"
_MATCH = f"{_WORDS} select q_id, id, count(*) as n_hits from w join q using (word) group by 1, 2"


def _hybrid(hits: str) -> str:
    return f"select q_id, id, round(coalesce(similarity, 0) * 0.7 + coalesce(text_rank, 0) * 0.3, 8) as score from ({_TOP(_PAIRS, 'similarity', 10)}) v full outer join ({_TOP(hits, 'text_rank', 10)}) t using (q_id, id)"


def _covers(queries: str) -> str:
    """Ranks by cover density: for each hit of a word, the latest hits of all words up to it; a cover ends at the first hit that moves their earliest one."""
    return f"""with q as materialized (select q_id, list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) as a from ({queries}) where regexp_matches(t, '[\\p{{L}}\\p{{N}}_]')),
        d as materialized (select doc_id as id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as a from documents), m as materialized (select q_id, id, q.a as asked, d.a as said from q join d on list_has_all(d.a, q.a)),
        e as materialized (select q_id, id, k, word, row_number() over (partition by q_id, id order by k) as i from (select q_id, id, asked, unnest(said) as word, unnest(range(len(said))) as k from m) where list_contains(asked, word)),
        w as materialized (select q_id, id, unnest(asked) as asked from m),
        l as (select e.q_id, e.id, e.i, e.k, max(case when word = asked then e.i end) over (partition by e.q_id, e.id, asked order by e.i) as last from e join w using (q_id, id)),
        s as materialized (select q_id, id, i, k, case when count(last) = count(*) then min(last) end as first from l group by 1, 2, 3, 4),
        c as (select q_id, id, first, min(i) as i, min(k) as k from s where first is not null group by 1, 2, 3),
        r as (select c.q_id, c.id, round(sum(0.1::double / (1 + (c.k - e.k) - (c.i - c.first))), 9) as text_rank from c join e on e.q_id = c.q_id and e.id = c.id and e.i = c.first group by 1, 2),
        n as (select q_id, id, count(*) as n_hits from e group by 1, 2) select q_id, id, n_hits, text_rank from r join n using (q_id, id)"""


_SENTENCES = "select item_id * 10000 + k as q_id, a[k + 1] as t from (select item_id, string_split_regex(text, '[.\\n]') as a, unnest(range(len(string_split_regex(text, '[.\\n]')))) as k from benchmark)"
ORACLES = {
    "fulltext_all_words": """with w as (select doc_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as a from documents), q as (select item_id as q_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as a from benchmark)
        select q_id, id, cast(len(list_filter(w.a, lambda x: list_contains(q.a, x))) as bigint) as n_hits from w join q on list_has_all(w.a, q.a) where len(q.a) > 0""",
    "fulltext_ranked": f"select q_id, id, n_hits, round(text_rank, 6) as text_rank from ({_covers('select item_id as q_id, text as t from benchmark')})",
    "fulltext_top": f"select q_id, id, n_hits, round(text_rank, 6) as text_rank, rank from ({_TOP(_covers(_SENTENCES), 'text_rank', 3)})",
    "hybrid_whole_texts": f"select q_id, id, round(score, 6) as score, rank from ({_TOP(_hybrid(_covers('select doc_id as q_id, text as t from documents where doc_id % 100 = 0')), 'score', 5)})",
    "knn_top3": _TOP(_PAIRS, "similarity", 3),
    "knn_all_cells": _TOP(_PAIRS, "similarity", 3),
    "knn_filtered": _TOP(_PAIRS + " and c.label = 1", "similarity", 3),
    "fulltext_match": _MATCH,
    "hybrid_search": _TOP(_hybrid(f"select q_id, id, n_hits * 0.1::double as text_rank from ({_MATCH})"), "score", 5),
    "dict_context": f"select id, q_id, rank from (select *, row_number() over (partition by id order by q_id, rank) as f from ({_TOP(_PAIRS, 'similarity', 3)})) where f = 1",
    "citations_distinct": "select distinct concat(p_brand, ' 제', p_partkey % 40, '조') as citation from part where p_partkey % 7 = 0",
}
ORACLES["fulltext_indexed"] = ORACLES["fulltext_ranked"]


def _sources(spark, d):
    """The ten nearest, in the order of their ids, some of unknown similarity."""
    rows = _knn(spark, d, 10).selectExpr("q_id", "id", "case when id % 7 > 0 then similarity end as similarity")
    return R.by_similarity(rows.selectExpr("*", "cast(id as int) as rank")).select("q_id", "id", "place")


QUERIES["sources_by_similarity"] = _sources
ORACLES["sources_by_similarity"] = f"select q_id, id, cast(row_number() over (partition by q_id order by case when id % 7 > 0 then similarity else 0 end desc, id) as int) as place from ({_TOP(_PAIRS, 'similarity', 10)})"
