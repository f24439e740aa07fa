"""Queries on replies of models, states of dialogues and what goes into prompts, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import dialogue as C
from ..sources.derived import as_sql, view


def _replies(s, d, **columns):
    return view(s, d, "replies").select("conv_id", "turn", *(f(F.col("reply")).alias(n) for n, f in columns.items()))


def _aspects(s, d):
    return _replies(s, d, a=C.aspects_of).select("conv_id", "turn", "a.*")


def _pairs(s, d):
    rows = view(s, d, "conversations")
    odd = F.when(F.col("turn") % 3 != 0, F.col("text"))
    by = W.partitionBy("conv_id").orderBy("turn")
    return rows.select("conv_id", "turn", F.lag("text").over(by).alias("a"), odd.alias("b"))


def _reducers(s, d):
    a, b = F.col("a"), F.col("b")
    la, lb = F.when(a.isNotNull(), F.array(F.length(a))), F.when(b.isNotNull(), F.array(F.length(b)))
    maps = [F.when(x.isNotNull(), F.create_map(F.lit(k), F.length(x), F.lit("both"), F.length(x))) for k, x in (("old", a), ("new", b))]
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return _pairs(s, d).select(
        "conv_id", "turn", C.latest_text(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), "default").alias("latest_text"), C.latest(a, b).alias("latest"), C.larger(F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))).alias("larger"),
        text(C.joined_lists(la, lb)).alias("joined"), text(C.replaced_list(la, lb)).alias("replaced"), C.merged_map(*maps)["both"].alias("both"), F.size(C.merged_map(*maps)).alias("keys"),
    )


def _memory(s, d):
    a, b = (F.create_map(F.lit(k), F.slice(words(F.col("text")), i, 3)) for k, i in (("w", 1), ("w", 2)))
    merged = C.merged_memory(a, b)
    return view(s, d, "conversations").select("conv_id", "turn", F.array_join(merged["w"], " ").alias("words"))


def _contexts(s, d):
    by = W.partitionBy("doc").orderBy("ord")
    ranked = view(s, d, "law_lines").withColumn("rank", F.row_number().over(by))  # contents are made of the ranked rows: of those that are kept
    return C.contexts(ranked.select(F.col("doc").alias("q_id"), "rank", F.when(F.col("ord") % 2 == 0, F.col("doc")).alias("law"), F.col("ord").cast("string").alias("article"), F.repeat("line", 60).alias("content")))


def _pooled(s, d):
    e = F.col("embedding").cast("array<double>")
    rows = view(s, d, "embeddings").select("vec_id", C.pooled(F.array(e, F.reverse(e), e), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(0))).alias("p"))
    return rows.select("vec_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[5], 6).alias("sixth"))


def _ranked(s, d):
    return view(s, d, "spans_ner").select(F.col("unit").alias("q_id"), F.col("ord").alias("rank"), F.col("confidence").alias("similarity"))


QUERIES = {
    "reply_text": lambda s, d: _replies(s, d, txt=C.assistant_text),
    "reply_memory": lambda s, d: _replies(s, d, m=C.memory_of).where("m.facts is not null").select("conv_id", "turn", F.array_join("m.facts", ",").alias("facts"), F.array_join(F.col("m.entities")["law"], ",").alias("laws")),
    "reply_relevance": lambda s, d: _replies(s, d, r=C.relevance_of).select("conv_id", "turn", "r.*"),
    "reply_grounding": lambda s, d: view(s, d, "replies").select("conv_id", "turn", C.grounding_of(F.replace("reply", F.lit("관련성"), F.lit("근거"))).alias("g")).select("conv_id", "turn", "g.*"),
    "reply_aspects": _aspects,
    "reply_data_lines": lambda s, d: _replies(s, d, data=C.data_of, stopped=C.agent_stopped),
    "question_secrets": lambda s, d: view(s, d, "conversations").select("conv_id", "turn", C.asks_for_secrets(F.concat("text", F.expr("case turn % 3 when 0 then ' my PassWord' when 1 then ' 사용자 목록' else '' end"))).alias("refused")),
    "routes_after_search": lambda s, d: view(s, d, "replies").select("conv_id", "turn", C.after_search_in_tables(F.expr("case turn % 2 when 0 then 'vector_search' else 'db_query' end")).alias("after_tables"), C.after_search().alias("after_law")),
    "state_reducers": _reducers,
    "memory_merged": _memory,
    "context_texts": _contexts,
    "prompt_columns": lambda s, d: C.prompt_columns(view(s, d, "catalog_columns")).select("table_name", "lines"),
    "instructed_queries": lambda s, d: view(s, d, "benchmark").select("item_id", C.instruction("Find the law", F.col("text")).alias("query")),
    "pooled_vectors": _pooled,
    "rerank_fallback": lambda s, d: C.reranked(_ranked(s, d)).select("q_id", "rank", "place"),
    "rerank_scored": lambda s, d: C.reranked(_ranked(s, d), F.col("similarity")).select("q_id", "rank", "place"),
}

_R = as_sql("replies")
_SCORED, _YES = "(contains(x, '점수') and regexp_matches(x, '[0-9]'))", "(contains(x, '여부') and (contains(lower(x), 'yes') or contains(x, '예') or contains(x, '있')))"


def _aspect(name: str, away: str) -> str:
    lines = f"list_filter(string_split(reply, chr(10)), lambda x: ({name}) and not ({away}) and regexp_matches(x, '[0-9]'))"
    return f"case when len({lines}) = 0 then 0.5 else greatest(0, least(1, cast(regexp_extract(list_last({lines}), '[0-9]+\\.?[0-9]*') as double))) end"


_ACC, _COM, _CON = ("contains(x, '정확성') or contains(lower(x), 'accuracy')", "contains(x, '완전성') or contains(lower(x), 'completeness')", "contains(x, '신뢰도') or contains(lower(x), 'confidence')")
_SPARE = "case turn % 3 when 0 then ' my PassWord' when 1 then ' 사용자 목록' else '' end"

ORACLES = {
    "reply_text": f"select conv_id, turn, case (conv_id + turn) % 8 when 5 then regexp_replace(text, '^\\s+|\\s+$', '', 'g') else regexp_replace(reply, '^\\s+|\\s+$', '', 'g') end as txt from {_R}",
    "reply_memory": f"select conv_id, turn, concat('f', turn) as facts, 'b,a' as laws from conversations where (conv_id + turn) % 8 = 6",
    "reply_relevance": f"""with f as (select conv_id, turn, list_filter(string_split(reply, chr(10)), lambda x: {_SCORED} or {_YES})[1] as x from {_R}),
        g as (select conv_id, turn, x, case when {_SCORED} then greatest(0, least(1, cast(regexp_extract(x, '[0-9]+\\.?[0-9]*') as double))) else 0 end as score from f)
        select conv_id, turn, cast(score as double) as score, coalesce(score >= 0.6 or ({_YES} and not {_SCORED}), false) as relevant from g""",
    "reply_grounding": f"""with l as (select conv_id, turn, string_split(replace(reply, '관련성', '근거'), chr(10)) as l from {_R}), f as (select conv_id, turn, list_filter(l, lambda x: contains(x, '근거') and ({_SCORED} or {_YES} or (contains(x, '여부') and contains(x, '충분'))))[1] as x from l),
        g as (select conv_id, turn, x, case when {_SCORED} then greatest(0, least(1, cast(regexp_extract(x, '[0-9]+\\.?[0-9]*') as double))) else 0 end as score from f)
        select conv_id, turn, cast(score as double) as score, coalesce(score >= 0.7 or ({_YES} and not {_SCORED}), false) as grounded from g""",
    "reply_aspects": f"select conv_id, turn, {_aspect(_ACC, 'false')} as accuracy, {_aspect(_COM, _ACC)} as completeness, {_aspect(_CON, _ACC + ' or ' + _COM)} as confidence from {_R}",
    "reply_data_lines": f"select conv_id, turn, case (conv_id + turn) % 8 when 7 then concat('ID: 5', chr(10), 'Status ok', chr(10), 'Name b') else reply end as data, contains(lower(reply), 'agent stopped due to iteration limit or time limit') as stopped from {_R}",
    "question_secrets": f"select conv_id, turn, turn % 3 < 2 or regexp_matches(lower(text), '비밀번호|password|pwd|passwd|secret|credential|token|api_key|users 테이블|users table|user 정보|사용자 정보|user list') as refused from conversations",
    "routes_after_search": "select conv_id, turn, case turn % 2 when 0 then 'vector_search' else 'generate_answer' end as after_tables, 'check_relevance' as after_law from conversations",
    "state_reducers": """with p as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as a, case when turn % 3 <> 0 then text end as b from conversations)
        select conv_id, turn, case when b <> '' then b when a <> '' then a else 'default' end as latest_text, coalesce(b, a) as latest, greatest(len(coalesce(a, '')), len(coalesce(b, ''))) as larger,
            case when a is null and b is null then null else concat_ws(',', len(a), len(b)) end as joined, coalesce(cast(coalesce(len(b), len(a)) as string), null) as replaced, coalesce(len(b), len(a)) as both, case when a is null and b is null then null when a is null or b is null then 2 else 3 end as keys from p""",
    "memory_merged": "select conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(w[1:3], w[2:4]))), ' ') as words from (select conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from conversations)",
    "context_texts": f"""with r as (select *, row_number() over (partition by doc order by ord) as k from {as_sql('law_lines')})
        select doc as q_id, string_agg(concat('문서 ', k, ' (', case when ord % 2 = 0 then doc else '' end, ' ', ord, '):', chr(10), left(repeat(line, 60), 800)), concat(chr(10), chr(10), '---', chr(10), chr(10)) order by k) as context from r where k <= 5 group by doc""",
    "prompt_columns": f"select table_name, string_agg(concat('- ', table_name, '.', column_name), chr(10) order by ordinal_position) as lines from {as_sql('catalog_columns')} group by table_schema, table_name",
    "instructed_queries": "select item_id, concat('Instruct: Find the law', chr(10), 'Query: ', text) as query from benchmark",
    "pooled_vectors": """with e as (select vec_id, cast(embedding as double[]) as a, list_reverse(cast(embedding as double[])) as b from embeddings),
        t as (select vec_id, case when vec_id % 2 = 1 then list_transform(list_zip(a, b), lambda x: x[1] + x[2]) else a end as s from e)
        select vec_id, round(s[1] / sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) as first, round(s[6] / sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) as sixth from t""",
    "rerank_fallback": f"select unit as q_id, ord as rank, row_number() over (partition by unit order by ord) as place from {as_sql('spans_ner')} where ord <= 40 qualify place <= 5",
    "rerank_scored": f"select unit as q_id, ord as rank, row_number() over (partition by unit order by confidence desc, ord) as place from {as_sql('spans_ner')} where ord <= 40 qualify place <= 5",
}
