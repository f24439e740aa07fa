"""Queries on conversations, questions and dialogue states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialogue as C
from ..sources.derived import as_sql, view

_STATES = "select {c} as kind, o_orderkey, o_orderkey % 2 = 0 as flag, cast(o_custkey % 100 as double) / 100 as score, cast(o_orderkey % 5 as int) as retries from "
_KIND = "case o_orderkey % 4 when 0 then 'general' when 1 then 'both' when 2 then 'db_query' else 'vector_search' end"


def _states(s, d):
    return view(s, d, "orders").selectExpr("o_orderkey", f"{_KIND} as kind", "o_orderkey % 2 = 0 as flag", "cast(o_custkey % 100 as double) / 100 as score", "cast(o_orderkey % 5 as int) as retries")


def _message_states(s, d):
    upto = lambda n, at: f"case when {n} > 0 then transform(sequence(1, {n}), x -> cast(x + {at} as string)) else cast(array() as array<string>) end"
    return view(s, d, "orders").selectExpr("o_orderkey", f"{upto('cast(o_orderkey % 24 as int)', 0)} as l", f"{upto('cast(o_custkey % 6 as int)', 100)} as r")


QUERIES = {
    "conv_last_n": lambda s, d: C.last_messages(view(s, d, "conversations")).select("conv_id", "turn", "role"),
    "conv_keyword_overlap": lambda s, d: C.answers(view(s, d, "conversations")).select("conv_id", "turn", F.round(C.overlap(F.col("question"), F.col("answer")), 6).alias("overlap")),
    "conv_duplicate_sentences": lambda s, d: view(s, d, "conversations").select("conv_id", "turn", C.repeats_itself(F.col("text")).alias("repeats")),
    "question_heuristic": lambda s, d: view(s, d, "questions").select("conv_id", "turn", C.question_tier(F.col("text")).alias("kind")),
    "query_expand": lambda s, d: view(s, d, "questions").select("conv_id", "turn", C.expanded(F.col("text"), F.col("form") % 4).alias("txt")),
    "score_parse": lambda s, d: view(s, d, "replies").select("conv_id", "turn", C.score_of(F.col("reply")).alias("score")),
    "routes": lambda s, d: _states(s, d).select("o_orderkey", C.after_question(F.col("kind")).alias("after_question"), C.after_relevance(F.col("flag"), F.col("score"), F.col("retries")).alias("after_relevance"), C.after_grounding(F.col("flag"), F.col("score"), F.col("retries")).alias("after_grounding")),
    "counter_reducer": lambda s, d: view(s, d, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 4 as int) as l", "cast(o_custkey % 3 as int) as r").select("o_orderkey", C.counter(F.col("l"), F.col("r")).alias("n")),
    "markdown_plain": lambda s, d: view(s, d, "marked_answers").select("id", C.plain_text(F.col("txt")).alias("txt")),
    "output_issues": lambda s, d: C.answers(view(s, d, "conversations")).select("conv_id", "turn", F.array_join(C.answer_issues(F.col("question"), F.col("answer")), ",").alias("issues")),
    "result_note": lambda s, d: view(s, d, "conversations").select("conv_id", "turn", C.result_note(F.col("text")).alias("note")),
    "overall_confidence": lambda s, d: view(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.overall_confidence(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50), 6).alias("confidence")),
    "kind_named": lambda s, d: view(s, d, "kind_replies").select("id", C.kind_named(F.col("txt")).alias("kind")),
    "column_labels": lambda s, d: view(s, d, "label_replies").select("id", F.explode(C.column_labels(F.col("txt"))).alias("x")).select("id", F.col("x.tableName").alias("tab"), F.col("x.columnName").alias("col"), F.col("x.piiType").alias("pii")),
    "merged_messages": lambda s, d: _message_states(s, d).select("o_orderkey", F.array_join(C.merged_messages(F.col("l"), F.col("r")), ",").alias("ids")),
    "week_context": lambda s, d: view(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", F.to_date(F.date_trunc("week", "day")).alias("monday"), F.date_add(F.to_date(F.date_trunc("week", "day")), 6).alias("sunday")),
}

_SENTENCES = "list_filter(list_transform(string_split_regex(text, '[.!?\\n]'), lambda x: trim(x)), lambda x: x <> '')"
_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_Q = "list_distinct(regexp_extract_all(lower(q), '[\\p{L}\\p{N}_]+'))"

ORACLES = {
    "conv_last_n": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 2",
    "conv_keyword_overlap": f"""select conv_id, turn, round(len(list_intersect({_Q}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) / greatest(len({_Q}), 1)::double, 6) as overlap
        from (select *, lag(text) over w as q, lag(role) over w as b from conversations window w as (partition by conv_id order by turn)) where role = 'assistant' and b = 'user'""",
    "conv_duplicate_sentences": f"select conv_id, turn, len({_SENTENCES}) > 1.5 * len(list_distinct({_SENTENCES})) as repeats from conversations",
    "question_heuristic": f"select conv_id, turn, case when form in (0, 1, 6, 9, 10) then 'db_query' when form in (2, 7) then 'both' when form in (3, 4, 5, 8) then 'vector_search' else 'general' end as kind from {as_sql('questions')}",
    "query_expand": f"select conv_id, turn, text || case form % 4 when 1 then ' 관련 법령 조항' when 2 then ' 법적 근거 및 규정' else ' 법률 규정 법령' end as txt from {as_sql('questions')}",
    "score_parse": f"""select conv_id, turn, greatest(0.0, least(1.0, coalesce(try_cast(regexp_extract(list_filter(string_split(reply, chr(10)), lambda x: contains(x, '점수') and regexp_matches(x, '[0-9]'))[1], '[0-9]+[.]?[0-9]*') as double), 0.0)))::double as score from {as_sql('replies')}""",
    "routes": f"""select o_orderkey, case kind when 'general' then 'generate_answer' when 'both' then 'both_query' else kind end as after_question,
        case when flag and score >= 0.6 then 'rerank' when retries < 3 then 'vector_search' else 'generate_answer' end as after_relevance,
        case when flag and score >= 0.7 then 'multi_aspect_evaluation' when retries < 2 then 'generate_answer' else 'multi_aspect_evaluation' end as after_grounding from ({_STATES.format(c=_KIND)} orders)""",
    "counter_reducer": "select o_orderkey, cast(case when o_custkey % 3 = 0 then 0 when o_orderkey % 4 = 0 then o_custkey % 3 else greatest(o_orderkey % 4, o_custkey % 3) end as int) as n from orders",
    "markdown_plain": f"""select id, case form when 0 then concat(a, ' 와 ', b) when 1 then concat(a, chr(10), '본문 ', b) when 2 then concat(a, ' ', b) when 3 then concat(a, ' ', b) when 4 then concat('그대로 2 * ', n) when 5 then '' when 6 then a else concat(a, ' #', n) end as txt from {as_sql('marked_answers')}""",
    "output_issues": f"""with a as (select * from (select *, lag(text) over w as q, lag(role) over w as b from conversations window w as (partition by conv_id order by turn)) where role = 'assistant' and b = 'user'),
        m as (select *, len({_STRIPPED}) as n, len(string_split(text, '.')) as parts, len(list_distinct(list_filter(list_transform(string_split(text, '.'), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> ''))) as own,
            len(list_intersect({_Q}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) / greatest(len({_Q}), 1)::double as o, len({_Q}) as nq from a)
        select conv_id, turn, case when text = '' then '' else array_to_string(list_filter([case when n < 10 then 'too_short' end, case when n > 5000 then 'too_long' end,
            case when (text like '%...' or text like '...%' or regexp_matches(text, '죄송.*?답변.*?없|정보.*?없.*?제공')) and not (contains(text, '자료 없음') or contains(text, '찾을 수 없')) then 'incomplete' end,
            case when regexp_matches(lower(text), 'error|오류|exception|실패|failed') and not contains(text, '오류 없') then 'error' end,
            case when parts > 1.5 * own then 'repeats' end, case when nq > 0 and o < 0.2 then 'off_topic' end], lambda x: x is not null), ',') end as issues from m""",
    "result_note": f"""select conv_id, turn, case when len({_STRIPPED}) >= 10 then case when n = 1 then '[단일 결과: 1개 행]' else '[조회 결과: ' || n || '개 행]' end || case when k > 0 then ' [수치 데이터 포함: ' || k || '개 숫자]' else '' end end as note
        from (select *, len(list_filter(string_split({_STRIPPED}, chr(10)), lambda x: regexp_matches(x, '\\S'))) as n, len(regexp_extract_all(text, '[0-9]+')) as k from conversations)""",
    "overall_confidence": "select l_orderkey, l_linenumber, round(0.4 * l_discount + 0.3 * l_tax + 0.3 * (l_quantity / 50), 6) as confidence from lineitem",
    "kind_named": f"select id, case form when 0 then 'vector_search' when 1 then 'db_query' when 2 then 'general' when 3 then 'db_query' when 5 then 'both' end as kind from {as_sql('kind_replies')}",
    "column_labels": f"""select id, concat('t', n) as tab, 'c' as col, 'NM' as pii from {as_sql('label_replies')} where form = 0 union all select id, 'u', concat('d', n), 'PH' from {as_sql('label_replies')} where form = 1 union all select id, 'v', '', 'EM' from {as_sql('label_replies')} where form = 1""",
    "merged_messages": """with m as (select o_orderkey, [cast(x as varchar) for x in range(1, o_orderkey % 24 + 1)] as l, [cast(x + 100 as varchar) for x in range(1, o_custkey % 6 + 1)] as r from orders)
        select o_orderkey, array_to_string(case when len(l) = 0 then r when len(r) = 0 then l when len(r) <= 2 or len(l) > 20 then r else list_concat(l, r)[-4:] end, ',') as ids from m""",
    "week_context": "select distinct cast(o_orderdate as date) as day, cast(date_trunc('week', cast(o_orderdate as date)) as date) as monday, cast(date_trunc('week', cast(o_orderdate as date)) as date) + 6 as sunday from orders",
}
