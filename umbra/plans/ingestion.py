"""Queries on page blocks and legal lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..sources.derived import as_sql, view

_HEIGHT = 22.0


def _blocks(s, d):
    return I.blocks(view(s, d, "documents").select("doc_id", "source", "text"))


def _lines(s, d):
    return view(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


QUERIES = {
    "page_text": lambda s, d: I.page_texts(_blocks(s, d)),
    "header_footer": lambda s, d: I.without_margins(_blocks(s, d), _HEIGHT).select("doc_id", "ord"),
    "repeat_noise_removal": lambda s, d: I.without_repeated(_blocks(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")),
    "soft_linebreak": lambda s, d: I.soft_breaks(_lines(s, d)),
    "fixed_chunks": lambda s, d: I.fixed_chunks(I.page_texts(_blocks(s, d))),
    "dictionary_entries": lambda s, d: I.dictionary_entries(view(s, d, "dict_lines")),
    "article_chunks": lambda s, d: I.article_chunks(view(s, d, "law_lines")),
}

_LINES = "select doc_id, source, unnest(range(len(l))) as k, unnest(l) as text from (select doc_id, source, string_split(text, chr(10)) as l from documents)"
_BLOCKS = f"(select doc_id, k * 2 + 1 as ord, cast(1 + k // 20 as int) as page, k % 20 + 1.0 as y0, k % 20 + 2.0 as y1, text from ({_LINES}) union all select doc_id, k * 2, cast(1 + k // 20 as int), 0.0, 1.0, concat('Report  ', source) from ({_LINES}) where k % 20 = 0)"
_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_STRUCTURE = "^제\\s*[0-9]+\\s*조|^제\\s*[0-9]+\\s*항|^[①-⑩]|^\\(?[0-9]+\\)?[.)]\\s+\\S+|^(부칙|별표|별지)"
_NORM = f"trim(lower(regexp_replace(regexp_replace(regexp_replace({_TRIM('text')}, '\\s+', ' ', 'g'), '^\\s*[-–—]?\\s*[0-9]+\\s*[-–—]?\\s*$', ''), '^(page\\s*)?[0-9]+\\s*(of\\s*[0-9]+)?$', '', 'i')))"

_ENDS = "[.。\n!?]"


def _fixed(pages: str) -> str:
    return f"""with recursive p as ({pages}),
        places as (select doc_id, page, sum(len(text) + 2) over (partition by doc_id order by page) - len(text) - 2 as f from p),
        t as materialized (select doc_id, regexp_replace(string_agg(text, chr(10) || chr(10) order by page), '^\\s+|\\s+$', '', 'g') as t from p group by 1),
        r as (select doc_id, t, 0 as start, case when len(t) > 800 then 800 + case when regexp_matches(substr(t, 801, 100), '{_ENDS}') then len(regexp_extract(substr(t, 801, 100), '^[^.。\n!?]*')) + 1 else 0 end else len(t) end as stop from t where t <> '' union all
            select doc_id, t, nxt, case when len(t) > nxt + 800 then nxt + 800 + case when regexp_matches(substr(t, nxt + 801, 100), '{_ENDS}') then len(regexp_extract(substr(t, nxt + 801, 100), '^[^.。\n!?]*')) + 1 else 0 end else len(t) end
            from (select doc_id, t, cast(case when len({_TRIM("substr(t, start + 1, stop - start)")}) < 50 then start + 800 when stop - 150 > start then stop - 150 else stop end as int) as nxt from r) where nxt < len(t)),
        c as (select doc_id, start, {_TRIM("substr(t, start + 1, stop - start)")} as text from r), k as (select *, row_number() over (partition by doc_id order by start) as chunk from c where len(text) >= 50)
        select doc_id, cast(chunk as int) as chunk, start, (select max(page) from places x where x.doc_id = k.doc_id and f <= start) as page, text from k"""


ORACLES = {
    "page_text": f"select doc_id, page, string_agg(text, chr(10) order by ord) as text from {_BLOCKS} group by 1, 2",
    "header_footer": f"select doc_id, cast(ord as int) as ord from {_BLOCKS} where y1 > 0.08 * 22 and y0 < 0.92 * 22",
    "repeat_noise_removal": f"""with b as (select *, {_NORM} as norm from {_BLOCKS}), p as (select doc_id, greatest(2, floor(max(page) * 0.35)) as least from b group by 1),
        r as (select doc_id, norm from b join p using (doc_id) where norm <> '' and len(norm) <= 100 group by 1, 2, least having count(distinct page) >= least)
        select doc_id, count(*) as n from b where not exists (select 1 from r where r.doc_id = b.doc_id and r.norm = b.norm) or regexp_matches(text, '{_STRUCTURE}') group by 1""",
    "soft_linebreak": f"""with l as (select doc_id, k as ord, {_TRIM('text')} as line from ({_LINES})), b as (select *, lag(line) over (partition by doc_id order by ord) as before from l),
        f as (select *, before is null or line = '' or before = '' or regexp_matches(line, '{_STRUCTURE}') or regexp_matches(before, '[.!?」’)\\]}}]$') as fresh from b),
        g as (select *, sum(fresh::int) over (partition by doc_id order by ord) as part, case when not fresh and regexp_matches(before, '[A-Za-z0-9가-힣]$') and regexp_matches(line, '^[A-Za-z0-9가-힣]') then ' ' || line else line end as t from f)
        select doc_id, cast(part as bigint) as part, string_agg(t, '' order by ord) as text from g group by 1, 2""",
    "fixed_chunks": _fixed(f"select doc_id, page, string_agg(text, chr(10) order by ord) as text from {_BLOCKS} group by 1, 2"),
    "dictionary_entries": f"""with recursive l as (select *, row_number() over (partition by doc order by ord) as a from {as_sql('dict_lines')}),
        cut as (select doc, coalesce(min(case when regexp_matches(line, '^[0-9]+\\.[0-9]+') then a end), 1000000) as least from l where a > 5 group by 1),
        b as materialized (select doc, a - 6 as i, line, count(*) over (partition by doc) as n from l join cut using (doc) where a > 5 and a < least),
        pick as materialized (select x.doc, x.i, x.n, regexp_matches(x.line, '^[A-Z]{{1,10}}$') and not regexp_matches(y.line, '^[A-Z]{{1,10}}$') as ok from b x join b y on x.doc = y.doc and y.i = x.i + 1 where x.i + 4 < x.n),
        r as (select doc, i, ok from pick where i = 0 union all select p.doc, p.i, p.ok from r join pick p on p.doc = r.doc and p.i = r.i + case when r.ok then 5 else 1 end)
        select doc, 1 as block, a.line as abbr, k.line as korean, e.line as english, d.line as description, k.line || '(' || e.line || ')은 ' || d.line || '을 의미한다. 데이터베이스 표준 약어는 ' || a.line || '이다.' as text
        from r join b a using (doc, i) join b k on k.doc = r.doc and k.i = r.i + 1 join b e on e.doc = r.doc and e.i = r.i + 2 join b d on d.doc = r.doc and d.i = r.i + 3 where ok""",
    "article_chunks": f"""with c as (select *, count(case when p then 1 end) over (partition by doc order by ord) as chunk from (select *, regexp_matches(line, '^제[0-9]+조') as p from {as_sql('law_lines')}))
        select doc, chunk, max(case when p then regexp_extract(line, '^제[0-9]+조') end) as article, count(*) as n_lines, string_agg(line, chr(10) order by ord) as text from c where chunk > 0 group by 1, 2""",
}


def _marks(s, d):
    return view(s, d, "law_lines").select("doc", "ord", I.law_mark(F.col("line")).alias("m")).where("m is not null").select("doc", "ord", "m.kind", "m.mark")


QUERIES |= {
    "law_marks": _marks,
    "law_metadata": lambda s, d: view(s, d, "law_pages").select("doc", I.law_metadata(F.col("path"), F.col("text")).alias("m")).select("doc", "m.*"),
    "law_chunks": lambda s, d: I.law_chunks(view(s, d, "law_sheets")),
    "text_lines": lambda s, d: I.text_lines(view(s, d, "documents")),
}
QUERIES["noise_counters"] = lambda s, d: I.noise_counters(_blocks(s, d), _HEIGHT)
ORACLES["noise_counters"] = f"""with b as (select *, {_NORM} as norm, y1 <= 0.08 * 22 or y0 >= 0.92 * 22 as margin, regexp_matches({_TRIM('text')}, '{_STRUCTURE}') as unit from {_BLOCKS}),
    p as (select doc_id, greatest(2, floor(count(distinct page) * 0.35)) as least from b where not margin group by 1),
    r as (select doc_id, norm from b join p using (doc_id) where not margin and not unit and norm <> '' and len(norm) <= 100 group by 1, 2, least having count(distinct page) >= least),
    x as (select b.*, r.norm is not null as again from b left join r on r.doc_id = b.doc_id and r.norm = b.norm and not unit and not margin)
    select doc_id, count(distinct page) as total_pages, count(*) as raw_blocks, count(*) filter (margin) as removed_by_position, count(*) filter (not margin) as kept_after_position, count(distinct norm) filter (again) as repeated_text_count,
        count(*) filter (not margin and not again) as kept_after_repeat, cast(greatest(2, floor(count(distinct page) * 0.35)) as bigint) as repeated_threshold_pages from x group by 1"""
_DATES = " union all ".join(f"select doc, unnest(regexp_extract_all(text, '{w}([0-9]{{4}}[.\\s][0-9]{{1,2}}[.\\s][0-9]{{1,2}})', 1)) as x from {as_sql('law_pages')}" for w in ("시행.*?", "개정.*?", "공포.*?", ""))
_SHEETS = as_sql("law_sheets")
_THIN = "doc_id in (select doc_id from p left join (select doc_id, count(*) as n from g group by 1) using (doc_id) group by doc_id, n having coalesce(n, 0) < 0.5 * count(*))"
ORACLES |= {
    "law_chunks": f"""with p as materialized (select * from {_SHEETS}), l as (select doc_id, page, k, {_TRIM('a[k + 1]')} as line from (select doc_id, page, string_split(text, chr(10)) as a, unnest(range(len(string_split(text, chr(10))))) as k from p)),
        m as (select *, regexp_extract(line, '^제\\s*[0-9]+\\s*조(\\s*의\\s*[0-9]+)?') as head, regexp_extract(line, '^(제\\s*[0-9]+\\s*항|[①-⑩]|[0-9]+(의[0-9]+)?\\.|[가-힣]\\.)') as sub from l where line <> ''),
        c as (select *, case when head <> '' then head else sub end as mark, count(nullif(head, '')) over w as part, bool_or(head || sub <> '') over w as begun from m window w as (partition by doc_id order by page, k)),
        t as (select *, {_TRIM('substr(line, len(mark) + 1)')} as rest from c where begun),
        g as materialized (select doc_id, part, nullif(max(regexp_replace(head, '\\s', '', 'g')), '') as article, min(page) as page, string_agg(case when mark = '' or rest = '' then line else regexp_replace(mark, '\\s', '', 'g') || ' ' || rest end, chr(10) order by page, k) as text from t group by 1, 2)
        select doc_id, cast(row_number() over (partition by doc_id order by part) as int) as chunk, article, page, text from g where not {_THIN}
        union all select doc_id, chunk, concat('청크 ', chunk), page, text from ({_fixed(f"select doc_id, page, text from {_SHEETS}")}) where {_THIN}""",
    "law_marks": f"""select doc, ord, case when ord % 7 = 0 then 'article' when ord % 7 in (1, 2) then 'paragraph' when ord % 7 = 3 then 'item' else 'subitem' end as kind,
        case ord % 7 when 0 then concat('제', ord % 40, '조') when 1 then '제1항' when 2 then '제1항' when 3 then '제1호' else '가목' end as mark from {as_sql('law_lines')} where ord % 7 < 5""",
    "law_metadata": f"""with x as (select doc, string_split(regexp_replace(x, '\\s', '.', 'g'), '.') as p from ({_DATES})), v as (select doc, max(concat(p[1], '-', lpad(p[2], 2, '0'), '-', lpad(p[3], 2, '0'))) as e from x where cast(p[1] as int) between 1900 and 2100 and cast(p[2] as int) between 1 and 12 and cast(p[3] as int) between 1 and 31 group by 1),
        t as (select doc, case when path like 'http%' then path else regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.pdf|\\.PDF', '', 'g') end as title from {as_sql('law_pages')})
        select doc, title, case doc % 4 when 0 then '개인정보 보호법' when 1 then '정보통신 규정' when 2 then title else '가법' end as law_name, e as effective_date from t left join v using (doc)""",
    "text_lines": "select doc_id, cast(k as int) as line_ord, regexp_replace(l[k + 1], '^\\s+|\\s+$', '', 'g') as text from (select doc_id, string_split(text, chr(10)) as l, unnest(range(len(string_split(text, chr(10))))) as k from documents) where regexp_matches(l[k + 1], '\\S')",
}


def _law_pieces(s, d):
    return I.law_pieces(view(s, d, "law_sheets"), view(s, d, "part").selectExpr("p_partkey as doc_id", "concat('/laws/', p_brand, '.pdf') as path"))


QUERIES["law_pieces"] = _law_pieces
ORACLES["law_pieces"] = f"""with c as ({ORACLES["law_chunks"]}) select c.*, p_brand as title, p_brand as law_name, null::varchar as effective_date from c left join (select p_partkey, p_brand from part) on p_partkey = doc_id"""
