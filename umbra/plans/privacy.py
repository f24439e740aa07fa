"""Queries on detection, masking and roll-up, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import detect as D
from ..sources.derived import TABLES, as_sql, view

_FREE = ("p_em", "p_ip", "p_pp")
# Written out apart from the rules: longer runs of digits are put out of the way first, so that no number is cut.
_IPS = "list_filter(regexp_extract_all(regexp_replace(text, '[0-9]{4,}', 'x', 'g'), '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}'), lambda x: len(list_filter(string_split(x, '.'), lambda o: cast(o as int) > 255)) = 0)"
_FOUND = {
    "EM": f"regexp_extract_all(text, '[a-zA-Z0-9][a-zA-Z0-9._+-]*@[a-zA-Z0-9][a-zA-Z0-9.-]*\\.[a-zA-Z]{{2,}}')",
    "IP": _IPS,
    "PP": f"regexp_extract_all(text, '{rules.PASSPORT}')",
    "PH": "list_distinct(list_filter(list_transform(flatten([" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in rules.PHONES) + "]), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: len(x) between 9 and 11))",
    "RRN": f"regexp_extract_all(text, '{rules.RRN_HYPHEN}')",
}
_ADDRESSES = "list_distinct(list_filter(list_transform(flatten([" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in rules.ADDRESSES) + "]), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: len(x) >= 8 and regexp_matches(x, '[도시군구]') and regexp_matches(x, '[로길동]') and not regexp_matches(x, '[구시]$') and len(regexp_replace(x, '[^가-힣]', '', 'g')) >= 0.6 * len(regexp_replace(x, '\\s', '', 'g'))))"


def _counts(codes: tuple[str, ...], source: str) -> str:
    parts = " union all ".join(f"select doc_id, '{c}' as code, cast(len({_FOUND[c]}) as bigint) as n from {as_sql(source)}" for c in codes)
    return f"select doc_id, code, n as total_count from ({parts}) where n > 0"


def _by_code(source: str, labels: tuple[str, ...]):
    return lambda spark, d: D.entities(view(spark, d, source, deal=source not in TABLES).select("doc_id", "text"), labels=labels).groupBy("doc_id", "code").agg(F.count("*").alias("total_count"))


def _slot_sql() -> str:
    whens_code, whens_value = [], []
    for c, keywords in rules.FIELDS.items():
        for k in keywords:
            at = f"contains(line, '{k}:') or contains(line, '{k} :')"
            whens_code.append(f"when {at} then '{c}'")
            whens_value.append(f"when {at} then substr(line, strpos(line, '{k}') + {len(k)})")
    lines = f"select doc_id, unnest(range(len(l))) as line_ord, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from {as_sql('kr_form')})"
    return f"select doc_id, cast(line_ord as int) as line_ord, case {' '.join(whens_code)} end as code, trim(regexp_replace(case {' '.join(whens_value)} end, '^[ :\\t]+', '')) as value from ({lines}) where case {' '.join(whens_code)} end is not null"


# No detector finds an entity in a value of a masked shape unless it is a phone number.
_MASKED = "(value = '' or ((" + " or ".join(f"regexp_matches(value, '{p}')" for p in rules.MASKED_SHAPES) + ") and not regexp_matches(value, '0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|01[016789][0-9]{7,8}')))"
_ROLLUP = f"""select doc_id, code, cast(sum(t) as bigint) as total_count, cast(sum(m) as bigint) as masked_count from (
    select doc_id, code, total_count as t, 0 as m from ({_counts(('EM', 'IP', 'PP', 'PH', 'RRN'), 'kr_form')})
    union all select doc_id, 'ADD', len({_ADDRESSES}), 0 from {as_sql('kr_form')} where len({_ADDRESSES}) > 0
    union all select doc_id, code, 0, 1 from ({_slot_sql()}) where {_MASKED}) group by 1, 2"""


def _flagship(spark, d):
    forms = view(spark, d, "documents").select("doc_id", "text")
    return D.scan_rollup(forms)


def _masked_documents(spark, d):
    return D.mask_entities(view(spark, d, "documents").select("doc_id", "text"), ("p_em",))


_STARRED = f"select doc_id, array_to_string(list_transform(list_zip(string_split_regex(text, '{rules.EMAIL}'), regexp_extract_all(text, '{rules.EMAIL}')), lambda x: concat(x[1], repeat('*', coalesce(len(x[2]), 0)))), '') as text from documents"


def _name_units(spark, d):
    """Units with names in a text and in what a model is said to have found: the text told, where there is one."""
    at = F.expr("instr(text, told) - 1")
    span = F.struct(F.lit("p_nm").alias("label"), at.alias("start"), (at + F.length("told")).alias("end"), F.col("told").alias("text"), F.lit(0.8).alias("confidence"))
    return view(spark, d, "name_units", deal=True).withColumn("spans", F.when(F.col("told") != "", F.array(span)))


def _in_units(spark, d):
    rows = D.detected_in_units(_name_units(spark, d), "spans").select("doc_id", "ord", F.explode("found").alias("x"))
    return rows.select("doc_id", "ord", F.col("x.label").alias("label"), F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.text").alias("found"), F.col("x.confidence").alias("confidence"), F.coalesce("x.method", F.lit("")).alias("method"))


def _stretched_names(spark, d):
    """Names of each unit after they were made longer."""
    rows = _name_units(spark, d).select("doc_id", "ord", F.explode(D.lengthened(F.col("text"), D.united(F.array().cast(D.ENTITIES), D.names_by_context(F.col("text")), F.col("spans")))).alias("x"))
    return rows.select("doc_id", "ord", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.text").alias("found"))


def _form_lines(spark, d):
    pieces = F.posexplode(F.split(F.regexp_replace("text", ": ", "\n"), "\n")).alias("ord", "text")
    return view(spark, d, "kr_form", deal=True).select("doc_id", pieces)


def _mixed(spark, d, column, found, *more):
    rows = view(spark, d, "mixed_form", deal=True).select("doc_id", F.explode(found(F.col(column))).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.text").alias("found"), *(F.col(f"x.{m}").alias(m) for m in more))


def _mixed_texts(spark, d):
    return view(spark, d, "mixed_form", deal=True).select("doc_id", F.concat_ws("\n", "mail", "place").alias("text"))


def _placed(rows):
    return rows.select("doc_id", "label", F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("found"))


def _known_names(spark, d):
    units = view(spark, d, "kr_form", deal=True).select(F.floor(F.col("doc_id") / 10).alias("doc_id"), (F.col("doc_id") % 10).alias("ord"), F.transform(D.names_by_context(F.col("text")), lambda x: x["text"]).alias("names"))
    return D.known_before(units).select("doc_id", "ord", F.concat_ws(",", "known").alias("known"))


# Written out here, apart from the rules of the operators.
_MAIL = "[a-zA-Z0-9][a-zA-Z0-9._+-]*@[a-zA-Z0-9][a-zA-Z0-9.-]*\\.[a-zA-Z]{2,}"
_LOST = "[a-zA-Z0-9][a-zA-Z0-9._+-]*@[a-zA-Z0-9]+(?:com|net|org|co\\.?kr|kr|jp|cn|edu|gov)"
_MAILS = f"""with t as (select doc_id, mail, regexp_extract(mail, '{_MAIL}') as m, regexp_extract(mail, '{_LOST}') as o from {as_sql('mixed_form')}),
    u as (select *, string_split(o, '@')[2] as d from t where m = '' and o <> ''), v as (select *, case when d like '%com' then 3 when d like '%net' then 3 when d like '%org' then 3 when d like '%co.kr' then 5 when d like '%kr' then 2 else 3 end as n from u where not contains(d, '.'))
    select doc_id, cast(strpos(mail, m) - 1 as int) as s, cast(strpos(mail, m) - 1 + len(m) as int) as e, m as found, 1.0::double as confidence, 'regex-standard' as method from t where m <> ''
    union all select doc_id, cast(strpos(mail, o) - 1 as int), cast(strpos(mail, o) - 1 + len(o) as int), concat(left(o, len(o) - n), '.', right(o, n)), 0.95::double, 'regex' from v where len(d) - n >= 2"""
_FORMS = ("[가-힣]{2,}(?:특별시|광역시|도)\\s+[가-힣]{2,}(?:시|군|구)\\s+[가-힣]{2,}(?:로|길)\\s+\\d+[가-힣0-9\\s-]*", "[가-힣]{2,}\\s+[가-힣]{2,}(?:시|군|구)\\s+[가-힣]{2,}(?:로|길)?\\s*\\d*[가-힣0-9\\s-]*", "[가-힣]{2,}(?:시|군|구)\\s+[가-힣]{2,}(?:로|길)\\s+\\d+[가-힣0-9\\s-]*", "[가-힣]{2,}구\\s+[가-힣]{2,}(?:로|길)\\s+\\d+[가-힣0-9\\s-]*", "[가-힣]{2,}(?:시|구)\\s+[가-힣]{2,}동(?:\\s+\\d+)?")
_HITS = " union all ".join(f"select doc_id, place, unnest(regexp_extract_all(place, '{p}')) as m from {as_sql('mixed_form')}" for p in _FORMS)
_PLACES = f"""select distinct doc_id, cast(strpos(place, m) - 1 as int) as s, cast(strpos(place, m) - 1 + len(m) as int) as e, trim(m) as found, place from ({_HITS})
    where len(trim(m)) >= 8 and regexp_matches(trim(m), '[도시군구]') and regexp_matches(trim(m), '[로길동]') and not regexp_matches(trim(m), '[구시]$')
    and len(regexp_replace(m, '[^가-힣]', '', 'g')) >= 0.6 * len(regexp_replace(m, '\\s', '', 'g'))"""
_PARTS = "^(?:[\\s,]*(?:[가-힣a-zA-Z0-9]+(?:타운|빌라|맨션|아파트|오피스텔)|[가-힣0-9]+(?:동|호|층)|[0-9-]+(?:동|호|층)?))+"
_LONGER = f"""select doc_id, s, cast(e + n as int) as e, case when n > 0 then substr(place, s + 1, e + n - s) else found end as found from (select *, len(regexp_extract(substr(place, e + 1), '{_PARTS}')) as n from ({_PLACES}))"""
_TAIL = "(?:[0-9가-힣])((?:에|에서|로|으로)(?:\\s.*)?)$"
_REFINED = f"""with x as (select *, regexp_extract(found, '^(?:주\\s*소)\\s*[:.]?\\s*') as l from ({_LONGER})), y as (select doc_id, cast(s + len(l) as int) as s, e, substr(found, len(l) + 1) as f from x),
    z as (select *, regexp_extract(f, '{_TAIL}', 1) as t from y), c as (select *, (t like '에%' or t like '으로%' or (t like '로%' and regexp_matches(left(f, len(f) - len(t)), '(동|호|층|번지|[0-9])$'))) as cut from z)
    select doc_id, s, cast(case when cut then e - len(t) else e end as int) as e, case when cut then left(f, len(f) - len(t)) else f end as found from c where trim(f) <> ''"""

_TAGGED = lambda found: F.transform(found, lambda x: F.struct(F.lit("p_add").alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
_DISTINCT_ADDRESSES = lambda t: F.array_distinct(_TAGGED(D.addresses(t)))

QUERIES = {
    "pii_email_entities": lambda s, d: _mixed(s, d, "mail", D.emails, "confidence", "method"),
    "pii_address_entities": lambda s, d: _mixed(s, d, "place", _DISTINCT_ADDRESSES),
    "addresses_extended": lambda s, d: _mixed(s, d, "place", lambda t: D.addresses_extended(t, _DISTINCT_ADDRESSES(t))),
    "entities_refined": lambda s, d: _mixed(s, d, "place", lambda t: D.refined(D.addresses_extended(t, _DISTINCT_ADDRESSES(t)))),
    "pii_detect_all": lambda s, d: _placed(D.entities(_mixed_texts(s, d))),
    "pii_chain": lambda s, d: _placed(D.detected(_mixed_texts(s, d)).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")),
    "names_known_before": _known_names,
    "flagship_file_scan": _flagship,
    "pii_free_text_counts": _by_code("documents", _FREE),
    "pii_phone_counts": _by_code("kr_form", ("p_ph",)),
    "pii_rrn_counts": _by_code("kr_form", ("p_rrn",)),
    "pii_addresses": lambda s, d: D.entities(view(s, d, "kr_form", deal=True).select("doc_id", "text"), labels=("p_add",)).select("doc_id", "text").distinct(),
    "pii_email_values": lambda s, d: D.entities(view(s, d, "documents").select("doc_id", "text"), labels=("p_em",)).select("doc_id", "text"),
    "scan_rollup": lambda s, d: D.scan_rollup(view(s, d, "kr_form", deal=True)),
    "scan_status": lambda s, d: D.scan_rollup(view(s, d, "kr_form", deal=True)).groupBy("doc_id").agg(F.bool_or((F.col("total_count") > 0) | (F.col("masked_count") > 0)).alias("pii_detected"), F.sum("total_count").alias("total")),
    "scan_media": lambda s, d: view(s, d, "files").groupBy(D.media_of(F.col("name")).alias("media")).agg(F.count("*").alias("n")),
    "slot_parse": lambda s, d: D.slots(view(s, d, "kr_form", deal=True)),
    "slot_masked_counts": lambda s, d: D.slots(view(s, d, "kr_form", deal=True)).where(D.is_masked(F.col("value"))).groupBy("code").agg(F.count("*").alias("n")),
    "mask_documents": _masked_documents,
    "mask_lines": lambda s, d: D.mask_lines(view(s, d, "kr_form", deal=True), ("p_em", "p_rrn")),
    "names_by_context": lambda s, d: view(s, d, "kr_form", deal=True).select("doc_id", F.explode(D.names_by_context(F.col("text"))).alias("x")).select("doc_id", F.col("x.start").alias("at"), F.col("x.text").alias("name")),
    "names_lengthened": _stretched_names,
    "names_repeated": lambda s, d: _in_units(s, d).where("confidence = 0.9").drop("label", "confidence", "method"),
    "pii_units": _in_units,
    "phone_methods": lambda s, d: _in_units(s, d).where("label = 'p_ph'").groupBy("method").agg(F.count("*").alias("n")),
    "names_after_label_blocks": lambda s, d: D.names_after_label_blocks(_form_lines(s, d)),
    "greedy_spans": lambda s, d: D.greedy_spans(view(s, d, "spans_regex")),
    "confidence_filter": lambda s, d: D.confident(view(s, d, "spans_ner")).select("unit", "ord", "label"),
    "overlap_anti_join": lambda s, d: D.not_overlapping(view(s, d, "spans_ner").select("unit", "ord", "s", "e"), view(s, d, "spans_regex")),
    "bio_spans": lambda s, d: D.bio_spans(view(s, d, "tokens")).withColumn("confidence", F.round("confidence", 6)),
    "stats_by_label_method": lambda s, d: D.span_stats(view(s, d, "spans_ner")).withColumn("avg_confidence", F.round("avg_confidence", 6)),
}

def _both(places: str) -> str:
    mails = f"select doc_id, 'p_em' as label, s, e, found from ({_MAILS})"
    return f"{mails} union all select doc_id, 'p_add', cast(s + len(mail) + 1 as int), cast(e + len(mail) + 1 as int), found from ({places}) join (select doc_id as d, mail from {as_sql('mixed_form')}) on doc_id = d"


# Names, phones, addresses of the units with names, told by what each kind of unit is known to hold; places of known names by their last two characters.
_AT = "cast(strpos(text, {0}) - 1 as int) as s, cast(strpos(text, {0}) - 1 + len({0}) as int) as e, {0} as found"
_UNIT_ROWS = f"select *, regexp_extract(text, '(?:이름은 |성명: )([가-힣]{{2,4}})', 1) as n from {as_sql('name_units')}"
_UNIT_NAMES = f"""select doc_id, ord, {_AT.format("x")} from (select *, n as x from ({_UNIT_ROWS}) where n <> '' union all select *, 'Kim' from ({_UNIT_ROWS}) where ord = 3 union all select *, '남궁민' from ({_UNIT_ROWS}) where ord = 4)"""
_UNIT_PLACES = f"""with u as materialized ({_UNIT_ROWS}), names as materialized ({_UNIT_NAMES}),
    phones as (select doc_id, ord, text, unnest([concat('010-1234-', 1000 + k % 9000), '02-345-6789', '070-345-6789', concat('0101234', 1000 + k % 9000)]) as x, unnest(['regex-mobile', 'regex-landline', 'regex-general', 'again']) as method from u where ord = 6),
    ips as (select doc_id, ord, text, unnest(list_filter([concat('10.0.', k % 300, '.7'), concat(k % 9, '.1.2.3'), concat('1.2.3.', k)], lambda x: cast(string_split(x, '.')[3] as int) < 256 and cast(string_split(x, '.')[4] as int) < 256)) as x from u where ord = 5),
    places as (select doc_id, ord, text, unnest([concat('서울특별시 강남구 테헤란로 ', k % 90 + 1), concat('강남구 테헤란로 ', k % 90 + 1)]) as x from u where ord = 2 union all select doc_id, ord, text, concat('강남구 수민로 ', k % 90 + 1) from u where ord = 7),
    found as materialized (
        select doc_id, ord, 'p_nm' as label, s, e, found, case when ord = 4 then 0.8 else 0.85 end::double as confidence, case when ord = 4 then 'koelectra' else 'regex_context' end as method from names
        union all select doc_id, ord, 'p_ph', {_AT.format("x")}, 1.0, method from phones where method <> 'again'
        union all select doc_id, ord, 'p_ip', {_AT.format("x")}, 1.0, 'regex' from ips
        union all select distinct doc_id, ord, 'p_add', {_AT.format("x")}, 1.0, 'regex' from places),
    terms as (select doc_id, right(found, 2) as term, min(ord) as since from names group by 1, 2),
    twos as (select doc_id, ord, i as s, i + 1 as e, substr(text, i, 2) as found from (select *, unnest(range(1, len(text))) as i from u)),
    again as materialized (
        select t.doc_id, t.ord, cast(t.s - 1 as int) as s, cast(t.e as int) as e, t.found from twos t join terms x on x.doc_id = t.doc_id and x.term = t.found and x.since <= t.ord
        where not exists (select 1 from found f where f.doc_id = t.doc_id and f.ord = t.ord and f.s < t.e and t.s - 1 < f.e))"""


ORACLES = {
    "pii_email_entities": _MAILS,
    "pii_address_entities": f"select doc_id, s, e, found from ({_PLACES})",
    "addresses_extended": _LONGER,
    "entities_refined": _REFINED,
    "pii_detect_all": _both(_PLACES),
    "pii_chain": _both(_REFINED),
    "names_known_before": f"""with n as (select doc_id // 10 as doc_id, doc_id % 10 as ord, case doc_id % 5 when 2 then '김철수' when 3 then '이영희' when 4 then '박민수' end as name from {as_sql('kr_form')})
        select a.doc_id, a.ord, coalesce((select string_agg(distinct b.name, ',' order by b.name) from n b where b.doc_id = a.doc_id and b.ord < a.ord), '') as known from n a""",
    "pii_free_text_counts": _counts(("EM", "IP", "PP"), "documents"),
    "pii_phone_counts": _counts(("PH",), "kr_form"),
    "pii_rrn_counts": _counts(("RRN",), "kr_form"),
    "pii_addresses": f"select doc_id, unnest({_ADDRESSES}) as text from {as_sql('kr_form')}",
    "pii_email_values": f"select doc_id, unnest({_FOUND['EM']}) as text from documents",
    "scan_rollup": _ROLLUP,
    "scan_status": f"select doc_id, bool_or(total_count > 0 or masked_count > 0) as pii_detected, cast(sum(total_count) as bigint) as total from ({_ROLLUP}) group by 1",
    "scan_media": f"select case when regexp_matches(lower(name), '\\.(pdf|docx?|txt|xlsx?)$') then 'DOCUMENT' when regexp_matches(lower(name), '\\.png$') then 'PHOTO' when regexp_matches(lower(name), '\\.mp3$') then 'AUDIO' when regexp_matches(lower(name), '\\.mp4$') then 'VIDEO' end as media, count(*) as n from {as_sql('files')} group by 1",
    "slot_parse": _slot_sql(),
    "slot_masked_counts": f"select code, count(*) as n from ({_slot_sql()}) where {_MASKED} group by 1",
    "mask_documents": _STARRED,
    "mask_lines": f"select doc_id, regexp_replace(regexp_replace(text, '[0-9]{{6}}-[1-4][0-9]{{6}}', '**************'), 'user[0-9]+@example\\.com', repeat('*', len(regexp_extract(text, 'user[0-9]+@example\\.com')))) as text from {as_sql('kr_form')}",
    "names_by_context": f"select doc_id, cast(strpos(text, n) - 1 as int) as at, n as name from (select doc_id, text, unnest(regexp_extract_all(text, '(?:이름|성명|성함)[은는이가\\s]*[:\\s]\\s*([가-힣]{{2,4}})(?:[이가은는을를]|\\s|[.,]|$)', 1)) as n from {as_sql('kr_form')})",
    "names_lengthened": f"select doc_id, ord, s, e, found from ({_UNIT_NAMES})",
    "names_repeated": f"{_UNIT_PLACES} select doc_id, ord, s, e, found from again",
    "pii_units": f"{_UNIT_PLACES} select * from found union all select doc_id, ord, 'p_nm', s, e, found, 0.9::double, '' from again",
    "phone_methods": f"{_UNIT_PLACES} select method, count(*) as n from found where label = 'p_ph' group by 1",
    "names_after_label_blocks": f"""with u as (select doc_id, unnest(range(len(l))) as ord, unnest(l) as text from (select doc_id, string_split(replace(text, ': ', chr(10)), chr(10)) as l from {as_sql('kr_form')})),
        b as (select *, lag(text) over (partition by doc_id order by ord) as b from u)
        select doc_id, cast(ord as int) as ord, text from b where len(b) < 20 and regexp_matches(b, '성명|이름') and regexp_matches(text, '^[가-힣]{{2,4}}$') and not regexp_matches(text, '성명|생년월일|주소|연락처|이메일|학점|지원분야|경력여부')""",
    "greedy_spans": f"""with recursive x as materialized (select unit, s, e, row_number() over (partition by unit order by s, e) as k from {as_sql('spans_regex')}),
        r as (select unit, k, s, e, [struct_pack(s := s, e := e)] as kept from x where k = 1 union all
            select x.unit, x.k, x.s, x.e, case when len(list_filter(kept, lambda y: x.e > y.s and y.e > x.s)) > 0 then kept else list_append(kept, struct_pack(s := x.s, e := x.e)) end from r join x on x.unit = r.unit and x.k = r.k + 1),
        z as (select unit, unnest(max_by(kept, k)) as y from r group by unit) select unit, y.s as s, y.e as e from z""",
    "confidence_filter": f"select unit, ord, label from {as_sql('spans_ner')} where confidence >= case label when 'p_nm' then 0.70 when 'p_add' then 0.70 else 0.75 end",
    "overlap_anti_join": f"select unit, ord, s, e from {as_sql('spans_ner')} a where not exists (select 1 from {as_sql('spans_regex')} b where a.unit = b.unit and not (a.e <= b.s or b.e <= a.s))",
    "bio_spans": f"""with t as (select *, substr(tag, 3) as label, lag(tag) over (partition by unit order by ord) as b from {as_sql('tokens')}),
        g as (select *, sum(case when tag like 'B-%' or (tag like 'I-%' and (b is null or b = 'O' or substr(b, 3) <> label)) then 1 else 0 end) over (partition by unit order by ord) as k from t)
        select unit, min(s) as s, max(e) as e, min(label) as label, round(avg(prob), 6) as confidence from g where tag <> 'O' group by unit, k""",
    "stats_by_label_method": f"select label, coalesce(method, 'koelectra') as method, count(*) as n, round(avg(confidence), 6) as avg_confidence from {as_sql('spans_ner')} group by 1, 2",
}
