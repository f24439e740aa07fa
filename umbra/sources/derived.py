"""Base tables of a folder, and inputs derived from them where no base table holds the patterns an operator looks for.

A derived input is one SQL text that Spark and an independent engine both read: {name} stands for a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import dealt

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_DIGITS = "lpad(cast(({0}) % 10000 as string), 4, '0')"

VIEWS = {
    "kr_form": f"""select c_custkey as doc_id, concat('성명: ', case c_custkey % 5 when 0 then '홍*동' when 1 then '' when 2 then '김철수' when 3 then '이영희' else '박민수' end, chr(10),
        '연락처: ', case c_custkey % 7 when 0 then '***' when 1 then '010-****-5678' else concat('010-', {_DIGITS.format('c_custkey')}, '-', {_DIGITS.format('c_custkey * 7')}) end, chr(10),
        '주민번호: ', lpad(cast(c_custkey % 1000000 as string), 6, '0'), '-', cast(1 + c_custkey % 4 as string), lpad(cast(c_custkey * 13 % 1000000 as string), 6, '0'), chr(10),
        '주소: 서울특별시 강남구 테헤란로 ', cast(1 + c_custkey % 300 as string), chr(10), '이메일: user', cast(c_custkey as string), '@example.com') as text from {{customer}}""",
    "col_values": f"""select c_custkey as k, c_custkey % 9 as kind, case c_custkey % 9 when 0 then concat('010-', {_DIGITS.format('c_custkey')}, '-', {_DIGITS.format('c_custkey * 7')})
        when 1 then concat('850101-1', lpad(cast(c_custkey % 1000000 as string), 6, '0')) when 2 then concat('user', cast(c_custkey as string), '@mail.example.com')
        when 3 then concat('004', lpad(cast(c_custkey as string), 9, '0')) when 4 then concat('M', lpad(cast(c_custkey as string), 8, '0'))
        when 5 then concat('10.0.', cast(c_custkey % 256 as string), '.7') when 6 then concat('2024-', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '-15')
        when 7 then case when c_custkey % 2 = 0 then '김*수' else '김철수' end else md5(cast(c_custkey as string)) end as value from {{customer}}""",
    "name_units": """select floor(k / 8) as doc_id, k % 8 as ord, k, case k % 8 when 0 then concat('성명: ', n, ', 담당') when 1 then concat(g, '가 왔다. ', g, '와 ', n, '의 글') when 2 then concat('이름은 ', n, ' 주소: 서울특별시 강남구 테헤란로 ', k % 90 + 1)
        when 3 then concat('Name: Kim', k % 10, ' 그리고 수민, 철수') when 4 then concat('담당 남궁민 과장, 궁민과 ', g) when 5 then concat('서버 10.0.', k % 300, '.7. 그리고 ', k % 9, '.1.2.3.4 or 1.2.3.', k) when 6 then concat('전화 010-1234-', 1000 + k % 9000, ', 02-345-6789, 070-345-6789 또는 0101234', 1000 + k % 9000, ' ', g)
        else concat('강남구 수민로 ', k % 90 + 1, ', 영희를 봤다. 성명: ', n, '.') end as text,
        case when k % 8 = 4 then '남궁' else '' end as told from (select c_custkey as k, case c_custkey % 5 when 0 then '김철수' when 1 then '이영희' when 2 then '박민수' when 3 then '최수민' else '강희' end as n, case c_custkey % 5 when 0 then '철수' when 1 then '영희' when 2 then '민수' when 3 then '수민' else '강희' end as g from {customer})""",
    "mixed_form": """select c_custkey as doc_id, concat(case c_custkey % 6 when 0 then '메일 ' when 1 then 'E-mail: ' else '' end,
        case c_custkey % 8 when 0 then concat('user', c_custkey, '@example.com') when 1 then concat('a.b', c_custkey, '@examplecom') when 2 then concat('kim', c_custkey, '@naverco.kr')
        when 3 then concat('u', c_custkey, '@com') when 4 then concat('u_', c_custkey, '@hostnet') when 5 then concat('v', c_custkey, '@siteorg, x') when 6 then concat('w', c_custkey, '@mailkr') else 'none @ all' end) as mail,
        concat('주소: ', case c_custkey % 7 when 0 then concat('서울특별시 강남구 테헤란로 ', c_custkey % 90 + 1) when 1 then concat('서울 강남구 테헤란로 ', c_custkey % 90 + 1, ', 행복아파트 3동 401호에서 만남')
        when 2 then concat('수원시 권선길 ', c_custkey % 90 + 1, ' 2층') when 3 then '강남구 역삼동 12, 오피스텔' when 4 then '강남구 역삼동12' when 5 then concat('경기도 성남시 분당로 ', c_custkey % 90 + 1, '로 가다') else '서울 강남구' end) as place from {customer}""",
    "spans_regex": "select l_orderkey as unit, l_linenumber as ord, cast(l_partkey % 100 as int) as s, cast(l_partkey % 100 + 1 + floor(l_quantity) % 9 as int) as e from {lineitem} where l_linenumber % 2 = 0",
    "spans_ner": "select l_orderkey as unit, l_linenumber as ord, cast(l_partkey % 100 as int) as s, cast(l_partkey % 100 + 1 + floor(l_quantity) % 9 as int) as e, case l_linenumber % 3 when 0 then 'p_nm' when 1 then 'p_add' else 'p_other' end as label, 0.6 + l_discount * 4 as confidence, case when l_linenumber % 5 = 1 then null else 'koelectra' end as method from {lineitem} where l_linenumber % 2 = 1",
    "tokens": "select l_orderkey as unit, l_linenumber * 10000000000 + l_partkey * 100 + cast(floor(l_quantity) as bigint) as ord, l_linenumber * 4 as s, l_linenumber * 4 + 3 as e, case when l_linenumber % 4 = 0 then 'O' when l_linenumber % 4 = 1 then 'B-p_nm' when floor(l_quantity) % 3 = 0 then 'I-p_add' else 'I-p_nm' end as tag, 0.5 + l_discount as prob from {lineitem}",
    "db_server_connections": "select s_suppkey as id, s_name as connection_name, cast(s_nationkey % 7 as int) as dbms_type_id from {supplier}",
    "dbms_types": "select r_regionkey as id, r_name as name from {region}",
    "db_pii_columns": "select p_partkey as id, p_name as name, p_size * 10 as total_records_count, case when p_size > 30 then 'HIGH' else 'LOW' end as risk_level from {part}",
    "db_pii_issues": "select o_orderkey as id, o_orderkey % 2500 as column_id, o_custkey % 120 as db_server_connection_id, case when o_orderstatus = 'O' then 'ACTIVE' else 'RESOLVED' end as issue_status from {orders}",
    "file_server_connections": "select n_nationkey as id, n_name as connection_name from {nation}",
    "files": "select doc_id as id, concat('f', cast(doc_id as string), case doc_id % 6 when 0 then '.pdf' when 1 then '.TXT' when 2 then '.png' when 3 then '.mp3' when 4 then '.mp4' else '' end) as name, lang as file_type from {documents}",
    "file_pii": "select doc_id as id, doc_id as file_id, n_chars % 17 as total_piis_count, n_chars % 5 as masked_piis_count from {documents}",
    "file_pii_issues": "select o_orderkey as id, o_orderkey % 1200 as file_id, o_custkey % 30 as file_server_connection_id, case when o_orderstatus = 'F' then 'ACTIVE' else 'RESOLVED' end as issue_status from {orders}",
    "table_constraints": "select case n_regionkey % 2 when 0 then 'public' else 'app' end as table_schema, concat('t', n_nationkey) as table_name, concat('c', n_nationkey) as constraint_name, case n_nationkey % 4 when 3 then 'FOREIGN KEY' else 'PRIMARY KEY' end as constraint_type from {nation}",
    "key_column_usage": "select case n_regionkey % 2 when 0 then 'public' else 'app' end as table_schema, concat('t', n_nationkey) as table_name, concat('c', n_nationkey) as constraint_name, concat('k', 4 - k) as column_name, k as ordinal_position from {nation} cross join (select 1 as k union all select 2 union all select 3) as ks where k <= 1 + n_nationkey % 3",
    "catalog_columns": "select case n_regionkey % 2 when 0 then 'public' else 'app' end as table_schema, concat('t', n_nationkey) as table_name, concat('v', k) as column_name, (k * 3 + n_nationkey) % 7 as ordinal_position from {nation} cross join (select 1 as k union all select 2 union all select 3 union all select 4) as ks where n_nationkey % 12 <> 11",
    "requested_tables": "select n_nationkey as id, case n_nationkey % 3 when 0 then concat(' app . ', lower(n_name), '.x') when 1 then concat('public.', lower(n_name)) else concat(' ', lower(n_name), ' ') end as name, case n_nationkey % 4 when 0 then 'MySQL 8' when 1 then 'ORACLE' when 2 then 'PostgreSQL' end as dbms, case when n_regionkey > 0 then concat('db', n_regionkey) end as db_name, concat('owner', n_regionkey) as username from {nation}",
    "file_connections": "select n_nationkey as id, case n_nationkey % 5 when 0 then concat(' HTTP://h', n_nationkey, '/') when 1 then concat('a', n_nationkey, '.ngrok.io') when 2 then '' else concat('files', n_nationkey, '.example.com') end as host, case n_nationkey % 4 when 0 then 0 when 1 then 80 when 2 then 443 end as port, case n_nationkey % 3 when 0 then ' /data/x// ' when 1 then '' end as default_path, n_nationkey % 7 as server_type_id, case n_nationkey % 2 when 0 then ' /a/b.txt' else '' end as path from {nation}",
    "server_types": "select r_regionkey as id, case r_regionkey when 2 then '' else concat('type ', r_name) end as name from {region}",
    "replies": """select conv_id, turn, text, case (conv_id + turn) % 8 when 0 then concat('관련성 점수: 0.7', chr(10), '관련성 여부: no') when 1 then concat('관련성 여부: yes', chr(10), '점수: 0.1') when 2 then '점수: 1.75'
        when 3 then concat('점수 없음', chr(10), '여부: 아니오', chr(10), '여부: 있다') when 4 then concat('정확성: 0.9', chr(10), 'Completeness 0.25', chr(10), 'confidence: 3', chr(10), 'accuracy of confidence 0.4')
        when 5 then concat('x<|start_header_id|>assistant<|end_header_id|> ', text, '<|eot_id|>') when 6 then concat('so: {{"entities": {{"law": ["b", "a"]}}, "facts": ["f', turn, '"]}} end')
        else concat('Could not parse LLM output: x', chr(10), '**ID: 5**', chr(10), '- Status ok', chr(10), 'visit: http://a', chr(10), '# Name b', chr(10), 'ab1', chr(10), 'plain words') end as reply from {conversations}""",
    "law_pages": """select p_partkey as doc, case p_partkey % 3 when 0 then concat('https://law.example.com/', p_partkey, '.pdf') when 1 then concat('/data/개인정보 ', p_partkey, '.PDF') else concat('n', p_partkey, '.pdf') end as path,
        concat(case p_partkey % 4 when 0 then '개인정보 보호법' when 1 then concat('안내', chr(10), ' 법', chr(10), '정보통신 규정 제1장') when 2 then 'none' else '가법' end, chr(10),
        case p_partkey % 5 when 0 then concat('[시행 2023.', p_partkey % 12 + 1, '.', p_partkey % 28 + 1, '] 개정 2021 3 4') when 1 then '공포 2020.13.1, 1999.12.31' when 2 then concat('page ', p_partkey % 90 + 2000, '.1.2') else '' end) as text from {part}""",
    "law_sheets": """select p_partkey % 40 as doc_id, p_partkey as page, case when p_partkey % 40 % 5 = 0 then repeat(concat(p_name, ' words. '), 1 + p_partkey % 90) else case (p_partkey + cast(floor(p_partkey / 40) as bigint)) % 6
        when 0 then concat('Preface', chr(10), '  제 ', p_size, ' 조 (', p_type, ')', chr(10), chr(10), '① ', p_name, chr(10), '1.', p_brand, chr(10), '2의3.  x', chr(10), '가.') when 1 then concat(p_name, chr(10), '②', p_type, chr(10), '제 2 항')
        when 2 then concat('제', p_size, '조의 2', chr(10), 'body ', p_name, chr(10), '제 ', p_size, '조', chr(10), '나. ', p_type) when 3 then concat('제 3 항  the ', p_name, chr(10), ' ', chr(10), 'more') when 4 then p_name else '' end end as text from {part}""",
    "file_words": "select user_id as audio, event_id as ord, case event_id % 4 when 0 then concat(' ', event_type) when 1 then concat(event_type, 's') else event_type end as word, cast(event_id % 5000 as double) / 10 as start_time, cast(event_id % 5000 as double) / 10 + floor(value) / 100 as end_time from {events}",
    "wanted_texts": "select c_custkey as audio, k as entity, case k when 1 then 'click' when 2 then 'licks' when 3 then ' purchase ' when 4 then 'view purchase' when 5 then '' else 'nothing' end as text from {customer} cross join (select 1 as k union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) as ks",
    "frame_boxes": "select event_id as id, user_id % 20 as video, event_type as label, cast(event_id % 300 + 1 as int) as frame, cast(user_id % 50 as int) - 2 as x, cast(user_id % 31 as int) as y, cast(10 + floor(value) % 40 as int) as w, cast(floor(value) % 25 as int) as h, (event_id % 100) / 100.0 as confidence from {events}",
    "word_times": "select user_id as audio, event_id as ord, event_type as word, cast(event_id % 5000 as double) / 10 as start_time, cast(event_id % 5000 as double) / 10 + floor(value) / 100 as end_time from {events}",
    "dict_lines": "select n_regionkey as doc, n_nationkey * 10 + k as ord, case k when 0 then substr(regexp_replace(upper(n_name), '[^A-Z]+', ''), 1, 10) when 1 then concat('항목', cast(n_nationkey as string)) when 2 then n_name when 3 then concat('설명 ', cast(n_nationkey % 3 as string)) when 4 then 'Y' when 5 then '비고' else case when n_nationkey = 17 then '3.1 끝' else 'ABC' end end as line from {nation} cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) as ks where k < 5 or (k = 5 and n_nationkey % 4 = 0) or (k = 6 and n_nationkey % 5 = 2) union all select r_regionkey, k - 10, case k when 1 then '영문약어' when 2 then '한글명' when 3 then '영문풀네임' when 4 then '설명' else 'PI여부' end from {region} cross join (select 1 as k union all select 2 union all select 3 union all select 4 union all select 5) as hs",
    "questions": """select conv_id, turn, (conv_id * 3 + turn) % 12 as form, case (conv_id * 3 + turn) % 12 when 0 then concat('DB 말고 파일서버 이슈 ', turn) when 1 then concat('파일 말고 DB서버 현황 ', conv_id) when 2 then concat('어떤 법령을 위반하는지 파일 ', turn, ' 기준으로')
        when 3 then concat('어떤  규정이 있나요 ', conv_id) when 4 then concat('제', conv_id % 99 + 1, '조 내용') when 5 then concat(turn + 1, '조는?') when 6 then concat('파일서버 이슈 개수 ', conv_id) when 7 then concat('DB서버 ', conv_id, ' 관련 규정')
        when 8 then '개인정보 보호 지침' when 9 then concat('매출 통계 ', conv_id) when 10 then concat('COUNT Rows ', turn) else concat('안녕하세요 ', conv_id) end as text from {conversations}""",
    "statements": """select p_partkey as id, case p_partkey % 14 when 0 then concat('SELECT ', p_name, ' FROM files') when 1 then concat('SELECT a -- drop ', p_name, chr(10), 'FROM files') when 2 then concat('select /* delete', chr(10), p_type, ' */ name from t') when 3 then concat('drop table ', p_brand)
        when 4 then 'SELECT * FROM users u' when 5 then concat('select id from t join  users on 1=', p_size) when 6 then concat('SELECT ', p_name, ', Password FROM c') when 7 then 'select created_at, updated from files' when 8 then concat('  select token_count from t', p_size) when 9 then 'with q as (select 1) select * from q'
        when 10 then concat('select users.id from t where a = ', p_size) when 11 then concat('select name from c where exec = ', p_size) when 12 then concat('select a', chr(10), 'token from t', p_size) else p_name end as txt from {part}""",
    "results": """select c_custkey as id, case c_custkey % 7 when 0 then concat('name: ', c_name, chr(10), 'password: ', c_mktsegment) when 1 then concat('Token = ', c_mktsegment, chr(10), 'rows ', c_custkey) when 2 then concat('the Users table', chr(10), c_name) when 3 then concat('secret column is there', chr(10), c_name)
        when 4 then concat('API-KEY: ', c_mktsegment, chr(10), chr(10), 'api_key') when 5 then concat('user_id ', c_custkey, chr(10), 'plain') else c_name end as txt from {customer}""",
    "marked_answers": """select p_partkey as id, p_partkey % 8 as form, p_name as a, p_type as b, case p_partkey % 8 when 0 then concat('**', p_name, '** 와 *', p_type, '*') when 1 then concat('## ', p_name, chr(10), '본문 `', p_type, '`') when 2 then concat('[', p_name, '](http://x/', p_partkey, ') ~~', p_type, '~~')
        when 3 then concat('__', p_name, '__ _', p_type, '_') when 4 then concat('그대로 2 * ', p_size) when 5 then '' when 6 then concat(chr(10), ' ', p_name, '  ') else concat(p_name, ' #', p_size) end as txt, p_size as n from {part}""",
    "kind_replies": """select s_suppkey as id, s_suppkey % 6 as form, case s_suppkey % 6 when 0 then concat('Vector_Search 입니다 ', s_suppkey) when 1 then concat('type: db_query. ', s_suppkey) when 2 then 'both_or general' when 3 then concat('x', s_suppkey, 'db_queryx') when 4 then concat('모름 ', s_suppkey) else concat('BOTH, not general ', s_suppkey) end as txt from {supplier}""",
    "label_replies": """select p_partkey as id, p_partkey % 5 as form, p_size as n, case p_partkey % 5 when 0 then concat('결과: ```json [{{"tableName": "t', p_size, '", "columnName": "c", "piiType": "NM"}}] ``` 끝') when 1 then concat('[{{"tableName": "a", "columnName": "b"}}, {{"tableName": "u", "columnName": "d', p_size, '", "piiType": "PH"}}, {{"tableName": "v", "columnName": "", "piiType": "EM", "more": 1}}] 끝')
        when 2 then concat('없음 ', p_size) when 3 then '[깨짐' else '[]' end as txt from {part}""",
    "law_lines": "select p_brand as doc, p_partkey as ord, case p_partkey % 7 when 0 then concat('제', cast(p_partkey % 40 as string), '조(', p_type, ')') when 1 then concat('① ', p_name) when 2 then '제1항' when 3 then concat('1. ', p_name) when 4 then concat('가. ', p_name) when 5 then concat(p_name, '.') else p_name end as line from {part}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    """A derived input, or a base table. deal: rows of base tables are dealt to all tasks before anything is derived from them."""
    found = dealt if deal else lambda df: df
    if name in TABLES:
        return found(table(spark, sf_dir, name))
    text = VIEWS[name]
    return spark.sql(text, **{t: found(table(spark, sf_dir, t)) for t in TABLES if f"{{{t}}}" in text})


def as_sql(name: str) -> str:
    """The derived input as a subquery over base tables."""
    return name if name in TABLES else "(" + VIEWS[name].format(**{t: t for t in TABLES}) + ")"
