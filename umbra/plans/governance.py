"""Queries on inventory and issue tables, and on statements and results to be guarded."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import govern as G
from ..sources.derived import as_sql, view

def _joined(text: str, names: tuple[str, ...]):
    """The same statement for Spark, over views of the inputs, and as a stand-alone one."""
    return (lambda spark, d: spark.sql(text, **{n: view(spark, d, n) for n in names}), text.format(**{n: as_sql(n) for n in names}))


_SAME = {
    "gov_column_issue_detail": _joined("select c.name as column_name, c.risk_level, c.total_records_count, i.issue_status, s.connection_name from {db_pii_issues} i join {db_pii_columns} c on i.column_id = c.id join {db_server_connections} s on i.db_server_connection_id = s.id where i.issue_status = 'ACTIVE'", ("db_pii_issues", "db_pii_columns", "db_server_connections")),
    "gov_file_issue_detail": _joined("select f.name as file_name, f.file_type, p.total_piis_count, p.masked_piis_count, i.issue_status from {file_pii_issues} i join {files} f on i.file_id = f.id join {file_pii} p on i.file_id = p.file_id where i.issue_status = 'ACTIVE'", ("file_pii_issues", "files", "file_pii")),
    "gov_file_pii_counts": _joined("select f.name, p.total_piis_count from {file_pii} p join {files} f on p.file_id = f.id", ("file_pii", "files")),
    "gov_connections_with_type": _joined("select c.id, c.connection_name, t.name as dbms_name from {db_server_connections} c left join {dbms_types} t on c.dbms_type_id = t.id", ("db_server_connections", "dbms_types")),
}

QUERIES = {
    **{k: v[0] for k, v in _SAME.items()},
    "gov_issues_per_server": lambda s, d: G.issues_per_server(view(s, d, "db_pii_issues"), view(s, d, "db_server_connections"), "db_server_connection_id"),
    "gov_file_issues_per_server": lambda s, d: G.issues_per_server(view(s, d, "file_pii_issues"), view(s, d, "file_server_connections"), "file_server_connection_id"),
    "sql_guard": lambda s, d: view(s, d, "statements").select("id", G.is_safe(F.col("txt")).alias("safe")),
    "result_scrub": lambda s, d: view(s, d, "results").select("id", G.scrubbed(F.col("txt")).alias("txt")),
    "col_encryption_summary": lambda s, d: G.encryption_summary(view(s, d, "col_values"), "k", "value", F.col("kind") != 8),
}

_WRITE = "drop|delete|truncate|alter|create|insert|update|grant|revoke|exec|execute"
_SECRET = "password|pwd|passwd|secret|credential|token|api_key|encrypted_password"
_VALUED = "(password|pwd|passwd|secret|credential|token|api[_-]?key|encrypted[_-]?password)\\s*[:=]"

ORACLES = {
    **{k: v[1] for k, v in _SAME.items()},
    "gov_issues_per_server": f"select connection_name, count(i.id) as n_issues from {as_sql('db_pii_issues')} i join {as_sql('db_server_connections')} c on i.db_server_connection_id = c.id where issue_status = 'ACTIVE' group by 1",
    "gov_file_issues_per_server": f"select connection_name, count(i.id) as n_issues from {as_sql('file_pii_issues')} i join {as_sql('file_server_connections')} c on i.file_server_connection_id = c.id where issue_status = 'ACTIVE' group by 1",
    "sql_guard": f"""select id, regexp_matches(c, '^\\s*select') and not regexp_matches(c, '\\b({_WRITE})\\b') and not regexp_matches(c, '\\b(from|join)\\s+users\\b|\\busers\\.') and not regexp_matches(c, 'select\\s+.*?\\b({_SECRET})\\b') as safe
        from (select id, regexp_replace(regexp_replace(lower(txt), '--[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') as c from {as_sql('statements')})""",
    "result_scrub": f"""select id, case when regexp_matches(txt, '(?i)\\busers\\b') then '보안상의 이유로 해당 정보는 제공할 수 없습니다.' else array_to_string(list_filter(string_split(regexp_replace(txt, '{_VALUED}\\s*[^\\n]+', '[민감한 정보는 보호됩니다]', 'gi'), chr(10)),
        lambda x: not regexp_matches(lower(x), '{_SECRET}') or regexp_matches(lower(x), '{_VALUED}')), chr(10)) end as txt from {as_sql('results')}""",
    "col_encryption_summary": f"""with v as (select * from {as_sql('col_values')} where value is not null), f as (select k from v where kind <> 8 order by k limit 10)
        select (select count(*) from v) as total_records, (select count(*) from v where kind = 8) as encrypted_records, (select string_agg(cast(k as string), ',' order by k) from f) as first_keys, '안되어있음' as status""",
}

_TEXT_KEYS = as_sql("col_values")
QUERIES["col_encryption_text_keys"] = lambda s, d: G.encryption_summary(view(s, d, "col_values").selectExpr("case when k % 11 > 0 then concat('c', k) end as k", "value", "kind"), "k", "value", F.col("kind") != 8)
ORACLES["col_encryption_text_keys"] = f"""select count(*) as total_records, count(*) filter (kind = 8) as encrypted_records, (select string_agg(c, ',' order by c) from (select concat('c', k) as c from {_TEXT_KEYS} where value is not null and kind <> 8 and k % 11 > 0 order by c limit 10)) as first_keys,
    '안되어있음' as status from {_TEXT_KEYS} where value is not null"""
