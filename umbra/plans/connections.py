"""Queries on stored connections, catalogs and encoded values, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connections as C
from ..sources.derived import as_sql, view

_KEY = "0123456789abcdef0123456789abcdef"


def _names(s, d):
    rows = view(s, d, "requested_tables").withColumn("kind", C.dialect(F.col("dbms")))
    rows = rows.withColumn("t", C.table_of(F.col("name"), F.col("kind"), F.col("db_name"), F.col("username")))
    return rows.select("id", "kind", F.col("t.schema").alias("schema_name"), C.quoted(F.col("t.table"), F.col("kind")).alias("table_name"))


def _keys(s, d):
    tables = view(s, d, "nation").select(F.expr("case n_regionkey % 2 when 0 then 'public' else 'app' end").alias("table_schema"), F.expr("concat('t', n_nationkey)").alias("table_name"))
    rows = C.key_columns(tables, view(s, d, "table_constraints"), view(s, d, "key_column_usage"), view(s, d, "catalog_columns"))
    return rows.select("table_schema", "table_name", F.concat_ws(",", "key_columns").alias("key_columns"))


def _status(s, d):
    kinds = s.range(11).select(F.col("id").alias("kind"))  # kinds without values, too
    values = view(s, d, "col_values").select("kind", "value")
    return kinds.join(values, "kind", "left").groupBy("kind").agg(C.sample_status(F.col("value"), F.col("kind") != 8).alias("status"))


def _uploads(s, d):
    data = F.concat(F.when(F.col("doc_id") % 3 == 0, "data:text/plain;base64,").otherwise(""), C.encoded(F.col("text").cast("binary")))
    return view(s, d, "documents").withColumn("data", data).select("doc_id", C.is_encoded(F.col("data")).alias("encoded"), C.decoded(F.col("data")).cast("string").alias("text"))


def _secrets(s, d):
    rows = view(s, d, "supplier").withColumn("stored", F.base64(F.aes_encrypt(F.col("s_name").cast("binary"), F.lit(_KEY), F.lit("GCM"))))
    return rows.select("s_suppkey", C.secret(F.col("stored"), _KEY).alias("secret"), C.secret(F.concat(F.lit(" "), F.col("s_name")), "short key").alias("unencrypted"))


def _urls(s, d):
    rows = C.file_connections(view(s, d, "file_connections"), view(s, d, "server_types"))
    return rows.select("id", C.file_url(F.col("host"), F.col("port"), F.col("default_path"), F.col("path")).alias("url"))


QUERIES = {
    "file_connection_info": lambda s, d: C.file_connections(view(s, d, "file_connections"), view(s, d, "server_types")).select("id", "host", "port", "default_path", "server_type_name"),
    "file_urls": _urls,
    "connection_info": lambda s, d: view(s, d, "db_server_connections").where("id % 3 = 1").select("id", "connection_name", "dbms_type_id"),
    "catalog_primary_keys": lambda s, d: C.primary_keys(view(s, d, "table_constraints"), view(s, d, "key_column_usage")).select("table_name", F.concat_ws(",", "key_columns").alias("key_columns")),
    "catalog_first_columns": lambda s, d: C.first_columns(view(s, d, "catalog_columns")).select("table_name", "first_column"),
    "catalog_key_columns": _keys,
    "table_names": _names,
    "column_sample": lambda s, d: C.sampled(view(s, d, "col_values").withColumn("value", F.expr("case when k % 4 = 0 then '  ' when k % 4 = 1 then null else concat(' ', value) end")), "k", "value"),
    "sample_status": _status,
    "base64_round_trip": _uploads,
    "stored_secrets": _secrets,
    "supported_dbms": lambda s, d: C.connections_by_dbms(view(s, d, "requested_tables")),
}

_INFO = f"""select c.id, host, coalesce(nullif(port, 0), 9000) as port, rtrim(trim(coalesce(default_path, '')), '/') as default_path, coalesce(nullif(t.name, ''), 'WebDAV') as server_type_name, path
    from {as_sql('file_connections')} c left join {as_sql('server_types')} t on c.server_type_id = t.id"""

ORACLES = {
    "file_connection_info": f"select id, host, cast(port as int) as port, default_path, server_type_name from ({_INFO})",
    "file_urls": f"""with i as (select id, trim(coalesce(host, '')) as h, port, default_path as f, ltrim(trim(path), '/') as p from ({_INFO})),
        j as (select *, case when f = '' then p when p = '' then f else f || '/' || p end as w, case when lower(h) like 'http://%' or lower(h) like 'https://%' then rtrim(h, '/') when lower(h) like '%ngrok%' then 'https://' || h
            when port = 443 then 'https://' || h when port = 80 then 'http://' || h else 'http://' || h || ':' || port end as b from i)
        select id, case when w = '' then rtrim(b, '/') else b || '/' || w end as url from j""",
    "connection_info": f"select id, connection_name, dbms_type_id from {as_sql('db_server_connections')} where id % 3 = 1",
    "catalog_primary_keys": "select concat('t', n_nationkey) as table_name, case n_nationkey % 3 when 0 then 'k3' when 1 then 'k3,k2' else 'k3,k2,k1' end as key_columns from nation where n_nationkey % 4 <> 3",
    "catalog_first_columns": f"select table_name, arg_min(column_name, ordinal_position) as first_column from {as_sql('catalog_columns')} group by table_schema, table_name",
    "catalog_key_columns": f"""with k as (select table_schema, table_name, string_agg(u.column_name, ',' order by u.ordinal_position) as k from {as_sql('table_constraints')} c join {as_sql('key_column_usage')} u using (table_schema, table_name, constraint_name) where constraint_type = 'PRIMARY KEY' group by 1, 2),
        f as (select table_schema, table_name, arg_min(column_name, ordinal_position) as f from {as_sql('catalog_columns')} group by 1, 2), t as (select case n_regionkey % 2 when 0 then 'public' else 'app' end as table_schema, concat('t', n_nationkey) as table_name from nation)
        select table_schema, table_name, coalesce(k, f, 'id') as key_columns from t left join k using (table_schema, table_name) left join f using (table_schema, table_name)""",
    "table_names": f"""with t as (select *, case when lower(dbms) like '%mysql%' then 'mysql' when lower(dbms) like '%oracle%' then 'oracle' else 'postgresql' end as kind, strpos(name, '.') as p from {as_sql('requested_tables')}),
        u as (select *, case when p > 0 then trim(left(name, p - 1)) else 'public' end as s, trim(substr(name, p + 1)) as n from t)
        select id, kind, case when s <> 'public' then s when kind = 'mysql' then coalesce(db_name, 'public') when kind = 'oracle' then coalesce(username, 'public') else s end as schema_name,
            case when kind = 'mysql' then concat('`', n, '`') else concat('"', n, '"') end as table_name from u""",
    "column_sample": f"select k, trim(value) as value from (select * from {as_sql('col_values')} order by k limit 100) where k % 4 > 1",
    "sample_status": f"select kind, case when count(value) = 0 then '판단불가' when kind <> 8 then '안되어있음' else '되어있음' end as status from (select unnest(range(11)) as kind) left join {as_sql('col_values')} using (kind) group by kind",
    "base64_round_trip": "select doc_id, doc_id % 3 = 0 or 4 * ceil(octet_length(encode(text)) / 3.0) > 1000 as encoded, text from documents",
    "stored_secrets": "select s_suppkey, s_name as secret, s_name as unencrypted from supplier",
    "supported_dbms": f"select t.id, t.name, count(r.dbms) as n from (values ('postgresql', 'PostgreSQL'), ('mysql', 'MySQL'), ('oracle', 'Oracle')) as t(id, name) left join {as_sql('requested_tables')} r on lower(r.dbms) like t.id || '%' group by 1, 2",
}
