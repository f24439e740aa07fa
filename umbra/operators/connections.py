"""Stored connections, catalogs of databases, sampled columns, and encoded or encrypted values.

Null inputs count as missing: defaults stand in for them where there are any, else the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import strip


def file_connections(connections: DataFrame, types: DataFrame) -> DataFrame:
    """connections with the type's name and defaults; types: (id, name), a few rows for each kind of server."""
    named = types.select(F.col("id").alias("_type"), F.col("name").alias("_name"))
    rows = connections.join(named, F.col("server_type_id") == F.col("_type"), "left")
    port = F.when(F.coalesce("port", F.lit(0)) == 0, rules.FILE_PORT).otherwise(F.col("port"))
    kind = F.when(F.coalesce("_name", F.lit("")) == "", rules.FILE_SERVER).otherwise(F.col("_name"))
    path = F.regexp_replace(strip(F.coalesce("default_path", F.lit(""))), "/+$", "")
    return rows.withColumns({"port": port.cast("int"), "default_path": path, "server_type_name": kind}).drop("_type", "_name")


def file_url(host: Column, port: Column, default_path: Column, path: Column) -> Column:
    """Address of a file on a file server: a host with a scheme stays as it is; ports 80 and 443 are not shown."""
    host, port = strip(F.coalesce(host, F.lit(""))), F.when(F.coalesce(port, F.lit(0)) == 0, rules.FILE_PORT).otherwise(port)
    folder = F.regexp_replace(strip(F.coalesce(default_path, F.lit(""))), "/+$", "")
    part = F.regexp_replace(strip(F.coalesce(path, F.lit(""))), "^/+", "")
    whole = F.when(folder == "", part).when(part == "", folder).otherwise(F.concat_ws("/", folder, part))
    scheme = F.when(port == 443, "https").otherwise("http")
    shown = F.when(port.isin(80, 443), "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    base = F.when(host.rlike("(?i)^https?://"), F.regexp_replace(host, "/+$", "")).when(F.lower(host).contains("ngrok"), F.concat(F.lit("https://"), host)).otherwise(F.concat(scheme, F.lit("://"), host, shown))
    return F.when(whole == "", F.regexp_replace(base, "/+$", "")).otherwise(F.concat_ws("/", base, whole))


def dialect(dbms: Column) -> Column:
    low = F.lower(F.coalesce(dbms, F.lit("")))
    return F.when(low.contains("mysql"), "mysql").when(low.contains("oracle"), "oracle").otherwise("postgresql")


def table_of(name: Column, kind: Column, db_name: Column, username: Column) -> Column:
    """(schema, table) of a name with or without a schema; the public schema stands for the database (mysql) or its owner (oracle)."""
    parts = F.split(name, r"\.", 2)
    schema = F.when(name.contains("."), F.trim(parts[0])).otherwise(rules.PUBLIC)
    table = F.trim(F.when(name.contains("."), parts[1]).otherwise(name))
    own = F.when(kind == "mysql", F.coalesce(db_name, F.lit(rules.PUBLIC))).when(kind == "oracle", F.coalesce(username, F.lit(rules.PUBLIC))).otherwise(rules.PUBLIC)
    return F.struct(F.when(schema == rules.PUBLIC, own).otherwise(schema).alias("schema"), table.alias("table"))


def quoted(name: Column, kind: Column) -> Column:
    mark = F.when(kind == "mysql", "`").otherwise('"')
    return F.concat(mark, name, mark)


def primary_keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """(table_schema, table_name, key_columns): columns of each table's primary key by position."""
    own = ["table_schema", "table_name", "constraint_name"]
    rows = constraints.where("constraint_type = 'PRIMARY KEY'").select(*own).join(usage, own)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name")))  # columns of one key
    return rows.groupBy("table_schema", "table_name").agg(F.transform(ordered, lambda x: x["column_name"]).alias("key_columns"))


def first_columns(columns: DataFrame) -> DataFrame:
    """(table_schema, table_name, first_column): the column with the least position."""
    return columns.groupBy("table_schema", "table_name").agg(F.min_by("column_name", F.struct("ordinal_position", "column_name")).alias("first_column"))


def key_columns(tables: DataFrame, constraints: DataFrame, usage: DataFrame, columns: DataFrame) -> DataFrame:
    """tables with the columns that tell rows apart: the primary key, else the first column, else `id`."""
    by = ["table_schema", "table_name"]
    rows = tables.join(primary_keys(constraints, usage), by, "left").join(first_columns(columns), by, "left")
    return rows.withColumn("key_columns", F.coalesce("key_columns", F.array(F.coalesce("first_column", F.lit("id"))))).drop("first_column")


def sampled(rows: DataFrame, key: str, value: str, n: int = 100) -> DataFrame:
    """(key, value) of the first n rows by key, trimmed, less the null and blank ones."""
    first = rows.select(key, F.col(value).cast("string").alias(value)).orderBy(key).limit(n)
    return first.withColumn(value, strip(F.col(value))).where(F.col(value) != "")


def sample_status(value: Column, plain: Column) -> Column:
    """Aggregate: whether sampled values are encrypted; one plain value is enough for no."""
    return F.when(F.count(value) == 0, rules.UNKNOWN).when(F.bool_or(plain), rules.NOT_ENCRYPTED).otherwise(rules.ENCRYPTED)


def decoded(data: Column) -> Column:
    """Bytes of base64 text, with or without a data prefix."""
    return F.unbase64(F.when(data.contains(","), F.get(F.split(data, ","), F.lit(1))).otherwise(data))


def encoded(data: Column) -> Column:
    """Base64 text of bytes, on one line."""
    return F.translate(F.base64(data), "\r\n", "")


def is_encoded(data: Column) -> Column:
    return data.startswith("data:") | (F.length(data) > 1000)


def secret(stored: Column, key: str) -> Column:
    """A stored secret in plain: decrypted (AES-GCM: base64 of vector, text and tag) if the key has 32 bytes, else as it is. A wrong key fails the query."""
    if len(key.encode()) != 32:
        return F.trim(stored)
    return F.aes_decrypt(F.unbase64(stored), F.lit(key), F.lit("GCM")).cast("string")


def supported_dbms(spark) -> DataFrame:
    return spark.createDataFrame(list(rules.DBMS.items()), "id string, name string")


def connections_by_dbms(connections: DataFrame, dbms: str = "dbms") -> DataFrame:
    """(id, name, n) of every supported system, with how many connections name it at the start, in any case; connections are counted by that name before the join."""
    first = F.lower(F.regexp_extract(dbms, r"^\s*([A-Za-z]+)", 1))
    counts = connections.groupBy(first.alias("id")).agg(F.count("*").alias("n"))
    return supported_dbms(connections.sparkSession).join(counts, "id", "left").fillna(0, ["n"])
