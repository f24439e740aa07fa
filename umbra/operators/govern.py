"""Statement guard, result scrubber, and roll-ups over inventory and issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def is_safe(sql: Column) -> Column:
    """True for read-only statements that touch neither the forbidden table nor a secret column."""
    text = F.lower(F.regexp_replace(F.regexp_replace(F.lower(sql), r"(?m)--.*?$", ""), r"(?s)/\*.*?\*/", ""))
    t = rules.FORBIDDEN_TABLE
    bad = rf"\b({'|'.join(rules.WRITE_WORDS)})\b|\bfrom\s+{t}\b|\bjoin\s+{t}\b|\b{t}\.|select\s+.*?\b({'|'.join(rules.SECRET_WORDS)})\b"
    return text.rlike(r"^\s*select") & ~text.rlike(bad)


def scrubbed(result: Column) -> Column:
    """A result text without secrets: refused as a whole if it names the forbidden table."""
    names = "password|pwd|passwd|secret|credential|token|api[_-]?key|encrypted[_-]?password"
    clean = F.regexp_replace(result, rf"(?i)({names})\s*[:=]\s*[^\n]+", rules.PLACEHOLDER)
    words = "|".join(rules.SECRET_WORDS)
    kept = F.filter(F.split(clean, "\n"), lambda x: ~F.lower(x).rlike(words) | F.lower(x).rlike(rf"({names})\s*[:=]"))
    return F.when(result.rlike(rf"(?i)\b{rules.FORBIDDEN_TABLE}\b"), rules.REFUSAL).otherwise(F.array_join(kept, "\n"))


def issues_per_server(issues: DataFrame, servers: DataFrame, key: str) -> DataFrame:
    """(connection_name, n_issues) of active issues; issues are counted by server before the join."""
    counted = issues.where("issue_status = 'ACTIVE'").groupBy(key).agg(F.count("id").alias("n"))
    return counted.join(servers.select(F.col("id").alias(key), "connection_name"), key).groupBy("connection_name").agg(F.sum("n").alias("n_issues"))


def encryption_summary(values: DataFrame, key: str, value: str, plain: Column, first: int = 10) -> DataFrame:
    """One row: non-null values, encrypted ones, status and the first keys of plain ones.

    Keys are ordered as numbers or, where they are texts, as texts; whole numbers are shown without fraction. Plain rows whose key is
    missing (null, not a number) name no key and don't make a column unencrypted.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.coalesce(plain, F.lit(False)).alias("p"))
    named = F.col("k").isNotNull()
    if values.schema[key].dataType.typeName() in ("float", "double"):
        named &= ~F.isnan("k")
    shown = F.col("k").cast("string")
    if values.schema[key].dataType.typeName() in ("float", "double", "decimal"):
        shown = F.when(F.col("k") == F.floor("k"), F.floor("k").cast("string")).otherwise(shown)
    counts = rows.agg(F.count("*").alias("total_records"), F.count_if(~F.col("p")).alias("encrypted_records"), F.count_if(F.col("p") & named).alias("_named"))
    some = rows.where(F.col("p") & named).orderBy("k").limit(first).select(F.struct("k", shown.alias("s")).alias("x"))
    keys = some.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ",").alias("first_keys"))
    status = F.when(F.col("total_records") == 0, "판단불가").when(F.col("_named") > 0, "안되어있음").otherwise("되어있음")
    return counts.join(F.broadcast(keys)).withColumn("status", status).drop("_named")  # one row each
