"""URL verdicts from longest-match rules and gradient-boosted trees on lexical features.

DataFrame functions and the DataFrame trainer only. URLs that a rule decides are the
labelled examples; the trees learn from a bounded sample of them (TRAIN_ROWS rows, the
lowest by hash of page id and url) and judge the URLs that no rule fits.

Features: lengths, depth, digit ratio, character entropy, parameter and separator counts
of host, path and query, and suffix statistics: for the last label and the last two labels
of the host, the smoothed share of blocked examples among all URLs that a rule decides.

A null url, or one without `://`, has empty host and path; it is judged by the trees like
any other. Equal urls get equal verdicts. Without examples of both verdicts, every URL
without a rule is allowed. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, lowest, small_or_shuffled, written

TRAIN_ROWS = 20_000
SUFFIX_ROWS = 200_000
TREES, DEPTH = 10, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FEATURES = ("n_url", "n_host", "n_path", "n_query", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "has_fragment", "has_extension", "secure", "suffix_1", "suffix_2")


def parts(url: Column) -> dict[str, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return {"host": F.translate(F.regexp_extract(blank(url), pattern, 1), _UPPER, _LOWER), "path": F.regexp_extract(blank(url), pattern, 2)}


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule like `net/`, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features."""
    url, host, path = blank(F.col("url")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return urls.withColumns({
        "n_url": F.length(url), "n_host": F.length(host), "n_path": F.length(path), "n_query": F.length(query),
        "depth": _count(path, "/"), "labels": _count(host, "."), "digit_ratio": _count(url, "0123456789") / n, "entropy": entropy,
        "params": F.when(query != "", _count(query, "&") + 1).otherwise(0), "hyphens": _count(url, "-_"),
        "has_fragment": url.contains("#").cast("int"), "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"), "secure": url.startswith("https").cast("int"),
        "_suffix_1": F.substring_index(host, ".", -1), "_suffix_2": F.substring_index(host, ".", -2),
    })


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url)."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = urls.withColumns(parts(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return learned(lexical(urls.withColumns({"rule": rule, "_ruled": verdict})))


def learned(rows: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for rows with lexical features; those without a verdict in _ruled get the trees'."""
    ruled = rows.where("_ruled is not null").withColumn("_y", (F.col("_ruled") == "block").cast("double"))
    suffixes = written(ruled.groupBy("_suffix_1", "_suffix_2").agg(F.sum("_y").alias("_blocks"), F.count("*").alias("_urls")))
    blocks, n = suffixes.agg(F.sum("_blocks"), F.sum("_urls")).first()
    if not n or blocks in (0, n):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.lit("allow")).alias("verdict"))
    mean = blocks / n

    def with_suffixes(df: DataFrame) -> DataFrame:
        for k in (1, 2):
            share = suffixes.groupBy(f"_suffix_{k}").agg(((F.sum("_blocks") + mean * 5) / (F.sum("_urls") + 5)).alias(f"suffix_{k}"))
            df = df.join(small_or_shuffled(share, SUFFIX_ROWS), f"_suffix_{k}", "left").fillna(mean, [f"suffix_{k}"])
        return df

    sample = lowest(ruled.withColumn("_hash", F.xxhash64("page_id", "url")), TRAIN_ROWS).orderBy("_hash").limit(TRAIN_ROWS)
    sample = written(with_suffixes(sample).select(*FEATURES, "_y"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    trainer = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_blocked", maxIter=TREES, maxDepth=DEPTH, seed=7)
    model = trainer.fit(vectors.transform(sample).select("_x", "_y"))
    judged = model.transform(vectors.transform(with_suffixes(rows)))
    own = F.when(F.col("_blocked") == 1.0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"))
