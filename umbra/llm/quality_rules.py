"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The ratio compares two smoothed multinomials over 2**16 hashed unigrams and bigrams of
words: a trusted target (documents labelled as good) and the raw corpus (all documents).
The target is smoothed towards the raw corpus, with PRIOR n-grams drawn like it: ordinary
text scores about 0 whatever the size of the corpus and the share of labels. Few labels
leave all scores near 0, so that little is rejected; without labels all are exactly 0.
A document's score is the mean of log p_target - log p_raw over its n-grams, so its
length does not count; a document below the fixed threshold is rejected.

The n-gram table has a fixed size, whatever the corpus: it travels as one constant array.
Documents never leave their row: no shuffle carries text unless the labels outgrow a
counted broadcast limit.

Null text is empty. A document without words has no n-grams, score 0, and fails the base
rule. Labels of unknown documents, repeated labels and null labels do no harm: a document
is trusted if any of its labels is 1. Further columns pass through; columns named as the
results are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, small_or_shuffled, word_array

BUCKET_BITS = 16
SMOOTHING = 5.0
PRIOR = 80_000.0  # set, with the threshold, on labels left out of the target
THRESHOLD = -0.25
WINDOW = 5
LABEL_ROWS = 2_000_000  # labels up to this count are broadcast (about 16 MB)

SYMBOLS = "[#*$%&|<>]"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def mean_ratio(words: Column, pairs: Column, table: Column) -> Column:
    """Mean of the table's entries for arrays of hashes of words and word pairs (null: none)."""
    total = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(table, bucket(h)))
    return (total(words) + F.coalesce(total(pairs), F.lit(0.0))) / (2 * F.size(words) - 1)


def repeated_words(placed: Column) -> Column:
    """Words covered by windows that occur twice or more; placed: sorted (hash, start) of every window."""
    n = F.size(placed)
    none = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
    before, after = F.concat(none, F.slice(placed, F.lit(1), n - 1)), F.concat(F.slice(placed, F.lit(2), n - 1), none)
    beside = F.arrays_zip(placed.alias("own"), before.alias("before"), after.alias("after"))
    twice = F.filter(beside, lambda x: F.coalesce(x["own"]["h"] == x["before"]["h"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["after"]["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["own"]["p"]))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(starts, zero, lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])
    return F.coalesce(covered, F.lit(0).cast("long"))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions refer to by value: a filter on a result isn't rewritten to compute them once per use."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def surface(docs: DataFrame, text: Column) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the helper columns _hashes and _pairs (of words and word pairs); no column of docs may be named so."""
    text = blank(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n = F.size("_hashes")
    pairs = F.when(n > 1, F.transform(F.slice("_hashes", F.lit(1), n - 1), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1))))
    windows = F.when(n >= WINDOW, F.transform(F.slice("_pairs", F.lit(1), n - WINDOW + 1), lambda h, i: F.xxhash64(h, F.get("_pairs", i + 2), F.get("_hashes", i + WINDOW - 1))))
    out = _settled(docs, _words=word_array(text), _lines=lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    out = _settled(out, _hashes=F.transform("_words", lambda w: F.xxhash64(w))).drop("_words", "_lines")
    out = _settled(out, _pairs=pairs)
    out = _settled(out, _windows=windows)
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.when(repeated, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    out = _settled(out, _placed=placed)
    out = _settled(out, n_repeat_words=repeated_words(F.col("_placed")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_windows", "_placed")


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, target, raw, ratio) for every bucket, from the n-grams of all documents."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    trusted = small_or_shuffled(trusted, LABEL_ROWS)
    own = docs.select("doc_id", blank(F.col("text")).alias("text")).join(trusted, F.col("doc_id") == F.col("_trusted"), "left")
    own = _settled(own.select(F.col("_trusted").isNotNull().cast("long").alias("good"), "text"), words=word_array(F.col("text")))
    placed = own.select("good", "words", F.posexplode("words").alias("at", "word"))
    word, after = F.xxhash64("word"), F.get("words", F.col("at") + 1)
    pair = F.when(after.isNotNull(), F.xxhash64(word, F.xxhash64(after)))
    grams = placed.select("good", F.explode(F.array(bucket(word), bucket(pair))).alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    size = 1 << BUCKET_BITS
    every = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    sums = filled.agg(F.sum("raw").alias("raw_sum"), F.sum("target").alias("target_sum"))
    p_raw = (F.col("raw") + SMOOTHING) / (F.col("raw_sum") + SMOOTHING * size)
    ratio = F.log((F.col("target") / p_raw + PRIOR) / (F.col("target_sum") + PRIOR))  # of (target + PRIOR * p_raw) / (target_sum + PRIOR) to p_raw
    return filled.join(F.broadcast(sums)).withColumn("ratio", ratio)  # one row of sums


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the surface counts, llr double and kept boolean."""
    ratios = [r for _, r in sorted(log_ratios(docs, labels).select("bucket", "ratio").collect())]  # always 2**16 values
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # a constant: parsed once
    own = docs.drop(*RESULTS)
    plain = [f"c{i}" for i in range(len(own.columns))]  # no name of docs meets a helper's
    out = surface(own.toDF(*plain), F.col(plain[own.columns.index("text")]))
    out = _settled(out, llr=F.when(F.col("n_words") > 0, mean_ratio(F.col("_hashes"), F.col("_pairs"), table)).otherwise(0.0))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))
    return out.select(*(F.col(p).alias(c) for p, c in zip(plain, own.columns)), *RESULTS)
