"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by size: class L holds items of more than L/2 and up to L shingles.
For each class, a document is cut into blocks of 2L shingles that overlap by L, so a
passage of up to L shingles lies whole in some block, and a block and an item that it
contains have a Jaccard similarity of at least 0.17, however long the document is.
64 minima are compared one by one (bands of one row): a contained item is missed with a
chance of four in a million.

A block whose shingles include too few of the benchmark's shingles for any item of the
class cannot contain one and gets no signature; this is decided with a bit table of fixed
size, whatever the benchmark's, and never rejects a true block.

Blocks find passages, not items whose parts lie apart. For those, each item also has a
sketch: all but (least number to be found) - 1 of its shingles, those that the fewest items
share. A document that holds enough of an item, wherever, holds one of its sketch, so the
sketch shingles among a document's hits are candidates' keys as the minima are: none is missed.

Candidates are verified exactly: the share of an item's distinct five-word shingles that
occur anywhere in the document, against the threshold. Only the document's shingles with
a bit set travel, not its text. Documents with equal texts are verified once.

Words are lower-cased (A-Z). An item or document of one to four words has its whole
sequence as its one shingle; null or wordless texts have none and never match. Repeated
rows of documents or items give one pair. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, list_array, mix, shingle_sets, spans, texts_of, tidy, grams, written, SHINGLE

PERMUTATIONS = 64
LEAST_CLASS = 16
TABLE_BITS = 22

_rng = np.random.default_rng(1010)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def size_class(n: int) -> int:
    size = LEAST_CLASS
    while size < n:
        size *= 2
    return size


def keys(values: np.ndarray, size: int) -> np.ndarray:
    """One key for each permutation's minimum over values, telling class, permutation and minimum."""
    out = np.empty(PERMUTATIONS, dtype=np.uint64)
    for p in range(PERMUTATIONS):
        x = values * _A[p] + _B[p]
        out[p] = (x ^ (x >> np.uint64(31))).min()
    return mix(out + np.arange(PERMUTATIONS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch, lower=True)
        values, offsets = shingle_sets(Words(texts)) if texts else (np.zeros(0, np.uint64), np.zeros(1, int))
        full = np.flatnonzero(np.diff(offsets))
        sets = [values[offsets[i] : offsets[i + 1]] for i in full]
        sizes = [size_class(len(s)) for s in sets]
        ends = np.cumsum([0, *(len(s) for s in sets)])
        joined = np.concatenate(sets) if sets else values[:0]
        marks = np.concatenate([keys(s, c) for s, c in zip(sets, sizes)]) if sets else values[:0]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").take(pa.array(full)), pa.array(sizes, pa.int64()), list_array(joined.view(np.int64), ends, pa.int64()), list_array(marks.view(np.int64), np.arange(len(full) + 1) * PERMUTATIONS, pa.int64())],
            names=["item_id", "size", "shingles", "keys"],
        )


def _sketches(items: DataFrame, percent: int) -> DataFrame:
    """(item_id, key): for each item the shingles of which a document that contains it must hold one."""
    own = items.select("item_id", F.xxhash64("shingles").alias("set"), F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    ranked = own.join(own.groupBy("key").agg(F.count("*").alias("met")), "key").groupBy("item_id", "set", "n").agg(F.sort_array(F.collect_list(F.struct("met", "key"))).alias("ranked"))  # one item's shingles
    least = F.greatest(F.ceil(F.lit(percent) * F.col("n") / 100).cast("int"), F.lit(1))
    return ranked.select("item_id", F.explode(F.slice("ranked", F.lit(1), F.greatest(F.col("n") - least + 1, F.lit(0)))).alias("r")).select("item_id", "r.key")


def _search(table: np.ndarray, classes: list[tuple[int, int]]):
    """table: 1 for a shingle of an item, 2 for one of a sketch; classes: (L, least number of an item's shingles that must be found)."""
    fewest = min((least for _, least in classes), default=0)
    shift = np.uint64(64 - TABLE_BITS)

    def blocks(g: np.ndarray, hit: np.ndarray) -> Iterator[np.ndarray]:
        found = np.concatenate(([0], np.cumsum(hit)))
        for size, least in classes:
            starts = np.arange(0, max(1, len(g) - size), size)
            ends = np.minimum(starts + 2 * size, len(g))
            for a, b in zip(*(x[found[ends] - found[starts] >= least] for x in (starts, ends))):
                yield keys(g[a:b], size)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch, lower=True), batch.column("doc_id")
            for a, b in spans(texts):
                words = Words(texts[a:b])
                every = grams(words.hash)
                rows, marks, hits, names = [], [], [], []
                for i, (s, e) in enumerate(zip(words.first[:-1], words.first[1:])):
                    g = every[s : e - SHINGLE + 1] if e - s >= SHINGLE else shingle_sets(Words(texts[a + i : a + i + 1]))[0]
                    level = table[(g >> shift).astype(np.int64)]
                    hit = level > 0
                    if not hit.any():
                        continue
                    own = list(blocks(g, hit))
                    found = np.unique(g[hit])
                    if len(found) >= fewest:
                        own.append(np.unique(g[level > 1]))
                    if sum(map(len, own)):
                        rows.append(a + i)
                        marks.append(np.unique(np.concatenate(own)))
                        hits.append(found)
                        w = words.hash[s:e]
                        names.append(mix((w * mix(np.arange(1, e - s + 1, dtype=np.uint64))).sum(keepdims=True))[0])
                if rows:
                    arrays = [list_array(np.concatenate(x).view(np.int64), np.cumsum([0, *map(len, x)]), pa.int64()) for x in (hits, marks)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.array(names, np.uint64).view(np.int64)), *arrays], names=["doc_id", "text_hash", "hits", "keys"])

    return search


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for each pair with 100 * n_shared >= percent * n_shingles."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(_items), f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, size long, shingles array<long>, keys array<long>")
    items = written(items.dropDuplicates(["item_id", "shingles"]))
    table = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    sketches = written(_sketches(items, percent))
    for level, shingles in ((1, items.select(F.explode("shingles").alias("s"))), (2, sketches.select(F.col("key").alias("s")))):
        bits = shingles.select(F.shiftrightunsigned("s", 64 - TABLE_BITS).alias("b")).distinct().toPandas()  # at most 2**22 values
        table[bits["b"].to_numpy(dtype=np.int64)] = level
    sizes = items.groupBy("size").agg(F.min(F.size("shingles"))).collect()  # one row for each doubling of size
    classes = sorted((int(s), -(-percent * int(n) // 100)) for s, n in sizes)
    shared = spark.sparkContext.broadcast((table, classes))

    def search(batches):
        return _search(*shared.value)(batches)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    met = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(search), f"doc_id {id_type}, text_hash long, hits array<long>, keys array<long>"))
    texts = met.dropDuplicates(["text_hash"])
    marks = items.select("item_id", F.explode("keys").alias("key")).union(sketches)
    candidates = texts.select("text_hash", F.explode("keys").alias("key")).join(marks, "key").select("text_hash", "item_id").distinct()
    both = candidates.join(texts.select("text_hash", "hits"), "text_hash").join(items.select("item_id", "shingles"), "item_id")
    counted = both.select("text_hash", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("hits", "shingles")).cast("long").alias("n_shared"))
    counted = counted.where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    out = met.select("doc_id", "text_hash").join(counted, "text_hash").groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_shared"), F.col("n_shared") / F.col("n_shingles")).alias("m"))
    return out.select("doc_id", "item_id", "m.n_shingles", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"))
