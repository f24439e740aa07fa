"""Ranked lexical search by TPUT (three phases, one uniform threshold) over term-partitioned postings.

Documents are read once, whole: each leaves one row with its length and the counts of the
words that some item asks for. From these rows come the postings (word, row, impact), an
impact being what a posting adds to a score. They lie in partitions by word, each
list in falling order of impact; a list of more than LIST_ROWS postings is split over several.

1. Heads: the first k postings of each list. Rows met there are scored, and the k-th best
   score of an item is a lower bound of what its last result scores.
2. One threshold for all lists of an item: the largest for which a row without any posting
   at or above it stays below the bound (a list adds to such a row its own head or the
   threshold less one, whichever is less). All postings at or above it are fetched and added
   up by ranges of rows. A row stays if its sum, with the most that its unseen lists can add,
   reaches the k-th best sum.
3. The exact scores of the rows that stay are looked up in all lists.

Sums are exact integers of 64 bits, and bounds are never rounded the wrong way: no row is lost. Items
are worked on in blocks, so that the words of a block (BLOCK_TERMS, more only for one single item
with more) fit into every task.

Every row of documents is a document of its own: rows with a null or repeated doc_id, also
rows repeated in full, are each ranked; of equal scores the smaller doc_id comes first,
null last, and rows with the same id follow each other in any order. Rows without words
are not counted and never found. Items with a null text or without words have no result, as in empty
tables; items with a repeated item_id are told apart and each ranked; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, texts_of, written

TOP = 10
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
CUT = 1 << 22  # bytes of a text whose words are listed at once
BLOCK_TERMS = 500_000  # words of the items that are worked on together
LIST_ROWS = 8_192  # postings of one list in a partition
RANGE_POSTINGS = 1_000_000  # postings of the rows of one range
FEW_ROWS = 1_000_000
SCALE, SATURATION = 1_000_000_000, 8

_ROWS = "row long, doc_id {kind}, n long, terms array<int>, tfs array<long>"


def term_counts(text: bytes) -> Counter:
    """The words of a text with their counts; A-Z lower-cased, whatever its length."""
    counts, start = Counter(), 0
    while start < len(text):
        gap = _BREAK.search(text, start + CUT) if len(text) - start > CUT else None
        end = gap.end() if gap else len(text)
        counts.update(TERM.findall(text[start:end].lower()))
        start = end
    return counts


def _counted(terms: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            numbers, lengths, found, counts, ends = [], [], [], [], [0]
            kept = []
            for i, text in enumerate(texts_of(batch)):
                words = term_counts(text)
                if words:
                    hits = [(terms[w], c) for w, c in words.items() if w in terms]
                    found += [t for t, _ in hits]
                    counts += [c for _, c in hits]
                    ends.append(len(found))
                    kept.append(i)
                    lengths.append(words.total())
                    numbers.append(row)
                    row += 1
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((found, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), ids, pa.array(lengths, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "tfs"])

    return run


@dataclass
class Asked:
    """The words of each item of a block, as numbers; most: the impact at the head of each word's list, 0 where there is none."""

    items: list[np.ndarray]
    most: np.ndarray

    def bound(self, item: int, threshold: int) -> np.ndarray:
        """The most that each list of an item adds to a row without a posting at or above the threshold."""
        return np.minimum(self.most[self.items[item]], threshold - 1)

    def threshold(self, item: int, least: int) -> int:
        """The largest threshold that leaves all rows without a posting at or above it below the score least."""
        low, high = 1, max(int(self.most[self.items[item]].max(initial=0)), 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if int(self.bound(item, middle).sum()) < least else (low, middle - 1)
        return low


class Lists:
    """The postings of a range of rows, by word: places among the range's rows, and impacts."""

    def __init__(self, table: pa.Table):
        term, row, impact = (table.column(c).to_numpy() for c in ("term", "row", "impact"))
        self.rows, place = np.unique(row, return_inverse=True)
        order = np.argsort(term, kind="stable")
        term, self.place, self.impact = term[order], place[order], impact[order]
        self.term, self.start = np.unique(term, return_index=True)
        self.end = np.append(self.start[1:], len(term))

    def of(self, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(i, places, impacts) of the i-th word, for the words that are there."""
        at = np.searchsorted(self.term, terms)
        for i, k in enumerate(at.tolist()):
            if k < len(self.term) and self.term[k] == terms[i]:
                s = slice(self.start[k], self.end[k])
                yield i, self.place[s], self.impact[s]


def _fetched(asked: Asked, thresholds: list[int], leasts: list[int], k: int):
    """(item, row, found, possible) of the rows of a range that may be among an item's k best: what was fetched, and with it the most that is unseen."""

    def run(table: pa.Table) -> pa.Table:
        lists, parts = Lists(table), []
        for item, (terms, threshold, least) in enumerate(zip(asked.items, thresholds, leasts)):
            bound = asked.bound(item, threshold)
            found, seen = np.zeros(len(lists.rows), np.int64), np.zeros(len(lists.rows), np.int64)
            for i, places, impacts in lists.of(terms):
                high = impacts >= threshold
                places = places[high]
                found[places] += impacts[high]
                seen[places] += bound[i]
            possible = np.where(found > 0, found + (int(bound.sum()) - seen), 0)
            if len(found) > k:
                least = max(least, int(np.partition(found, -k)[-k]))
            at = np.flatnonzero(possible >= max(least, 1))
            parts.append((np.full(len(at), item, np.int32), lists.rows[at], found[at], possible[at]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["item", "row", "found", "possible"])

    return run


def _scored(asked: Asked, k: int):
    """(item, row, score) of the pairs of a range; pairs that k others of the range surpass are left out."""

    def run(pairs: pa.Table, table: pa.Table) -> pa.Table:
        lists = Lists(table)
        item, row = pairs.column("item").to_numpy(), pairs.column("row").to_numpy()
        order = np.argsort(item, kind="stable")
        item, row = item[order], row[order]
        names, start = np.unique(item, return_index=True)
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for name, rows in zip(names.tolist(), np.split(row, start[1:])):
            score = np.zeros(len(lists.rows), np.int64)
            for _, places, impacts in lists.of(asked.items[name]):
                score[places] += impacts
            at = np.searchsorted(lists.rows, rows)
            here = at < len(lists.rows)
            here[here] = lists.rows[at[here]] == rows[here]
            own = score[at[here]]
            rows = rows[here]
            if len(own) > k:
                good = own >= np.partition(own, -k)[-k]
                own, rows = own[good], rows[good]
            parts.append((np.full(len(own), name, np.int32), rows, own))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["item", "row", "score"])

    return run


def _best(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each item, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _last(rows: DataFrame, k: int, score: str) -> dict[int, int]:
    """The k-th best value of each item that has k rows."""
    return {r["item"]: r[score] for r in _best(rows.select("item", score), k, F.desc(score)).where(F.col("rank") == k).collect()}


class Postings:
    """The postings of a block's words over all documents."""

    def __init__(self, docs: DataFrame, terms: dict[bytes, int]):
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.rows = written(docs.select("doc_id", "text").mapInArrow(_counted(terms), _ROWS.format(kind=kind)))
        self.documents, words, postings = self.rows.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).head()
        self.ranges = 1 + (postings or 0) // RANGE_POSTINGS
        each = self.rows.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        held = each.groupBy("term").agg(F.count("*").alias("df"))  # no more than the block has words
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2.0 * F.col("df") + 1)))
        m = F.lit(10) + F.expr(f"(90 * n * {self.documents}) div {words or 1}")
        impact = F.col("weight") * F.expr(f"({SCALE} * tf) div (1000 * tf + {SATURATION} * _m)")
        each = each.withColumn("_m", m).join(F.broadcast(held.withColumn("weight", weight)), "term")
        part = F.pmod(F.xxhash64("row"), 1 + F.expr(f"df div {LIST_ROWS}")).alias("part")
        lists = each.select("term", "row", impact.alias("impact"), part).where("impact > 0")
        self.lists = written(lists.repartition("term", "part").sortWithinPartitions("term", F.desc("impact")).drop("part"))
        self.spread = F.pmod(F.xxhash64("row"), F.lit(self.ranges)).alias("range")

    def heads(self, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("impact"), "row"))
        return self.lists.withColumn("rank", rank).where(F.col("rank") <= k)

    def looked_up(self, pairs: DataFrame, asked: Asked, k: int) -> DataFrame:
        """(item, row, score) of pairs (item, row), but for those that can't be among an item's k best of the pairs."""
        rows = pairs.select("row").distinct()
        rows = F.broadcast(rows) if rows.count() <= FEW_ROWS else rows
        lists = self.lists.join(rows, "row", "left_semi").select("term", "row", "impact", self.spread)
        pairs = pairs.select("item", "row", self.spread)
        return pairs.groupBy("range").cogroup(lists.groupBy("range")).applyInArrow(_scored(asked, k), "item int, row long, score long")

    def fetched(self, least: DataFrame, asked: Asked, thresholds: list[int], leasts: list[int], k: int) -> DataFrame:
        lists = self.lists.join(F.broadcast(least), "term").where("impact >= least").select("term", "row", "impact", self.spread)
        return lists.groupBy("range").applyInArrow(_fetched(asked, thresholds, leasts, k), "item int, row long, found long, possible long")


def _block(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items of a block, given by their words; item: the place in the list."""
    spark = docs.sparkSession
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for words in items for t in words))}
    postings = Postings(docs, terms)
    asked = Asked([np.array([terms[t] for t in words], np.int32) for words in items], np.zeros(len(terms), np.int64))
    pairs = pa.table({"item": pa.array(np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in asked.items])), "term": pa.array(np.concatenate(asked.items))})

    heads = written(postings.heads(k))
    for r in heads.where("rank = 1").collect():
        asked.most[r.term] = r.impact
    met = heads.join(F.broadcast(spark.createDataFrame(pairs)), "term").select("item", "row").distinct()
    bounds = _last(postings.looked_up(met, asked, k), k, "score")
    leasts = [bounds.get(i, 1) for i in range(len(items))]
    thresholds = [asked.threshold(i, least) for i, least in enumerate(leasts)]

    lowest = np.full(len(terms), np.iinfo(np.int64).max)
    np.minimum.at(lowest, pairs["term"].to_numpy(), np.repeat(thresholds, [len(x) for x in asked.items]))
    lowest = spark.createDataFrame(pa.table({"term": pa.array(np.arange(len(terms), dtype=np.int32)), "least": pa.array(lowest)}))
    found = written(postings.fetched(lowest, asked, thresholds, leasts, k))
    last = _last(found, k, "found")
    bound = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int32()), "least": pa.array([last.get(i, 1) for i in range(len(items))], pa.int64())}))
    stay = found.join(F.broadcast(bound), "item").where("possible >= least").select("item", "row")

    scores = written(postings.looked_up(stay, asked, k))
    last = _last(scores, k, "score")
    bound = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int32()), "least": pa.array([last.get(i, 1) for i in range(len(items))], pa.int64())}))
    scores = scores.join(F.broadcast(bound), "item").where("score >= least").drop("least")
    named = postings.rows.select("row", "doc_id").join(scores, "row")
    best = written(_best(named, k, F.desc("score"), F.asc_nulls_last("doc_id"), "row").select("item", "rank", "doc_id", "score"))
    forget(postings.rows, postings.lists, heads, found)
    return best


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) with the highest scores above 0 for each item (item_id, text)."""
    spark, kinds = docs.sparkSession, [t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (docs, "doc_id"))]
    schema = f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long"
    asked = written(items.where("text is not null").select("item_id", "text", F.length("text").alias("_size")))
    size = asked.agg(F.sum("_size")).head()[0] or 0
    blocks = 1 + size // (4 * BLOCK_TERMS)  # a word and its break take four bytes or so, or more
    out = []
    for b in range(blocks):
        rows = [(r.item_id, list(term_counts(r.text.encode()))) for r in asked.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).collect()]
        rows = [x for x in rows if x[1]]
        if rows:
            names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(rows)], f"item int, item_id {kinds[0]}")
            out.append(_block(docs, [words for _, words in rows], k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    forget(asked)
    if not out:
        return spark.createDataFrame([], schema)
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both
