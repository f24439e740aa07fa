"""A stored word index: full-text search that reads postings in place of texts, and leaves out what can't be among the best.

Rows of the corpus are dealt into slices of about SLICE_ROWS rows of like length. A block holds one word's postings
(row and places) of one slice, with the most occurrences that a row of it has; so a common word has as many
blocks as there are slices, and no group grows with the corpus. Long rows have slices of fewer rows, of about SLICE_CHARS characters. Blocks are
files by a hash of their word. Texts are moved to their slice once, which makes its blocks in one task; `top` moves the blocks that it reads to
their slice once, whatever number of queries reads them.

A query can only be met in slices where all of its words have a block. A row with n words of a query has at most n covers for each
occurrence of any one of them (a cover begins at the last occurrence, up to there, of one of the words), and at most as many covers as it
has occurrences of all, less n - 1. The blocks' most occurrences bound a slice's ranks from above by that, and `top` reads slices from the
highest bound down, until the k-th rank that was found lies above the bounds of all that are left: the result is the exact one.

Texts are null, empty or without words: in no block, as they match nothing. Queries without words: no rows. Repeated rows of one id are
read as one row with the places of all; a null id is an id. An empty corpus: an index without blocks. Equal ranks: the smaller id first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import words
from ..sources.shared import cut
from . import retrieve as R

SLICE_ROWS, PARTS = 1024, 16
SLICE_CHARS, TASK_CHARS = 8 << 20, 32 << 20  # of a slice, and of the slices that a task makes blocks of
TURN_QUERIES = 1000  # queries that meet a slice at once
READ_SLICES = 16_000_000  # slices of all words that are read, broadcast up to this count
HEADS, GROWTH = 8, 4  # slices that a query reads first, and how many times more in each further round


def _part(word: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")


def _length_class(text: str) -> Column:
    return F.floor(F.log2(F.length(text) + 1)).cast("int")


def _slices(corpus: DataFrame, slice_rows: int, first: int) -> tuple[Column, int]:
    """(slice of a row, first slice that is free): rows of one length class share slices, numbered from first. There are at most 32 classes."""
    counts = sorted(corpus.where("text is not null").groupBy(_length_class("text").alias("c")).count().collect())
    of, free = F.lit(None).cast("long"), first
    for c, n in counts:
        wide = max(-(-n // slice_rows), -(-(n << (c + 1)) // SLICE_CHARS) if n << (c + 1) > SLICE_CHARS else 1)
        of = F.when(_length_class("text") == c, F.lit(free) + F.pmod(F.xxhash64("id"), F.lit(wide))).otherwise(of)
        free += wide
    return of.cast("long"), free


def _in_slices(corpus: DataFrame, of: Column) -> DataFrame:
    """(id, slice, text) of rows with a text; all rows of one id are in one slice."""
    rows = corpus.where("text is not null").select("id", of.alias("slice"), "text")
    again = cut(corpus.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id")))
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("_id"))
    one = cut(rows.join(R.few(again), same, "left_semi").groupBy(F.col("id").alias("_id")).agg(F.min("slice").alias("_slice")))
    return rows.join(R.few(one), same, "left").select("id", F.coalesce("_slice", "slice").alias("slice"), "text")


def _blocks_of(kinds: pa.Schema):
    """The blocks of one slice, from its rows (id, slice, words)."""

    def run(rows: pa.Table) -> pa.Table:
        lists, ids = R._one(rows["words"]), R._one(rows["id"]).dictionary_encode("encode")
        size, said = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
        if not len(said):
            return kinds.empty_table()
        row = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
        at = (np.arange(len(said)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        hit = said.indices.to_numpy(zero_copy_only=False) * np.int64(len(ids.dictionary)) + row
        order = np.argsort(hit, kind="stable")
        hit, row, at = hit[order], row[order], at[order]
        posting = np.flatnonzero(np.diff(hit, prepend=-1))  # the first place of each
        word = hit[posting] // len(ids.dictionary)
        block = np.flatnonzero(np.diff(word, prepend=-1))  # the first posting of each
        ats = pa.ListArray.from_arrays(pa.array(np.append(posting, len(at)), pa.int32()), pa.array(at))
        of = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(row[posting])), ats], ["id", "ats"])
        postings = pa.ListArray.from_arrays(pa.array(np.append(block, len(posting)), pa.int32()), of)
        most = np.maximum.reduceat(np.diff(np.append(posting, len(at))), block)
        columns = [said.dictionary.take(pa.array(word[block])), pa.array(np.full(len(block), rows["slice"][0].as_py())), pa.array(most), pa.array(np.diff(np.append(block, len(posting)))), postings]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return run


def _task(spark: SparkSession, number: str, tasks: int) -> Column:
    """A key for each number, so that a shuffle by it into so many partitions gives the numbers to them in turn; by their hash some would get many."""
    n = F.pmod(F.hash("id"), F.lit(tasks))
    keys = dict(spark.range(64 * tasks).groupBy(n.alias("n")).agg(F.min("id")).collect())
    return F.element_at(F.lit([keys.get(i, i) for i in range(tasks)]).cast("array<long>"), (F.col(number) % tasks + 1).cast("int"))


def _blocks(corpus: DataFrame, of: Column, parts: int, slices: int) -> DataFrame:
    """(word, slice, most, rows, postings, part): one row for each word of a slice. Texts are shuffled once, by slice; a task makes the blocks of one slice after the other."""
    chars = corpus.agg(F.sum(F.length("text").cast("long"))).head()[0] or 0
    tasks = max(-(-chars // TASK_CHARS), min(slices, max(24, 3 * corpus.sparkSession.sparkContext.defaultParallelism)), 1)
    rows = _in_slices(corpus, of).withColumn("_task", _task(corpus.sparkSession, "slice", tasks)).repartition(tasks, "_task")
    rows = rows.sortWithinPartitions("_task", "slice").select("_task", "id", "slice", words(F.col("text")).alias("words"))
    posting = StructType([corpus.schema["id"], StructField("ats", ArrayType(IntegerType()))])
    schema = StructType([StructField("word", StringType()), StructField("slice", LongType()), StructField("most", IntegerType()), StructField("rows", LongType()), StructField("postings", ArrayType(posting))])
    made = rows.groupBy("_task", "slice").applyInArrow(_blocks_of(_kinds(schema)), schema)
    return made.withColumn("part", _part("word", parts)).sortWithinPartitions("part", "word", "slice")


def _kinds(schema: StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _meet(kinds: pa.Schema):
    """Rows that hold all words of a query, as _met gives them, from blocks of one slice (word, ids, many: places of each, ats: of all) and the queries (q_id, _words) that read it."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return kinds.empty_table()
        lists, numbers = R._one(blocks["ids"]), {w: i for i, w in enumerate(blocks["word"].to_pylist())}
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        ids, hits = lists.flatten().dictionary_encode("encode"), R._one(blocks["many"]).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ats = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hits)]), pa.int32()), R._one(blocks["ats"]).flatten())
        row = ids.indices.to_numpy(zero_copy_only=False)
        at: dict[int, np.ndarray] = {}  # of a block: the posting of each row, or -1

        def place(block: int) -> np.ndarray:
            if block not in at:
                at[block] = np.full(len(ids.dictionary), -1, np.int32)
                at[block][row[first[block] : first[block + 1]]] = np.arange(first[block], first[block + 1])
            return at[block]

        found = []
        for q, wanted in enumerate(asked["_words"].to_pylist()):
            held = [numbers[w] for w in wanted if w in numbers]
            if len(held) < len(wanted):
                continue
            rarest = min(held, key=lambda b: first[b + 1] - first[b])
            met = row[first[rarest] : first[rarest + 1]]
            for b in held:
                met = met[place(b)[met] >= 0]
            if len(met):
                found.append((q, met, np.stack([place(b)[met] for b in held], axis=1)))
        if not found:
            return kinds.empty_table()
        many, n = [len(met) for _, met, _ in found], np.concatenate([np.full(len(p), p.shape[1]) for _, _, p in found])
        query, posting = np.repeat([q for q, _, _ in found], many), np.concatenate([p.ravel() for _, _, p in found])
        begin = np.concatenate([[0], np.cumsum(n)])
        word = np.arange(len(posting)) - np.repeat(begin[:-1], n)
        places = pa.StructArray.from_arrays([pa.array(word, pa.int32()), ats.take(pa.array(posting))], ["_word", "_ats"])
        columns = [
            R._one(asked["q_id"]).take(pa.array(query)), ids.dictionary.take(pa.array(np.concatenate([met for _, met, _ in found]))), pa.array(n), pa.array(np.add.reduceat(hits[posting], begin[:-1])),
            pa.ListArray.from_arrays(pa.array(begin, pa.int32()), places),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return run


@dataclass(frozen=True)
class WordIndex:
    """A stored index: the folder of its blocks, their columns, the number of folders, the first slice that is free."""

    path: str
    schema: StructType
    parts: int
    free: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def add(self, corpus: DataFrame, slice_rows: int = SLICE_ROWS) -> WordIndex:
        """The index with further rows (id, text), in slices of their own; their ids must be new to it."""
        of, free = _slices(corpus, slice_rows, self.free)
        _blocks(corpus, of, self.parts, free - self.free).write.mode("append").partitionBy("part").parquet(self.path)
        return WordIndex(self.path, self.schema, self.parts, free)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(q_id, _word, word, part, _all): the different words of each query; repeated rows of a query are one."""
        w = F.array_distinct(words(F.col("q_text")))
        return cut(queries.select("q_id", F.size(w).alias("_all"), F.posexplode(w).alias("_word", "word")).withColumn("part", _part("word", self.parts)))

    def _live(self, asked: DataFrame) -> DataFrame:
        """(q_id, slice, bound) of slices where all words of a query have a block; the postings are not read."""
        short = F.broadcast(asked) if asked.count() <= R.WORD_ROWS else asked
        heads = self.blocks(asked.sparkSession).select("part", "word", "slice", "most")
        met = heads.join(short, ["part", "word"]).groupBy("q_id", "slice", "_all").agg(F.count("*").alias("_n"), F.min("most").alias("_least"), F.sum("most").alias("_sum"))
        covers = F.least(F.col("_least") * F.col("_all"), F.col("_sum") - F.col("_all") + 1)
        return met.where("_n = _all").select("q_id", "slice", (covers * R.COVER + 1e-9).alias("bound"))

    def _met(self, asked: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """As retrieve's: rows that hold all words of a query, with the places of each word; in the slices of pairs (q_id, slice) only.

        Of the words of a query the one with the fewest rows gives its candidates; places of the others are read for candidates alone.
        """
        if pairs is not None:
            return self._met_in(asked, pairs)
        blocks, keys = self.blocks(asked.sparkSession), ["part", "word"]
        sizes = blocks.groupBy(*keys).agg(F.sum("rows").alias("_rows"))
        rarest = asked.join(sizes, keys, "left").groupBy("q_id", "_all").agg(F.min_by(F.struct("part", "word"), "_rows").alias("_key"), F.count("_rows").alias("_known"))
        rarest = cut(rarest.where("_known = _all").select("q_id", "_key.*"))
        live = asked.join(rarest.select("q_id"), "q_id", "left_semi")
        candidates = blocks.join(R.few(rarest), keys).select("q_id", F.explode("postings.id").alias("id"))
        candidates = cut(candidates.distinct())
        ids = R.few(candidates.select(F.col("id").alias("_id")).distinct())
        postings = blocks.join(R.few(live.select(*keys).distinct()), keys, "left_semi").select("word", F.explode("postings").alias("p")).select("word", "p.id", F.col("p.ats").alias("_ats"))
        hits = postings.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        return R.of_candidates(candidates, asked, hits, "q_id")

    def _met_in(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """_met in the slices of pairs: the blocks that any query reads are moved to their slice, once for each TURN_QUERIES queries, and its queries meet them there.

        For each word the slices where it is read are broadcast. Where they are too many for that, all blocks of the words are moved.
        """
        turns = max(-(-asked.select("q_id").distinct().count() // TURN_QUERIES), 1)
        lists = asked.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "word"))), lambda x: x["word"]).alias("_words"))
        readers = R.dealt(pairs.join(lists, "q_id").select("q_id", "slice", "_words"), "q_id", "_turn", turns)
        read = R.dealt(asked.join(pairs, "q_id"), "q_id", "_turn", turns).groupBy("part", "word", "_turn")
        read = cut(read.agg(F.collect_set(F.col("slice").cast("int")).alias("_slices")))
        blocks = self.blocks(asked.sparkSession)
        if (read.agg(F.sum(F.size("_slices").cast("long"))).head()[0] or 0) <= READ_SLICES:
            blocks = blocks.join(R.few(read), ["part", "word"]).where(F.array_contains("_slices", F.col("slice").cast("int")))
        else:
            blocks = blocks.join(R.few(read.drop("_slices")), ["part", "word"])
        p = F.col("postings")  # columns of plain numbers take less of a shuffle than rows in rows
        blocks = blocks.select("slice", "_turn", "word", p["id"].alias("ids"), F.transform(p, lambda x: F.size(x["ats"])).alias("many"), F.flatten(p["ats"]).alias("ats"))
        found = ArrayType(StructType([StructField("_word", IntegerType()), StructField("_ats", ArrayType(IntegerType()))]))
        id_type = self.schema["postings"].dataType.elementType["id"]
        schema = StructType([asked.schema["q_id"], id_type, StructField("_all", IntegerType()), StructField("n_hits", LongType()), StructField("_found", found)])
        return blocks.groupBy("slice", "_turn").cogroup(readers.groupBy("slice", "_turn")).applyInArrow(_meet(_kinds(schema)), schema)

    def matching(self, queries: DataFrame) -> DataFrame:
        """(q_id, id, n_hits): the rows of retrieve.matching; q_id names one query."""
        return self._met(self._asked(queries)).select("q_id", "id", "n_hits")

    def ranked(self, queries: DataFrame) -> DataFrame:
        """(q_id, id, n_hits, text_rank): the rows of retrieve.ranked; q_id names one query."""
        return R.cover_ranks(self._met(self._asked(queries)))

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """(q_id, id, n_hits, text_rank, rank): the k best rows of ranked for each query."""
        asked = self._asked(queries)
        order = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("bound"), "slice"))
        left, upto, best = cut(self._live(asked).withColumn("_order", order)), HEADS, None
        while best is None or not left.isEmpty():
            fresh = R.cover_ranks(self._met(asked, left.where(F.col("_order") <= upto).select("q_id", "slice")))
            best = cut(R.top(fresh if best is None else best.drop("rank").unionByName(fresh), "text_rank", k))
            least = best.where(F.col("rank") == k).select("q_id", F.col("text_rank").alias("_least"))
            left = cut(left.where(F.col("_order") > upto).join(least, "q_id", "left").where("_least is null or bound >= _least").drop("_least"))
            upto *= GROWTH
        return best


def build(corpus: DataFrame, path: str, slice_rows: int = SLICE_ROWS, parts: int = PARTS) -> WordIndex:
    """An index of all rows of corpus (id, text) in the folder path. Texts are read once for their words and once for their lengths."""
    of, free = _slices(corpus, slice_rows, 0)
    made = _blocks(corpus, of, parts, free)
    made.write.mode("overwrite").partitionBy("part").parquet(path)
    return WordIndex(path, made.schema, parts, free)


def opened(spark: SparkSession, path: str, parts: int = PARTS) -> WordIndex:
    """The index that was built in the folder path with so many parts."""
    blocks = spark.read.parquet(path)
    return WordIndex(path, blocks.schema, parts, blocks.agg(F.coalesce(F.max("slice") + 1, F.lit(0))).head()[0])
