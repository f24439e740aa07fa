"""Repeated passages by FM-indexes over shards of the corpus.

A window is 20 consecutive words. A word goes if a window that covers it also starts
earlier: in a document with a smaller doc_id, or earlier in the same document.

1. Every window is named by the smallest hash among its 16 five-word strings. Windows
   with equal words have equal names, and a run of windows with one name is a passage of
   at most 35 words. Names are counted over the corpus; those met twice or more are set in
   a bit table of at most 2**27 bits (a false bit only sends a passage on in vain).
2. Passages with a set name go to the shard of their name. Each task sends one row for all
   copies of a passage within LOT_BYTES of text; passages whose names are met very often are
   added up by content before they go to a shard, and their names are refined by the window's
   second smallest hash. Windows with equal words always meet in one shard.
3. Each shard builds a compressed FM-index of its distinct passages, about SHARD_WORDS
   words, and streams them through it: backward search over the wavelet matrix gives every
   window's matching statistic and the interval of its occurrences. A statistic at the
   threshold with an interval of two or more is a repeat; the index knows the interval's
   first place.
4. What was found goes back to the passages' places by content, then to the documents: one
   shuffle of keys and places, one of the texts.

Words are kept as they are. Null text has no words. Rows with a null doc_id are returned
untouched and are no earlier place for others. Rows that repeat a doc_id are told apart by
their texts; equal places of equal ids are not earlier than each other. Further columns
pass through; columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, _power_tables, forget, gathered, grams, mix, spans, spans_of, texts_of, tidy, written
from .fm_index import FmIndex

WINDOW, GRAM = 20, 5
RUN = 16  # windows of a passage
TABLE_BITS = 27
TABLE_BLOCKS = 1 << TABLE_BITS - 15  # of 4 KB
SHARD_WORDS = 500_000
LOT_BYTES = 32 << 20  # text whose equal passages a task adds up
SENT_BYTES = 4 << 20  # words of passages that are made into rows at once
HOT_LEAST, HOT_MOST = 20_000, 1_000_000  # a name is hot beyond so many windows' runs; at most so many names are


class Passages:
    """Runs of equally named windows of a few texts."""

    def __init__(self, texts: list[bytes], hot: np.ndarray | None = None):
        """hot: ascending names to be refined."""
        self.words = w = Words(texts)
        g, first = grams(w.hash, GRAM), w.first
        n = len(g) - (WINDOW - GRAM)
        empty = np.zeros(0, np.int64)
        self.start = self.count = self.text = empty
        self.name = self.route = np.zeros(0, np.uint64)
        self.twice = np.zeros(0, bool)  # a passage may hold a window more than once
        if n <= 0:
            return
        low, twice = g, np.zeros(len(g), bool)
        for shift in (1, 2, 4, 8):
            a, b = low[:-shift], low[shift:]
            twice = np.where(a < b, twice[:-shift], np.where(b < a, twice[shift:], True))
            low = np.minimum(a, b)
        text = np.repeat(np.arange(len(texts)), w.count())[:n]
        own = np.arange(n) + WINDOW <= first[1:][text]
        name = low[:n]
        route = name
        if hot is not None and len(hot):
            route = name.copy()
            at = np.flatnonzero(own & (hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name))
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                around = g[part[:, None] + np.arange(WINDOW - GRAM + 1)]
                around[around == name[part][:, None]] = np.uint64(2**64 - 1)
                route[part] = mix(name[part] + mix(around.min(axis=1)))
        place = np.flatnonzero(own)
        if not len(place):
            return
        r, t = route[place], text[place]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (place[1:] != place[:-1] + 1)))
        begin = np.flatnonzero(new)
        new |= (np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))) % RUN == 0
        begin = np.flatnonzero(new)
        self.start, self.count, self.text = place[begin], np.diff(np.append(begin, len(place))), t[begin]
        self.name, self.route = name[self.start], r[begin]
        self.twice = np.logical_or.reduceat(twice[place], begin)

    def content(self) -> np.ndarray:
        """A hash of each passage's words."""
        h = self.words.hash
        power, inverse = _power_tables(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=total[1:])
        end = self.start + self.count + WINDOW - 1
        return mix((total[end] - total[self.start]) * inverse[self.start] + self.count.astype(np.uint64))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch)
        for a, b in spans(texts):
            p = Passages(texts[a:b])
            k, n = np.unique(np.concatenate((p.name, p.name[p.twice])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["name", "n"])


def _suspects(shared, hot_only: bool | None):
    """Passages whose name is in the table. hot_only: those of hot names, or of others, once for each LOT_BYTES of text, with their words and number; None: every place, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = shared.value
        bits, shift = np.frombuffer(table, np.uint8), np.uint64(64 - TABLE_BITS)
        held: list[tuple[bytes, dict[str, np.ndarray]]] = []
        size = 0

        def lot() -> Iterator[pa.RecordBatch]:
            nonlocal size
            every = {k: np.concatenate([f[k] for _, f in held]) for k in held[0][1]}
            part = np.repeat(np.arange(len(held)), [len(f["route"]) for _, f in held])
            copies = np.ones(len(part), np.int64)
            if hot_only is not None:
                order = np.lexsort((every["mark"], every["start"], every["doc_id"], every["content"], every["route"]))
                r, c = every["route"][order], every["content"][order]
                edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1]))))
                copies, keep = np.diff(np.append(edge, len(order))), order[edge]
                every, part = {k: v[keep] for k, v in every.items()}, part[keep]
            names = ["route", "content", "doc_id", "mark", "start", "windows"]
            arrays = [pa.array(every["route"].view(np.int64)), pa.array(every["content"].view(np.int64)), pa.array(every["doc_id"]), pa.array(every["mark"]), pa.array(every["start"] - every["zero"]), pa.array(every["windows"])]
            data = [d for d, _ in held]
            held.clear()
            size = 0
            if hot_only is None:
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                return
            names += ["copies", "words"]
            low, high = every["low"], every["high"]
            for a, b in spans_of((high - low).tolist(), SENT_BYTES):
                blobs = [data[p][x:y] for p, x, y in zip(part[a:b].tolist(), low[a:b].tolist(), high[a:b].tolist())]
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in arrays), pa.array(copies[a:b]), pa.array(blobs, pa.binary())], names=names)

        for batch in batches:
            texts = texts_of(batch)
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "mark"))
            for a, b in spans(texts):
                p = Passages(texts[a:b], hot)
                slot = (p.name >> shift).astype(np.int64)
                met = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                if hot_only is not None:
                    met &= (p.route != p.name) == hot_only
                keep = np.flatnonzero(met)
                if not len(keep):
                    continue
                text, start, count = p.text[keep], p.start[keep], p.count[keep]
                found = {"route": p.route[keep], "content": p.content()[keep], "doc_id": ids[a + text].astype(np.int64), "mark": marks[a + text].astype(np.int32), "start": start, "windows": count.astype(np.int32), "zero": p.words.first[text]}
                if hot_only is not None:
                    found |= {"low": p.words.start[start], "high": p.words.end[start + count + WINDOW - 2]}  # the passage's bytes
                held.append((p.words.data if hot_only is not None else b"", found))
                size += len(p.words.data)
                if size >= (LOT_BYTES if hot_only is not None else 1 << 20):
                    yield from lot()
        if held:
            yield from lot()

    return run


def _search(shard: pd.DataFrame) -> pd.DataFrame:
    """For each distinct passage its first place, its copies, and bits of its windows that are met at an earlier place; none for passages without a repeat."""
    shard = shard.sort_values(["route", "content", "doc_id", "start", "mark"])
    key = ["route", "content"]
    copies = shard.groupby(key, sort=False)["copies"].sum().to_numpy()
    shard = shard.drop_duplicates(key).assign(copies=copies).sort_values(["doc_id", "start", "mark"]).reset_index(drop=True)
    w = Words(list(shard["words"]))
    _, symbol = np.unique(w.hash, return_inverse=True)
    starts = w.first[:-1] + np.arange(len(shard))
    text = np.insert(symbol + 1, w.first[1:], 0)
    index = FmIndex(text, WINDOW)
    length, low, high = index.statistics(text, starts, starts + w.count())

    passage = np.repeat(np.arange(len(shard)), w.count() + 1)
    doc, at = shard["doc_id"].to_numpy()[passage], shard["start"].to_numpy()[passage] + np.arange(len(text)) - starts[passage]
    repeated = np.flatnonzero((length >= WINDOW) & (high - low > 1))
    # Places in order of (doc_id, start): the first of an interval is the one that comes first.
    before = index.first_place(low[repeated])
    earlier = (doc[before] < doc[repeated]) | ((doc[before] == doc[repeated]) & (at[before] < at[repeated]))
    own = repeated[earlier]
    bits = np.zeros(len(shard), np.int64)
    np.bitwise_or.at(bits, passage[own], np.int64(1) << (own - starts[passage[own]]))
    return shard[["route", "content", "doc_id", "start"]].assign(bits=bits)[(bits != 0) | (shard["copies"].to_numpy() > 1)]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, found in zip(texts_of(batch), batch.column("found").to_pylist()):
            words = text.split()
            away = 0
            if found:
                turn = np.zeros(len(words) + WINDOW + RUN + 1, np.int32)
                places = np.array([s + k for s, bits in ((f["start"], f["bits"]) for f in found) for k in range(RUN) if bits >> k & 1], np.int64)
                np.add.at(turn, places, 1)
                np.add.at(turn, places + WINDOW, -1)
                gone = np.cumsum(turn)[: len(words)] > 0
                away = int(gone.sum())
                rest = [w for w, g in zip(words, gone) if not g]
            else:
                rest = words
            n_words.append(len(words))
            n_removed.append(away)
            kept.append(b" ".join(rest))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["row", "n_words", "n_removed", "kept_text"],
        )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, found): for each text with repeated windows, the runs of windows met earlier.

    docs: doc_id long, text string, mark int; found is an array of (start, bits), bit k standing for the window at start + k.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null").select("doc_id", "mark", "text")
    names = known.select("text").mapInArrow(tidy(_names), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    names = written(names)
    slot = F.shiftrightunsigned("name", 64 - TABLE_BITS)
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = names.groupBy(F.shiftright(slot, 15).alias("k")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    table = bytearray(1 << (TABLE_BITS - 3))
    for k, bits in gathered(blocks, TABLE_BLOCKS, TABLE_BLOCKS // 8).toLocalIterator():  # each partition is a job of its own
        table[k * 4096 : k * 4096 + len(bits)] = bits
    often = max(HOT_LEAST, total // HOT_MOST)
    hot = np.sort(np.array([r[0] for r in names.where(F.col("n") > often).select("name").collect()], np.int64).view(np.uint64))  # fewer than HOT_MOST names
    shared = spark.sparkContext.broadcast((table, hot))
    del table  # it is in a file now

    forget(names)

    columns = "route long, content long, doc_id long, mark int, start long, windows int"
    shards = int(total) * (WINDOW + RUN // 2) // SHARD_WORDS + 1
    rows = known.mapInArrow(tidy(_suspects(shared, False)), f"{columns}, copies long, words binary")
    if len(hot):
        often_met = known.mapInArrow(tidy(_suspects(shared, True)), f"{columns}, copies long, words binary").groupBy("route", "content")
        summed = often_met.agg(F.min(F.struct("doc_id", "start", "mark")).alias("p"), F.sum("copies").alias("copies"), F.any_value("windows").alias("windows"), F.any_value("words").alias("words"))
        rows = rows.unionByName(summed.select("route", "content", "p.*", "copies", "windows", "words"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).repartition(shards // 4 + 1, "shard")
    firsts = rows.groupBy("shard").applyInPandas(_search, "route long, content long, doc_id long, start long, bits long")

    firsts = firsts.select("route", "content", F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), "bits")
    met = known.mapInArrow(tidy(_suspects(shared, None)), columns).join(firsts, ["route", "content"])
    first = (F.col("doc_id") == F.col("_doc")) & (F.col("start") == F.col("_start"))
    every = F.expr("shiftleft(1L, windows) - 1")
    met = met.select("doc_id", "mark", "start", F.when(first, F.col("bits")).otherwise(every).alias("bits")).where("bits != 0")
    return met.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "bits")).alias("found"))  # at most one entry for each window of a text


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by one space)."""
    own = docs.drop("n_words", "n_removed", "kept_text")
    text = F.col("text").cast("string")
    known = own.select(F.struct(*own.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int").alias("mark"))
    found = repeated_spans(known.select("doc_id", "mark", "text"))
    joined = known.join(found, ["doc_id", "mark"], "left").select("row", "text", "found")
    kinds = T.StructType([joined.schema["row"], *(T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())))])
    return joined.mapInArrow(tidy(_kept), kinds).select("row.*", "n_words", "n_removed", "kept_text")
