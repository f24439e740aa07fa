"""Document likelihoods by prediction by partial matching, beside a unigram baseline.

The model is a trie of byte contexts of 0 to ORDER bytes with the counts of what followed
them in the training texts, over 256 bytes and an end mark; texts are padded with begin
marks. A symbol is predicted from the longest context met in training: there it has
(n - g) / t, t being the context's count and d the number of different symbols met, or
the escape gd / t is paid and the next shorter context is asked (GIVEN: g of the longest and of shorter contexts), without the symbols that
the longer context had offered (symbol exclusion). Shorter contexts count a symbol once for
each different longer context that it followed. Below the empty context the symbols
never met share what is left. ORDER bytes of context make a symbol's probability a
function of ORDER + 1 bytes, so it is worked out once per distinct string of that length:

1. One pass counts strings of ORDER + 1 symbols and words, summed in each task first. They
   go to buckets by a hash of the three nearest context bytes (words: of the word), sorted
   and packed. A bucket holds the whole trie below its contexts of three bytes.
2. Contexts of up to two bytes join the buckets: their nodes (at most 258**3) are added up
   over the buckets and broadcast. Each bucket then knows the value of all its strings.
3. A second pass sums each document's values. The TABLE most frequent strings and words
   are broadcast (a fixed number of rows). What a lot of documents has of the rest goes to
   the buckets, packed likewise, and the sums come back to the lot.

Buckets number one for each BUCKET_BYTES of text, MOST_BUCKETS at most; beyond that, each
is salted. Texts are lower-cased (A-Z) bytes; words are told apart by 64-bit hashes. Null
texts are empty: one end token, one end mark. Without training texts every symbol has
1/257 and no token is known. Rows with null or repeated doc_id are scored one by one.
Further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, forget, mix, spans, texts_of, written

ORDER = 6
BITS = 9
GLOBAL = 2  # contexts of up to so many bytes are shared by all buckets
GIVEN = (0.5, 0.35)  # by three folds inside the training rows of the table of 1000 documents
END, BEGIN = 256, 257
SYMBOLS = 257
TABLE = 1 << 20
HELD = 1_500_000  # entries that a task sums up before it passes them on
LOT_BYTES = 16 << 20
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 16_384
STRING, WORD = 0, 1
_END_WORD = np.uint64(2**64 - 1)  # the end token's key
_LOW = np.uint64((1 << BITS) - 1)


def _shift(k: int) -> np.uint64:
    return np.uint64(BITS * k)


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER + 1 symbols ending at each symbol of the texts and at their ends; and where each text's begin.

    A code has the nearest context byte first and the symbol itself last.
    """
    pad = np.full(ORDER, BEGIN, dtype=np.uint64)
    flat = np.concatenate([x for t in texts for x in (pad, np.frombuffer(t, dtype=np.uint8).astype(np.uint64), [np.uint64(END)])])
    code = flat.copy()
    for j in range(1, ORDER + 1):
        code[j:] |= flat[:-j] << _shift(ORDER + 1 - j)
    own = flat != BEGIN
    return code[own], np.cumsum([0] + [len(t) + 1 for t in texts])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed byte by byte of their digits."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8).T)
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=-1)) + 1
    return struct.pack("<QB", len(x), used) + (pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True) if used else b"")


def unpacked(blob: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<QB", blob)
    planes = np.zeros((8, n), np.uint8)
    if used:
        planes[:used] = np.frombuffer(pa.decompress(blob[9:], n * used, codec="zstd"), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def ascending(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_ascending(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys >> _shift(ORDER + 1 - 3) if kind == STRING else keys) % np.uint64(buckets)).astype(np.int32)


def _by_bucket(kind: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of ascending keys; places keep the keys' order."""
    b = _bucket(kind, keys, buckets)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for x, y in zip([0, *cut], [*cut, len(order)] if len(order) else []):
        yield int(b[order[x]]), order[x:y]


def _summed(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[edge], *(np.add.reduceat(np.concatenate(c)[order], edge) if len(k) else np.zeros(0, np.int64) for c in counts)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
    """Keys of all tokens, each text's end token after its words; and where each text's begin."""
    w = Words(texts)
    first = w.first + np.arange(len(w.first))
    return np.insert(w.hash, w.first[1:], _END_WORD), first, w


def _count(buckets: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {STRING: ([], [], []), WORD: ([], [], [])}
        salt = TaskContext.get().partitionId() % salts

        def add(kind: int, values: np.ndarray, train: bool) -> None:
            k, n = np.unique(values, return_counts=True)
            for x, v in zip(held[kind], (k, n if train else np.zeros(len(n), np.int64), n)):
                x.append(v)

        def out(kind: int, limit: int) -> Iterator[pa.RecordBatch]:
            parts = held[kind]
            if not parts[0] or sum(map(len, parts[0])) <= limit:
                return
            summed = _summed(*parts)
            for x, v in zip(parts, summed):
                x[:] = [v]
            if len(summed[0]) > limit // 2:
                rows = [(b, ascending(summed[0][at]), packed(summed[1][at]), packed(summed[2][at])) for b, at in _by_bucket(kind, summed[0], buckets)]
                own, *blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array([salt] * len(own), pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["kind", "bucket", "salt", "keys", "trained", "every"])
                for x in parts:
                    x.clear()

        for batch in batches:
            texts, away = texts_of(batch, lower=True), batch.column("held_out").to_numpy(zero_copy_only=False)
            for train in (True, False):
                own = [t for t, h in zip(texts, away) if h != train]
                for a, b in spans(own):
                    add(STRING, strings(own[a:b])[0], train)
                    add(WORD, _tokens(own[a:b])[0], train)
                    for kind in held:
                        yield from out(kind, HELD)
        for kind in held:
            yield from out(kind, 0)

    return run


def _octave(n: np.ndarray) -> np.ndarray:
    """Quarter octaves of frequency."""
    return np.floor(np.log2(n) * 4).astype(np.int64)


def shorter(code: np.ndarray) -> np.ndarray:
    """Nodes without the farthest byte of their context."""
    return code >> _shift(2) << _shift(1) | code & _LOW


def _merged(last: bool):
    """Adds up the packed counts of a bucket. last: with what the bucket's strings add to nodes of GLOBAL bytes, and how many keys each quarter octave of frequency has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked_ascending(x) for x in pdf["keys"]]
        keys, trained, every = _summed(parts, *([unpacked(x).astype(np.int64) for x in pdf[c]] for c in ("trained", "every")))
        row = {"kind": pdf["kind"].iloc[0], "bucket": pdf["bucket"].iloc[0], "salt": 0 if last else pdf["salt"].iloc[0], "keys": ascending(keys), "trained": packed(trained), "every": packed(every)}
        if last:
            code = keys[trained > 0]
            if row["kind"] == STRING:
                for _ in range(ORDER - GLOBAL - 1):
                    code = np.unique(shorter(code))
                code, n = np.unique(shorter(code), return_counts=True)
            else:
                code, n = code[:0], np.zeros(0, np.int64)
            row |= {"nodes": code.view(np.int64), "node_counts": n, "octaves": np.bincount(_octave(every), minlength=256), "train_tokens": int(trained.sum()), "train_words": int((trained > 0).sum())}
        return pd.DataFrame([row])

    return run


class Level:
    """Nodes of one order: ascending codes with counts; and for each context its count, its different symbols, and what these count in the next shorter context."""

    def __init__(self, code: np.ndarray, n: np.ndarray, below: "Level | None"):
        self.code, self.n = code, n
        c = code >> _shift(1)
        edge = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
        self.context, self.d = c[edge], np.diff(np.append(edge, len(c)))
        self.t = np.add.reduceat(n, edge) if len(c) else n
        offered = below.n[np.searchsorted(below.code, shorter(code))] if below is not None and len(c) else np.zeros(len(c), np.int64)
        self.offered = np.add.reduceat(offered, edge) if len(c) else n


def _look(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an ascending table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def levels_of(code: np.ndarray, n: np.ndarray, top: int, low: list[Level], given_low: int) -> list[Level]:
    """Levels given_low .. top above the levels low, from the nodes of order top."""
    nodes = [(code, n)]
    for _ in range(top - given_low):
        nodes.append(np.unique(shorter(nodes[-1][0]), return_counts=True))
    levels = list(low)
    for c, m in reversed(nodes):
        levels.append(Level(c, m, levels[-1] if levels else None))
    return levels


def string_values(keys: np.ndarray, trained: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 of the model's probability of each string of a bucket; low: the levels of up to GLOBAL bytes."""
    met = trained > 0
    levels = levels_of(keys[met], trained[met], ORDER, low, GLOBAL + 1)
    value = np.zeros(len(keys))
    top = levels[ORDER]
    value[met] = np.log10((top.n - GIVEN[0]) / top.t[np.searchsorted(top.context, keys[met] >> _shift(1))])

    left = np.flatnonzero(~met)
    paid, above_d, above_t = np.zeros(len(left)), np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for k in range(ORDER, -1, -1):
        level, key, given = levels[k], keys[left], GIVEN[k < ORDER]
        c = key >> _shift(ORDER + 1 - k)
        i, seen = _look(level.context, c)
        j, known = _look(level.code, c << _shift(1) | key & _LOW)
        if not seen.any():
            continue
        t, d = np.where(seen, level.t[i] - above_t, 1), np.where(seen, level.d[i] - above_d, 0)
        value[left[known]] = paid[known] + np.log10((level.n[j] - given)[known] / t[known])
        escapes = seen & ~known & (d > 0)
        paid[escapes] += np.log10(given * d[escapes] / t[escapes])
        above_d, above_t = np.where(seen, level.d[i], above_d), np.where(seen, level.offered[i], 0)
        left, paid, above_d, above_t = (x[~known] for x in (left, paid, above_d, above_t))
    value[left] = paid - np.log10((SYMBOLS - above_d).astype(float))
    return value


def _valued(shared):
    """Values of the keys of each bucket, and those of its most frequent keys apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, least, total, distinct = shared.value
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                keys, trained, every = unpacked_ascending(r.keys), unpacked(r.trained).astype(np.int64), unpacked(r.every)
                if r.kind == STRING:
                    value, own = string_values(keys, trained, low), np.ones(len(keys), bool)
                else:
                    value, own = np.log10((trained + 0.1) / (total + 0.1 * (distinct + 1))), trained > 0
                often = _octave(every) >= least[r.kind]
                rare = own & ~often
                often &= own
                rows.append((r.kind, r.bucket, ascending(keys[rare]), value[rare].tobytes(), keys[often].tobytes(), value[often].tobytes()))
            yield pd.DataFrame(rows, columns=["kind", "bucket", "keys", "values", "often", "often_values"])

    return run


class Lookup:
    """An open-addressed table from 64-bit keys to values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits), np.zeros(1 << bits, bool)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[slot[left]]]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]], self.used[slot[put]] = keys[put], values[put], True
            left = left[self.keys[slot[left]] != keys[left]] if len(put) else left
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        slot = self._slot(keys)
        found = (self.keys[slot] == keys) & self.used[slot]
        value = np.where(found, self.values[slot], 0.0)
        left = np.flatnonzero(~found & self.used[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            s = slot[left]
            hit = (self.keys[s] == keys[left]) & self.used[s]
            value[left[hit]], found[left[hit]] = self.values[s[hit]], True
            left = left[~hit & self.used[s]]
        return value, found


def _frequent(valued: DataFrame) -> list[Lookup]:
    """Tables of the frequent strings and words: TABLE at most of each."""
    out = []
    for kind in (STRING, WORD):
        rows = list(valued.where(F.col("kind") == kind).select("often", "often_values").toLocalIterator())
        out.append(Lookup(*(np.frombuffer(b"".join(bytes(r[i]) for r in rows), t) for i, t in enumerate((np.uint64, np.float64)))))
    return out


def _score(shared, buckets: int, salts: int):
    """Sums of the frequent keys' values: a row for each document, and for each lot of documents and each bucket a row with what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        lot = TaskContext.get().partitionId() << 32
        salt = TaskContext.get().partitionId() % salts
        place = size = 0
        rest: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {STRING: [], WORD: []}

        def left_over(kind_of_id: pa.DataType) -> Iterator[pa.RecordBatch]:
            for kind, parts in rest.items():
                if not parts:
                    continue
                keys, doc = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))) if len(keys) else np.zeros(0, np.int64)
                m, keys, doc = np.diff(np.append(edge, len(keys))), keys[edge], doc[edge]
                rows = [(b, ascending(keys[at]), packed(doc[at]), packed(m[at])) for b, at in _by_bucket(kind, keys, buckets)]
                if rows:
                    own, *blobs = zip(*rows)
                    n = len(own)
                    none = [pa.nulls(n, t) for t in (pa.int64(), kind_of_id, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array([lot] * n, pa.int64()), *none, pa.array([kind] * n, pa.int32()), pa.array(own, pa.int32()), pa.array([salt] * n, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=NAMES)

        for batch in batches:
            texts = texts_of(batch, lower=True)
            for a, b in spans(texts):
                n = b - a
                doc = place + np.arange(n)
                key, first = strings(texts[a:b])
                value, found = tables[STRING].find(key)
                score = np.add.reduceat(value, first[:-1])
                rest[STRING].append((key[~found], np.repeat(doc, np.diff(first))[~found]))
                token, first, w = _tokens(texts[a:b])
                value, known = tables[WORD].find(token)
                rest[WORD].append((token[~known], np.repeat(doc, np.diff(first))[~known]))
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, lot)), pa.array(doc), batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n), pa.array((w.count() + 1).astype(np.int64)), pa.array(np.add.reduceat(known, first[:-1], dtype=np.int64)), pa.array(np.add.reduceat(value, first[:-1])), pa.array(score), *none],
                    names=NAMES,
                )
                place += n
                size += sum(map(len, texts[a:b])) + 64 * n
                if size >= LOT_BYTES:
                    yield from left_over(batch.column("doc_id").type)
                    lot, place, size = lot + 1, 0, 0
        if place:
            yield from left_over(batch.column("doc_id").type)

    return run


NAMES = ["lot", "place", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "kind", "bucket", "salt", "keys", "docs", "counts"]


def _asked(unknown: float):
    """Sums of values for each document of each lot, from a bucket's values and what the lots ask for."""

    def run(asked: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        table = unpacked_ascending(values["keys"].iloc[0]) if len(values) else np.zeros(0, np.uint64)
        value = np.frombuffer(values["values"].iloc[0]) if len(values) else np.zeros(0)
        rows = []
        for r in asked.itertuples():
            keys, doc, m = unpacked_ascending(r.keys), unpacked(r.docs).astype(np.int64), unpacked(r.counts).astype(np.int64)
            at, known = _look(table, keys)
            v = np.full(len(keys), unknown)
            v[known] = value[at[known]]
            which, inverse = np.unique(doc, return_inverse=True)
            n = np.bincount(inverse, weights=m * known).astype(np.int64) if r.kind == WORD else np.zeros(len(which), np.int64)
            rows.append((r.lot, r.kind, ascending(which.astype(np.uint64)), np.bincount(inverse, weights=m * v).tobytes(), packed(n)))
        return pd.DataFrame(rows, columns=["lot", "kind", "docs", "sums", "known"])

    return run


def _totals(docs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """The rows of a lot's documents with what the buckets found for them; a lot has about LOT_BYTES of text."""
    n = len(docs)
    docs = docs.sort_values("place")
    more = {STRING: np.zeros(n), WORD: np.zeros(n)}
    known = np.zeros(n, np.int64)
    for r in sums.sort_values(["kind", "docs", "sums"]).itertuples():  # one order of additions
        at = unpacked_ascending(r.docs).astype(np.int64)
        more[r.kind][at] += np.frombuffer(r.sums)
        known[at] += unpacked(r.known).astype(np.int64)
    return docs.assign(n_known=docs["n_known"] + known, base_score=docs["base_score"] + more[WORD], score=docs["score"] + more[STRING]).drop(columns=["lot", "place"])


def likelihoods(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, size // BUCKET_BYTES + 8))
    salts = int(size // (buckets * 4 * BUCKET_BYTES) + 1)

    packs = "keys binary, trained binary, every binary"
    counted = rows.select("text", "held_out").mapInArrow(_count(buckets, salts), f"kind int, bucket int, salt int, {packs}")
    if salts > 1:
        counted = counted.groupBy("kind", "bucket", "salt").applyInPandas(_merged(False), f"kind int, bucket int, salt int, {packs}")
    more = "nodes array<long>, node_counts array<long>, octaves array<long>, train_tokens long, train_words long"
    counted = written(counted.groupBy("kind", "bucket").applyInPandas(_merged(True), f"kind int, bucket int, salt int, {packs}, {more}"))

    nodes = counted.where(F.col("kind") == STRING).select(F.explode(F.arrays_zip("nodes", "node_counts")).alias("x")).groupBy("x.nodes").agg(F.sum("x.node_counts").alias("n"))
    nodes = nodes.toPandas().sort_values("nodes")  # at most 258**3
    low = levels_of(nodes["nodes"].to_numpy(np.uint64), nodes["n"].to_numpy(np.int64), GLOBAL, [], 0)
    total, distinct = counted.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_words"), F.lit(0))).first()
    octaves = counted.select("kind", F.posexplode("octaves").alias("octave", "n")).groupBy("kind", "octave").agg(F.sum("n").alias("n")).collect()  # 512 rows
    least = []
    for k in (STRING, WORD):
        held, bound = 0, 256
        for o, n in sorted(((r.octave, r.n) for r in octaves if r.kind == k), reverse=True):
            held += n
            if held > TABLE:
                break
            bound = o
        least.append(bound)
    model = spark.sparkContext.broadcast((low, least, total, distinct))
    valued = written(counted.select("kind", "bucket", "keys", "trained", "every").mapInPandas(_valued(model), "kind int, bucket int, keys binary, values binary, often binary, often_values binary"))
    forget(counted)
    tables = spark.sparkContext.broadcast(_frequent(valued))

    blobs = "kind int, bucket int, salt int, keys binary, docs binary, counts binary"
    scored = written(rows.mapInArrow(_score(tables, buckets, salts), f"lot long, place long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, {blobs}"))
    asked = scored.where("kind is not null").select("lot", "kind", "bucket", "salt", "keys", "docs", "counts")
    salted = valued.select("kind", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "keys", "values")
    unknown = float(np.log10(0.1 / (total + 0.1 * (distinct + 1))))
    by = ("kind", "bucket", "salt")
    sums = asked.groupBy(*by).cogroup(salted.groupBy(*by)).applyInPandas(_asked(unknown), "lot long, kind int, docs binary, sums binary, known binary")
    found = scored.where("kind is null").select("lot", "place", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
    out = found.groupBy("lot").cogroup(sums.groupBy("lot")).applyInPandas(_totals, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
