"""Helpers shared by the corpus operators: the shared folder, batching and word hashing.

A word is a maximal run of bytes other than the ASCII white space 0x20 and
0x09-0x0D.  Hashes are computed for whole batches with numpy, never per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5

_U = np.uint64
_MULT, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_STEP), -1, 1 << 64))
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[9, 10, 11, 12, 13, 32]] = True
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_SHINGLE_KEYS = np.random.default_rng(5).integers(1, 2**63, SHINGLE, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='umbra-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a table written once to the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/umbra/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: Column, folds: int) -> Column:
    """True for rows whose crc32(doc_id as text) is divisible by folds; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def arrow_map(df: DataFrame, schema: str, f: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], barrier: bool = False) -> DataFrame:
    return df.mapInArrow(f, schema, barrier)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow; at a task's end memory that Arrow holds unused goes back to the system, as workers stay for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return run


def spans(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts holding about limit bytes each; one long text is a range of its own."""
    return spans_of(map(len, texts), limit)


def spans_of(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of the given sizes, as spans."""
    start = size = i = 0
    for i, n in enumerate(sizes, 1):
        if size and size + n > limit:
            yield start, i - 1
            start, size = i - 1, 0
        size += n + 1
    if start < i:
        yield start, i


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MULT
    h = (h ^ (h >> _U(29))) * _STEP
    return h ^ (h >> _U(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, (1 << 20) + 65536)
        tables = []
        for base in (_STEP, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
        if size > 1 << 22:  # not kept: one very long text
            return tables
        _powers[:] = tables
    return _powers


class Words:
    """Words of a few texts: 64-bit hash, byte range, and the index of each text's first word."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        gap = _BREAKS[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.end) < len(self.start):
            self.start = self.start[: len(self.end)]
        power, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_KEYS[raw] * power[: len(raw)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begin).astype(np.int64)

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every k consecutive words, at the place of the first (last k-1 places cut)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h += hashes[j : j + n] * _SHINGLE_KEYS[j]
    return mix(h)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingle hashes of each text, ascending, end to end; and where each text's begin.

    A text of one to four words has its whole sequence as one shingle, one without words none.
    """
    g, parts, sizes = grams(words.hash), [], []
    first = words.first
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= SHINGLE:
            s = np.sort(g[a : b - SHINGLE + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = mix((words.hash[a:b] * _SHINGLE_KEYS[:n]).sum(keepdims=True) + _U(n))
        else:
            s = g[:0]
        parts.append(s)
        sizes.append(len(s))
    return (np.concatenate(parts) if parts else g[:0]), np.cumsum([0, *sizes])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as bytes."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def texts_of(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> list[bytes]:
    """The texts of a batch as bytes, null as empty."""
    out = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    return [t.lower() for t in out] if lower else out


def word_array(text: Column) -> Column:
    """The words of a text column, as an array."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def gathered(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df, which comes out of a shuffle, in tasks of about so many of its rows; never in more than the shuffle has, nor in fewer than there are cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // each + 1))


def lowest(df: DataFrame, rows: int, column: str = "_hash") -> DataFrame:
    """The rows with the lowest values of a column of 64-bit hashes: about twice as many as asked for, all if there are fewer.

    What a later sort and limit sends to one place then doesn't grow with the number of tasks.
    """
    n = df.count()
    if n <= 2 * rows:
        return df
    return df.where(F.col(column) <= int(-(1 << 63) + (1 << 64) * 2 * rows // n))
