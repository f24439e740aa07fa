"""Tokenized documents packed into sequences by the sum of squares.

Each task reads its documents in a stream, tokenizes them, cuts those that are longer than
a sequence, and packs its pieces in lots of up to LOT pieces. A lot's pieces are placed in
order of falling length, each into the open bin for which the sum over residual gaps of
squared counts of open bins becomes smallest; a new bin is opened when no open bin fits.
Open bins are known by their gap, so the state is one count for each gap, and a choice
looks at all gaps at once. Lots are closed at their end: a lot of thousands of pieces
leaves one or two bins unfilled. Nothing is shuffled and no task holds more than a lot.

A document is its ids, then the end id. A document longer than a sequence is cut so that
only the first piece is shorter. Null text is empty: one end id. Rows with a null or
repeated doc_id are packed like others. Further columns are ignored.

Ids come from the tokenizer, once for each different word of some MB of text, and are laid
out by array operations. Words are cut only where the tokenizer's own rule cuts, too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans_of, tidy

LENGTH = 1024
END_ID = 2
LOT, LOT_IDS = 16_384, 8_000_000

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: White space that holds a space which is not its first or last character, or a NUL (the line mark below): such text isn't cut.
_UNCUT = rf"{_SPACE} {_SPACE}|{_SPACE} $|\x00"
#: White space beside a line end: such text isn't cut at line ends.
_LINE_SPACE = rf"{_SPACE}\n|\n{_SPACE}|\n$|^\n"
_PLAIN = re.compile(r" ?\S+")
TOGETHER = 8  # words encoded as lines of one text
LOT_CHARS = 16 << 20  # text whose distinct words are encoded at once
LAID_WORDS = 1 << 17  # words whose ids are laid out at once


class Encoder:
    """Ids of whole texts, by a tokenizer of the byte-level kind whose ids of a text without a cut word are known to be its words' ids end to end."""

    _open: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        line = self.direct(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None  # tokenizers whose line end is one id of its own

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has. Plain words are encoded a few at a time, as lines of one text."""
        plain = [self.line is not None and _PLAIN.fullmatch(w) is not None for w in words]
        lined = [w for w, p in zip(words, plain) if p]
        counts = np.zeros(len(words), np.int64)
        parts = []
        for a in range(0, len(lined), TOGETHER * 250):
            rows = ["\n".join(lined[b : b + TOGETHER]) + "\n" for b in range(a, min(a + TOGETHER * 250, len(lined)), TOGETHER)]
            parts += self.direct(rows)
        flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        ends = np.flatnonzero(flat == self.line)
        plain = np.array(plain, bool)
        counts[plain] = np.diff(ends, prepend=-1) - 1
        flat = np.delete(flat, ends)
        odd = np.flatnonzero(~plain)
        if len(odd):
            own = self.direct([words[i] for i in odd])
            counts[odd] = [len(x) for x in own]
            before = np.cumsum(counts * plain)[odd]
            flat = np.insert(flat, np.repeat(before, counts[odd]), np.concatenate(own))
        return flat, counts

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(a, b, ids, first) for ranges of texts (string, no nulls): ids of texts a to b end to end, each with end_id after it, and where each text's begin.

        Words are encoded once for all texts; their ids are laid out for LAID_WORDS words at once, so that arrays of a place for each id are small.
        """
        n = len(texts)
        uncut = pc.match_substring_regex(texts, _UNCUT)
        lines = pc.if_else(pc.match_substring_regex(texts, _LINE_SPACE), texts, pc.replace_substring(texts, "\n", " \0 "))
        cut = pc.split_pattern(pc.if_else(uncut, "", lines), " ")
        first = np.asarray(cut.offsets).astype(np.int64)
        coded = cut.values.dictionary_encode()
        del lines, cut
        known = coded.dictionary.to_pylist()
        code = np.asarray(coded.indices)
        mark = known.index("\0") if "\0" in known else -1
        leads = np.zeros(len(code), bool)  # words without a space before them
        leads[first[:-1]] = True
        leads[1:] |= code[:-1] == mark
        leads |= code == mark
        key = 2 * code + leads
        used = np.zeros(2 * len(known), bool)
        used[key] = True
        at = np.flatnonzero(used)
        place = np.cumsum(used, dtype=np.int32) - np.int32(1)
        word = ["\n" if i >> 1 == mark else known[i >> 1] if i & 1 else " " + known[i >> 1] for i in at.tolist()]
        whole = np.flatnonzero(np.asarray(uncut))
        flat, counts = self.words(word)
        own = self.direct(texts.take(pa.array(whole)).to_pylist()) if len(whole) else []
        flat = np.concatenate([flat, *own, np.array([end_id], "<u4")])
        counts = np.concatenate([counts, [len(x) for x in own], [1]]).astype(np.int64)
        code = place[key]
        code[first[:-1][whole]] = len(word) + np.arange(len(whole))
        begin = np.cumsum(counts) - counts
        del coded, known, word, key, leads
        for a, b in spans_of(np.diff(first), LAID_WORDS):
            here = np.insert(code[first[a] : first[b]], first[a + 1 : b + 1] - first[a], len(counts) - 1)
            size = counts[here]
            total = np.concatenate(([0], np.cumsum(size)))
            ids = flat[np.repeat(begin[here] - total[:-1], size) + np.arange(total[-1])]
            yield a, b, ids, total[np.append(first[a:b] - first[a] + np.arange(b - a), len(here))]


def pack(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, by the sum of squares, in order of falling size; sizes are 1 to length."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == length).sum())
    bins[order[:full]] = np.arange(full)
    n, count = full, np.zeros(length + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    far = np.int64(1) << 40
    for i in order[full:]:
        s = int(sizes[i])
        here = count[s:length]
        change = np.where(here > 0, 1 - 2 * here, far)
        change[1:] += 2 * count[1 : length - s] + 1
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] < far >> 1:
            gap = s + k
            b = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, b = length, n
            n += 1
        bins[i], offsets[i] = b, length - gap
        if gap > s:
            waiting[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def _packed(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, next_bin = Encoder.at(path), TaskContext.get().partitionId() << 36
        ids, pieces, starts, blobs, held = [], [], [], [], 0

        def lot() -> pa.RecordBatch:
            nonlocal next_bin, held
            sizes = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
            bins, offsets = pack(sizes, length)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes), pa.array(blobs, pa.binary()), pa.array(bins + next_bin), pa.array(offsets)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )
            next_bin += int(bins.max()) + 1
            for x in (ids, pieces, starts, blobs):
                x.clear()
            held = 0
            return batch

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts, names = pc.fill_null(batch.column("text"), ""), batch.column("doc_id").to_pylist()
            for a, b in spans_of(np.asarray(pc.binary_length(texts)), LOT_CHARS):
                for c, d, every, first in encoder.encode(texts.slice(a, b - a), end_id):
                    for name, x, y in zip(names[a + c : a + d], first[:-1].tolist(), first[1:].tolist()):
                        n = y - x
                        head = n % length or length
                        for p, s in enumerate([0, *range(head, n, length)]):
                            e = head if p == 0 else s + length
                            ids.append(name)
                            pieces.append(p)
                            starts.append(s)
                            blobs.append(every[x + s : x + e].tobytes())
                        held += n
                        if len(blobs) >= LOT or held >= LOT_IDS:
                            yield lot()
        if blobs:
            yield lot()

    return run


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids binary, sequence_id, offset): every piece and its place.

    ids are little-endian unsigned 32-bit ids; the documents' ids of a sequence lie end to end from offset 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_packed(tokenizer, length, end_id)), f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
