"""Token counts of whole texts by byte-pair merging with a heap and linked lists.

A text is split into words by the tokenizer's rule, a word into the symbols of its bytes.
The adjacent pair with the lowest rank (the leftmost of equal ones) is popped from a heap and
merged: the two neighbours in a linked list become one, and the pairs that the new symbol
forms are pushed. Pairs whose symbols have changed since are skipped when they are popped. A word's count is
its symbols less its merges; no list of ids is ever built. Words met lately are remembered
by text in two lots of some KNOWN words; when the newer lot is full it takes the older one's place.

Every row is counted where it lies: nothing is shuffled, a task holds one batch of rows and
CUT characters of words. Null text is empty and has no tokens; rows with null or repeated
ids are counted like others, an empty table gives an empty one, further columns are ignored.
The strings of special tokens count as one token each, as the library takes them by default.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
KNOWN, KNOWN_LENGTH = 1 << 19, 64
CUT = 1 << 20  # characters of a text whose words are listed at once

#: The byte-level split: contractions, letters, numbers, other signs, white space (all but the last of a run before a word).
_WORDS = regex.compile(r"'(?:[sdmt]|ll|re|ve)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space between two other characters always begins a word: texts may be cut there.
_SAFE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
_SHIFT = 32


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in plain}
    odd = (b for b in range(256) if b not in signs)
    return [s for _, s in sorted((signs | {b: chr(256 + k) for k, b in enumerate(odd)}).items())]


class Merges(dict):
    """Counts of words, worked out when first asked for."""

    _open: dict[str, "Merges"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = (told["model"]["type"], (told["pre_tokenizer"] or {}).get("type"), told["normalizer"])
        if kind != ("BPE", "ByteLevel", None) or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: a byte-level BPE tokenizer without normalizer is needed, not {kind}")
        self.split = Tokenizer.from_file(path).pre_tokenizer
        self.older: dict[str, int] = {}
        self.assigned: set[str] = set()
        ids = told["model"]["vocab"]
        pairs = (p if isinstance(p, list) else p.split(" ") for p in told["model"]["merges"])
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbols = [ids[s] for s in _byte_signs()]
        special = [t for t in told["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not known")
        longest = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if longest else None

    @classmethod
    def at(cls, path: str) -> "Merges":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __missing__(self, word: str) -> int:
        n = self.older.get(word) or self.merged(word.encode())
        if len(word) <= KNOWN_LENGTH:
            self[word] = n
        return n

    def merged(self, word: bytes) -> int:
        """Symbols that are left of a word when no pair can be merged any more."""
        ranks, symbol = self.ranks, [self.symbols[b] for b in word]
        n = left = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found[0] << _SHIFT | i for i in range(n - 1) if (found := ranks.get((symbol[i], symbol[i + 1])))]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & ((1 << _SHIFT) - 1)
            j = after[i]
            found = ranks.get((symbol[i], symbol[j])) if j < n else None
            if found is None or found[0] != top >> _SHIFT:
                continue
            symbol[i], symbol[j] = found[1], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if found := ranks.get((symbol[i], symbol[k])):
                    heappush(heap, found[0] << _SHIFT | i)
            if (h := before[i]) >= 0 and (found := ranks.get((symbol[h], symbol[i]))):
                heappush(heap, found[0] << _SHIFT | h)
        return left

    def words(self, text: str) -> list[str]:
        if not text.isascii() and (new := set(text) - self.assigned):
            self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
            if not new <= self.assigned:  # signs that are not assigned here: what the tokenizer's own tables say of them decides
                return [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]
        return _WORDS.findall(text)

    def count(self, text: str) -> int:
        total, start = 0, 0
        for gap in self.special.finditer(text) if self.special else ():
            total += 1 + self.plain(text[start : gap.start()])
            start = gap.end()
        return total + self.plain(text[start:] if start else text)

    def plain(self, text: str) -> int:
        total, start = 0, 0
        while start < len(text):
            cut = _SAFE.search(text, start + CUT) if len(text) - start > CUT else None
            end = cut.start() if cut else len(text)
            total += sum(map(self.__getitem__, self.words(text[start:end])))
            start = end
            if len(self) > KNOWN:
                self.older = dict(self)
                self.clear()
        return total


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.at(path)
        for batch in batches:
            counts = [merges.count(text) if text else 0 for text in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text); tokenizer: the path of a byte-level BPE .json file."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counted(tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
