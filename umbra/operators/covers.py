"""The best rows of many queries, found where each text lies: no word of a text leaves its row.

A block of queries is known to all tasks. A row is met by the queries whose rarest word (the one that the fewest queries ask for) it has, and
then by all of their words; its covers are counted there, and a task hands on the k best rows that it met for each query. So what is moved grows
with the queries and tasks, and not with the words of the corpus. A row that can't come among a task's k best is not counted out: n words
have at most n covers for each occurrence of any one of them, and at most as many as there are occurrences of all, less n - 1.
"""

from __future__ import annotations

from bisect import insort
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

COVER = 0.1  # weight of one occurrence
SLACK = 1e-9  # by which a rounded rank may lie above the bound of what was added up
STRIP = 64 << 20  # bytes of texts whose words are looked up at once
_PLACE = Decimal("0.000000001")


def rounded(rank: float) -> float:
    """As Spark rounds to nine places."""
    return float(Decimal(repr(float(rank))).quantize(_PLACE, ROUND_HALF_UP))


def cover_rank(number: list[int], at: list[int], n: int) -> float:
    """retrieve's cover_density from places in order: at, and number of the word there, of n words."""
    last, start, rank = OrderedDict(), -1, 0.0  # the latest place of each word, the earliest of these first
    for i, (w, place) in enumerate(zip(number, at)):
        last[w] = (place, i)
        last.move_to_end(w)
        if len(last) == n:
            first, j = next(iter(last.values()))
            if first > start:
                rank += COVER / (1 + max(place - first - (i - j), 0))
                start = first
    return rank


def most_covers(counts: np.ndarray) -> int:
    """The covers that a row with so many occurrences of each word has at most."""
    return min(int(counts.min()) * len(counts), int(counts.sum()) - len(counts) + 1)


class Best:
    """The k best rows of each query: highest rank first, then the smaller id, a null one before others."""

    def __init__(self, k: int, queries: int):
        self.k, self.rows, self.least = k, {}, np.full(queries, -np.inf)  # least: the k-th rank of a query, if it has so many

    def add(self, query: int, rank: float, id, n_hits: int) -> None:
        rows, rank = self.rows.setdefault(query, []), rounded(rank)
        insort(rows, (-rank, id is not None, id, n_hits))
        del rows[self.k :]
        if len(rows) == self.k:
            self.least[query] = -rows[-1][0]

    def batch(self, names: pa.Array, kinds: pa.Schema) -> pa.RecordBatch:
        """(name of the query, id, n_hits, rank) of all rows that are held."""
        held = [(query, *row) for query, rows in self.rows.items() for row in rows]
        query, rank, _, ids, n_hits = zip(*held) if held else [()] * 5
        columns = [names.take(pa.array(query, pa.int64())), pa.array(ids, kinds[1].type), pa.array(n_hits, pa.int64()), pa.array([-r for r in rank], pa.float64())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)


@dataclass(frozen=True)
class Asked:
    """A block of queries: their names, all of their words, and for each query its words (places of words from first on, in the order asked)."""

    names: pa.Array
    words: pa.Array
    word: np.ndarray
    first: np.ndarray
    rare: list[np.ndarray]  # each query's second and third rarest word, or its last one
    order: np.ndarray  # queries of more than one word by their rarest word, in order from upto on
    upto: np.ndarray
    alone: np.ndarray  # the query that asks for a word alone, or -1


def packed(names: pa.Array, lists: pa.Array) -> Asked:
    """A block of queries, each one with different words and at least one; no two ask for the same words in the same order."""
    size, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
    word, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), flat.dictionary
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    asked = np.bincount(word, minlength=len(words))
    rarest = word[np.lexsort((asked[word], np.repeat(np.arange(len(size)), size)))]
    nth = lambda n: rarest[first[:-1] + np.minimum(n, size - 1)]
    several, alone = np.flatnonzero(size > 1), np.full(len(words), -1, np.int64)
    alone[nth(0)[size == 1]] = np.flatnonzero(size == 1)
    order = several[np.argsort(nth(0)[several], kind="stable")]
    upto = np.searchsorted(nth(0)[order], np.arange(len(words) + 1))
    return Asked(names, words, word, first, [nth(1), nth(2)], order, upto, alone)


def _strips(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = -(-batch.num_rows // (1 + batch.nbytes // STRIP))
    for start in range(0, batch.num_rows, step or 1):
        yield batch.slice(start, step)


def search(shared, k: int, kinds: pa.Schema):
    """For mapInArrow over (id, words): rows of kinds (query, id, n_hits, rank), the k best of a task for each query of a block, a broadcast Asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        best, row = Best(k, len(asked.names)), -1
        seen, number = np.full(len(asked.words), -1), np.full(len(asked.words), -1)  # the last row that had a word; its number in the query at hand
        is_key = np.diff(asked.upto) > 0
        for strip in (s for batch in batches for s in _strips(batch)):
            ids, lists = strip.columns
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            said = pa.compute.index_in(lists.flatten(), value_set=asked.words).fill_null(-1).to_numpy(zero_copy_only=False)
            place = np.flatnonzero(said >= 0)  # in the strip
            said, begin, upto = said[place], np.concatenate([[0], ends[:-1]]).astype(np.int64), np.searchsorted(place, ends)
            for r, (a, b) in enumerate(zip([0, *upto[:-1].tolist()], upto.tolist())):
                if a == b:
                    continue
                row, here = row + 1, said[a:b]
                seen[here] = row
                single = here[asked.alone[here] >= 0]
                if len(single):
                    found, n = np.unique(single, return_counts=True)
                    hopeful = n * COVER + SLACK >= best.least[asked.alone[found]]
                    for w, hits in zip(found[hopeful].tolist(), n[hopeful].tolist()):
                        best.add(int(asked.alone[w]), hits * COVER, ids[r].as_py(), hits)
                keys = set(here[is_key[here]].tolist())
                if not keys:
                    continue
                met = np.concatenate([asked.order[asked.upto[x] : asked.upto[x + 1]] for x in keys])
                for column in asked.rare:
                    met = met[seen[column[met]] == row]
                for q in met.tolist():
                    w = asked.word[asked.first[q] : asked.first[q + 1]]
                    if not (seen[w] == row).all():
                        continue
                    number[w] = np.arange(len(w))
                    of = number[here]
                    hits = np.flatnonzero(of >= 0)
                    number[w] = -1
                    of = of[hits]
                    if most_covers(np.bincount(of)) * COVER + SLACK >= best.least[q]:
                        best.add(q, cover_rank(of.tolist(), (place[a + hits] - begin[r]).tolist(), len(w)), ids[r].as_py(), len(of))
        yield best.batch(asked.names, kinds)

    return run
