"""Quality scores by a generalised additive model with pairwise interactions.

Every document becomes a row of surface features (shares of letters, digits, symbols and
repeats; word and line lengths), computed once over its whole text and written to a table.
The model is fit on a bounded sample of labelled rows: TRAIN_ROWS rows, the lowest by
hash of doc_id. Features are cut into quantile bins; boosting then visits them in
cycles, each time fitting a shallow tree over one feature's bins to the gradient of the
log loss and adding it to that feature's table. The pairs of features that explain most
of what is left get two-dimensional tables in the same way. A score is the logistic of
the intercept plus one table entry per feature and pair, added for all rows at once.

Null and empty texts have zero features and a score like any other. Labels with a null
doc_id or value are left out. Without labels of both kinds the score is the share of good
labels, or one half without labels. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, lowest, spans, texts_of, written

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
CYCLES, PAIR_CYCLES, RATE, LEAVES, LEAST = 120, 60, 0.1, 3, 10.0

FEATURES = (
    "log_words", "word_length", "word_length_spread", "long_words", "upper", "digits", "symbols", "pipes", "bangs", "stops", "non_ascii", "line_words",
    "distinct_words", "same_as_last", "repeated_pairs", "repeated_fives", "top_word", "symbol_ends", "byte_entropy",
)


def _classes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER, _DIGITS, _SYMBOLS = _classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _classes("0123456789"), _classes("#*$%&|<>@^~+=\\_{}[]`/")
_STOPS = _classes(".,;:?")


def _distinct(x: np.ndarray) -> tuple[int, int]:
    """Number of distinct values, and the largest count."""
    if not len(x):
        return 0, 0
    s = np.sort(x)
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    return len(edge) - 1, int(np.diff(edge).max())


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    w = Words(texts)
    raw = np.frombuffer(w.data, dtype=np.uint8)
    out, begin = np.zeros((len(texts), len(FEATURES))), np.cumsum([0] + [len(t) + 1 for t in texts])
    lengths, ends = w.end - w.start, raw[w.end - 1] if len(w.end) else raw[:0]
    pairs, fives = grams(w.hash, 2), grams(w.hash, 5)
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        n = b - a
        if not n:
            continue
        counts = np.bincount(raw[begin[i] : begin[i + 1] - 1], minlength=256)
        size, h, length = counts.sum(), w.hash[a:b], lengths[a:b]
        share = counts[counts > 0] / size
        words, top = _distinct(h)
        two, five = n - 1, max(0, n - 4)
        out[i] = (
            np.log(n), length.mean(), length.std(), (length > 14).mean(), counts[_UPPER].sum() / size, counts[_DIGITS].sum() / size, counts[_SYMBOLS].sum() / size,
            counts[124] / n, counts[33] / n, counts[_STOPS].sum() / n, counts[128:].sum() / size, n / (counts[10] + 1), words / n, (h[1:] == h[:-1]).sum() / n,
            1 - _distinct(pairs[a : b - 1])[0] / two if two else 0, 1 - _distinct(fives[a : b - 4])[0] / five if five else 0, top / n, (_SYMBOLS | _classes("!"))[ends[a:b]].mean(), -(share * np.log2(share)).sum(),
        )
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch)
        for a, b in spans(texts):
            x = features(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc_id", *FEATURES])


@dataclass
class AdditiveModel:
    """Look-up tables: one for each feature's bins, one for each chosen pair's bins."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.pair_cuts)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step values over ordered bins with gradient sums g and curvature sums h: up to LEAVES leaves, cut greedily."""
    edges = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(edges) <= LEAVES:
        best = (1e-9, 0)
        for a, b in zip(edges[:-1], edges[1:]):
            for c in range(a + 1, b):
                if min(ch[c] - ch[a], ch[b] - ch[c]) * 4 >= LEAST:
                    best = max(best, (value(a, c) + value(c, b) - value(a, b), c))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _corners(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Best gain of one cut on each axis of a two-dimensional grid of sums, and the cuts."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quadrants(c: np.ndarray) -> list[np.ndarray]:
        q = c[:-1, :-1]
        right, below = c[:-1, -1:] - q, c[-1:, :-1] - q
        return [q, right, below, c[-1, -1] - q - right - below]

    gain = sum(a**2 / (b + 1.0) for a, b in zip(quadrants(cg), quadrants(ch))) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
    k = int(gain.argmax())
    return float(gain.flat[k]), k // gain.shape[1] + 1, k % gain.shape[1] + 1


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    n = len(y)
    mean = y.mean() if n else 0.5
    if n == 0 or mean in (0.0, 1.0):
        return AdditiveModel(float(np.log((mean * n + 0.5) / (n - mean * n + 0.5))))
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    quantiles = lambda k, m: np.unique(np.quantile(x[:, k], np.linspace(0, 1, m + 1)[1:-1]))
    model.cuts = [quantiles(k, BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for k, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size))
            model.tables[k] += step
            total += step[b]
    model.pair_cuts = [quantiles(k, PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    wide = [k for k in range(x.shape[1]) if sizes[k] > 1]
    gains = sorted(((_corners(grid(i, j, g), grid(i, j, h))[0], i, j) for a, i in enumerate(wide) for j in wide[a + 1 :]), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_CYCLES):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            gg, hh = grid(i, j, g), grid(i, j, h)
            _, r, c = _corners(gg, hh)
            for a in (slice(0, r), slice(r, None)):
                for b in (slice(0, c), slice(c, None)):
                    if 4 * hh[a, b].sum() >= LEAST:
                        table[a, b] += RATE * gg[a, b].sum() / (hh[a, b].sum() + 1.0)
            total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[coarse[p], coarse[q]] for (p, q), t in zip(model.pairs, model.pair_tables))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score) for every row of docs (doc_id, text); held_out rows teach nothing. labels: doc_id, quality."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table = written(rows.mapInArrow(_features, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES)).withColumn("held_out", held_out))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    known = table.where("not held_out").join(marks, "doc_id")
    known = lowest(known.withColumn("_hash", F.xxhash64("doc_id")), TRAIN_ROWS).orderBy("_hash", "doc_id", *FEATURES).limit(TRAIN_ROWS).toPandas()
    model = fit(known[list(FEATURES)].to_numpy(float), (known["_quality"].to_numpy() > 0).astype(float))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["score"] = shared.value.score(f[list(FEATURES)].to_numpy(float))
            yield f[["doc_id", "held_out", "score"]]

    return table.mapInPandas(score, f"doc_id {kind}, held_out boolean, score double")
