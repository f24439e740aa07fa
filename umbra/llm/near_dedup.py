"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation gives two signature values, its minimum and its maximum over the
document's five-word shingles, so 36 hash evaluations a shingle make 72 values:
24 bands of three.  Two documents of similarity 0.75 miss all bands with a chance
of two in a million.

1. One pass sketches every document.  Equal shingle sets are one class from here on,
   gathered with map-side aggregation: a group of copies, however large, is one row.
2. Classes that share a band and agree in half of their signature are tied.  Ties are
   found inside a task over blocks of bounded size and leave it as a spanning forest,
   so no list of pairs is ever written.
3. The components of the ties are candidate families.  Families are compared on their
   full sets, in block pairs of bounded size: a product of 0/1 matrices counts all
   intersections of a block pair exactly.  Links leave as a spanning forest again.
4. Their components are the answer.

Buckets and families of several blocks are compared in two turns: all blocks with the first
one, then only the members that are not in the main component by then, with all blocks.
Pairs inside one component need no comparison, so no link is lost, and a family of n near
copies of one text costs n rows, not n * n / 1024.

Sets are held as 64-bit hashes; two different shingles of a compared pair collide with
a chance of about 1e-15.

Null or wordless texts have an empty set and are linked with nothing.  Rows with a null
doc_id are returned, not linked, with a null component, and kept.  Rows that repeat a
doc_id are one node.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, fixed_binary, gathered, list_array, mix, shingle_sets, small_or_shuffled, spans, texts_of, tidy, written
from .components import components

PERMUTATIONS, ROWS = 36, 3
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK = 1024  # classes of one block
BLOCK_SHINGLES = 400_000
FAMILY_ROWS = 2_000_000  # members of families up to this count are broadcast (16 bytes each); beyond, texts are shuffled
GROUP_ROWS = 1_000_000  # large groups with several components up to this count are broadcast (24 bytes each)
FOUND_ROWS = 200_000  # nodes with their components, or buckets with their sizes, up to this count are broadcast (16 bytes each)
NAMED_ROWS = 100_000  # classes with their components up to this count are broadcast (32 bytes each)
TASK_ROWS = 5_000  # rows of small groups that share a task

_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_BAND_KEYS = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x 72) minima and maxima under each permutation; texts must not be empty sets."""
    begin, out = offsets[:-1], np.empty((len(offsets) - 1, 2 * PERMUTATIONS), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        x = values * _A[p] + _B[p]
        x ^= x >> np.uint64(31)
        out[:, 2 * p] = np.minimum.reduceat(x, begin)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, begin)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = texts_of(batch, lower=True), batch.column("doc_id")
        for a, b in spans(texts):
            values, offsets = shingle_sets(Words(texts[a:b]))
            sizes = np.diff(offsets)
            full = sizes > 0
            n = b - a
            low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig = np.zeros((n, 2 * PERMUTATIONS), np.uint64)
            if full.any():
                begin = offsets[:-1][full]
                low[full] = np.add.reduceat(mix(values), begin)
                high[full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                sig[full] = signatures(values, np.append(begin, offsets[-1]))
            bands = mix((sig.reshape(n, BANDS, ROWS) * _BAND_KEYS).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, n), pa.array(sizes.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), fixed_binary((sig >> np.uint64(48)).astype(np.uint16)), list_array(bands.view(np.int64).ravel(), np.arange(n + 1) * BANDS, pa.int64())],
                names=["doc_id", "n_shingles", "low", "high", "sig", "bands"],
            )


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (child, root) of a spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(near), dtype=bool)
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        front = near[root] & left
        while front.any():
            left &= ~front
            found = np.flatnonzero(front)
            yield from ((int(x), root) for x in found)
            front = near[found].any(axis=0) & left


def _tie(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["bucket", "node"])
    node = pdf["node"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), -1)
    cut = np.flatnonzero(np.diff(pdf["bucket"].to_numpy())) + 1
    us, vs = [], []
    half = PERMUTATIONS
    for a, b in zip([0, *cut], [*cut, len(pdf)]):
        if b - a == 2:
            if (sig[a] == sig[a + 1]).sum() >= half:
                us.append(node[a])
                vs.append(node[a + 1])
            continue
        near = np.empty((b - a, b - a), dtype=bool)
        for i in range(a, b, 32):
            near[i - a : i - a + 32] = (sig[i : min(i + 32, b), None, :] == sig[None, a:b, :]).sum(axis=2, dtype=np.int16) >= half
        for x, y in _forest(near):
            us.append(node[a + x])
            vs.append(node[a + y])
    return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over column strips."""
    n = len(sets)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column, width = row[keep], place[column[keep]], int(shared.sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, strip = np.zeros((n, n), np.float32), max(1, 4_000_000 // n)
    for c in range(0, width, strip):
        a, b = np.searchsorted(column, [c, c + strip])
        m = np.zeros((n, min(strip, width - c)), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        out += m @ m.T
    return out


def _link(percent: int):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for _, g in pdf.groupby("family", sort=False):
            node = g["node"].to_numpy()
            sets = [np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            both = intersections(sets)
            near = np.empty(both.shape, dtype=bool)
            for i in range(0, len(sets), 64):
                some = both[i : i + 64].astype(np.int64)
                near[i : i + 64] = 100 * some >= percent * (size[i : i + 64, None] + size[None, :] - some)
            for x, y in _forest(near):
                us.append(node[x])
                vs.append(node[y])
        return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return link


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch, lower=True)
        for a, b in spans(texts):
            values, offsets = shingle_sets(Words(texts[a:b]))
            blobs = [values[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("family"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(blobs, type=pa.binary())], names=["node", "family", "n", "shingles"])


def _task(group: Column, i: Column, j: Column) -> Column:
    return F.struct(group.cast("long").alias("g"), i.cast("long").alias("i"), j.cast("long").alias("j"))


def _numbers(n: Column, first: int = 0) -> Column:
    return F.explode(F.sequence(F.lit(first).cast("long"), n.cast("long") - 1))


def first_turn(small: DataFrame, large: DataFrame, group: str, tasks: int) -> DataFrame:
    """Adds column task: small groups share tasks; of a group of several blocks each block meets the first one.

    The rows of large groups have columns blocks (of its group) and node; no task gets more than two blocks of a group.
    """
    small = small.withColumn("task", _task(F.pmod(F.xxhash64(group), F.lit(max(1, tasks))), F.lit(-1), F.lit(-1)))
    large = large.withColumn("_b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    leaders = large.where("_b = 0").withColumn("_o", _numbers(F.col("blocks"), 1))
    others = large.where("_b > 0").withColumn("_o", F.col("_b"))
    large = leaders.unionByName(others).withColumn("task", _task(F.col(group), F.lit(0), F.col("_o"))).drop("_b", "_o")
    return small.unionByName(large)


def second_turn(large: DataFrame, group: str, found: DataFrame, rows: int) -> DataFrame | None:
    """Adds column task: the members of large groups outside of their group's main component meet all of the group's.

    found: (node, component) after the first turn. Groups of one component give no rows; None if all are.
    """
    found = small_or_shuffled(found, FOUND_ROWS)
    part = F.coalesce("component", "node")
    sizes = gathered(large.select(group, "node").distinct(), rows, TASK_ROWS).join(found, "node", "left").withColumn("part", part).groupBy(group, "part").agg(F.count("*").alias("n"))
    main = gathered(sizes, rows, TASK_ROWS).groupBy(group).agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    main = written(gathered(main.withColumn("rests", F.ceil(F.col("rest") / BLOCK)), rows, TASK_ROWS))
    if main.isEmpty():
        return None
    open_rows = large.join(small_or_shuffled(main.drop("rest"), GROUP_ROWS), group).join(found, "node", "left").withColumn("out", part != F.col("main")).drop("component", "main")
    every = open_rows.withColumn("_i", _numbers(F.col("rests"))).withColumn("_j", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rest = open_rows.where("out").withColumn("_i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests"))).withColumn("_j", _numbers(F.col("blocks")))
    return every.unionByName(rest).withColumn("task", _task(F.col(group), F.col("_i"), F.col("_j"))).drop("rests", "out", "_i", "_j")


def linked(rows: DataFrame, group: str, large: bool, tasks: int, link: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(node, component) by the links that a function finds among rows (node, blocks, ...) of equal group; large: some have several blocks."""
    about = tasks * TASK_ROWS

    def links(dealt: DataFrame) -> DataFrame:
        return gathered(dealt.groupBy("task").applyInPandas(link, "u long, v long"), about, TASK_ROWS // 4)

    small, many = rows.where("blocks <= 1"), rows.where("blocks > 1")
    if large:
        many = written(many)
    found = components(links(first_turn(small, many, group, tasks)), about)
    if not large:
        return found
    found = written(found)
    more = second_turn(many, group, found, about)
    if more is None:
        return found
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links(more)), about)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): see the module's text. docs: doc_id long, text string."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(docs.mapInArrow(tidy(_sketch), "doc_id long, n_shingles long, low long, high long, sig binary, bands array<long>"))
    known = sketch.where("doc_id is not null and n_shingles > 0")
    n = known.count()
    classes = known.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    classes = written(gathered(classes, n, TASK_ROWS))

    banded = classes.select("node", F.explode("bands").alias("bucket"))
    full = written(gathered(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), BANDS * n, 10 * TASK_ROWS))
    buckets, rows, most = full.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if buckets <= FOUND_ROWS:
        met = classes.select("node", F.explode("bands").alias("bucket"), "sig").join(F.broadcast(full), "bucket")
    else:
        met = banded.join(full, "bucket").join(classes.select("node", "sig"), "node")
    met = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).select("node", "bucket", "sig", "blocks")
    families = linked(met, "bucket", most > BLOCK, rows // TASK_ROWS + 1, _tie).select("node", F.col("component").alias("family"))
    families = written(gathered(families, rows, TASK_ROWS))
    members = families.count()

    sized = docs.join(small_or_shuffled(families, FAMILY_ROWS), F.col("doc_id") == F.col("node")).select("node", "family", "text").mapInArrow(tidy(_sets), "node long, family long, n long, shingles binary")
    sized = written(gathered(sized.dropDuplicates(["node", "n", "shingles"]), members, TASK_ROWS // 10))
    total = written(gathered(sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")), members, TASK_ROWS))
    same = linked(sized.join(small_or_shuffled(total, FOUND_ROWS), "family"), "family", not total.where("blocks > 1").isEmpty(), members * BANDS // TASK_ROWS + 1, _link(percent))

    # Only classes of several copies or with links need a look-up; all others stand for themselves.
    named = classes.join(small_or_shuffled(same, FOUND_ROWS), "node", "left").where("copies > 1 or component is not null")
    named = written(named.select("n_shingles", "low", "high", F.coalesce("component", "node").alias("component")))
    out = sketch.select("doc_id", "n_shingles", "low", "high").join(small_or_shuffled(named, NAMED_ROWS), ["n_shingles", "low", "high"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
