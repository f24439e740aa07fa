"""Placement of rows by a hierarchical weighted hash tree, in DataFrame functions only.

Shards are leaves of a tree of regions, racks and shards. A row descends level by level:
every child of the node it stands at draws ln(u) / weight, u being a hash of the row's id,
the level and the child's place among its siblings, and the largest draw wins. A child's weight is the weight of the
leaves below it, so every leaf gets its share, and a change of weights moves rows only
into or out of the subtrees whose weights change. A shard that is added as a region of
its own changes no other subtree: it takes rows and no other row moves. (A shard added
inside an existing region also lets rows that come into that region settle on its
neighbours.)

Hashes are md5 digests, which any SQL engine can repeat.

Slots number the rows of a shard without gaps. Rows are numbered within 4096 hash parts
of each shard; the parts' offsets come from a table of shards x parts counts, so no task
sees a whole shard.

The law is `key`: id and number of shards decide. A null id is hashed as the empty text.
Rows repeated in full are told apart arbitrarily, all other slots are fixed. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Leaves 0 to shards - 1 in regions of equal racks."""
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def grown(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own."""
    return [*leaves, Leaf(1 + max(x.region for x in leaves), 1 + max(x.rack for x in leaves), 1 + max(x.shard for x in leaves), weight)]


def placed(rows: DataFrame, key: str, leaves: Sequence[Leaf], name: str) -> DataFrame:
    """rows with the shard of each row, by its text column key, as int column name."""

    def best(below: Sequence[Leaf], field: str) -> Column:
        weights: dict[int, float] = {}
        for x in below:
            weights[getattr(x, field)] = weights.get(getattr(x, field), 0) + x.weight
        if len(weights) == 1:
            return F.lit(next(iter(weights)))
        draws = [F.struct(draw(key, field, k, w).alias("d"), F.lit(c).alias("c")) for k, (c, w) in enumerate(sorted(weights.items()))]
        return F.array_max(F.array(*draws))["c"]

    def within(parent: str, field: str) -> Column:
        nodes = sorted({getattr(x, parent) for x in leaves})
        return F.coalesce(*(F.when(F.col(f"_{parent}") == n, best([x for x in leaves if getattr(x, parent) == n], field)) for n in nodes))

    most = {"region": len({x.region for x in leaves}), "rack": len({x.rack for x in leaves}), "shard": max(sum(y.rack == x.rack for y in leaves) for x in leaves)}
    digests = {f"_{field}_{k}": F.md5(F.concat(F.col(key), F.lit(f":{field}:{k}")).cast("binary")) for field, n in most.items() for k in range((n + 3) // 4)}
    rows = rows.withColumns(digests)
    rows = rows.withColumn("_region", best(leaves, "region"))
    rows = rows.withColumn("_rack", within("region", "rack"))
    return rows.withColumn(name, within("rack", "shard").cast("int")).drop("_region", "_rack", *digests)


def draw(key: str, field: str, child: int, weight: float) -> Column:
    """ln(u) / weight; u in (0, 1) from eight hex digits of the row's digest for this level: four children share a digest."""
    digits = F.substring(f"_{field}_{child // 4}", 1 + 8 * (child % 4), 8)
    return F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0) / float(weight)


def shard_rows(docs: DataFrame, leaves: Sequence[Leaf], more: Sequence[Leaf]) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), key.alias("_key"))
    rows = placed(placed(rows, "_key", leaves, "shard"), "_key", more, "grown_shard")
    part = (F.conv(F.substring(F.md5(F.concat_ws(":", "_key", "size", "text_crc32").cast("binary")), 25, 8), 16, 10).cast("long") % PARTS).cast("int")
    rows = rows.withColumn("_part", part).drop("_key")
    sizes = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))  # at most shards x 4096 rows
    before = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "_part", before.alias("_start"))
    own = F.row_number().over(W.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32"))
    out = rows.withColumn("_own", own).join(F.broadcast(starts), ["shard", "_part"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_own") - 1).cast("long").alias("slot"), "grown_shard")
