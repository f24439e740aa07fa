"""Values that run along the rows of a group (the row before, sums and maxima up to a row) where one group may be longer than a task should hold.

Groups of one piece, that is with places 0 to size - 1 only, get plain windows. The rows of longer groups are written apart and worked out in
two levels: windows within pieces of size places, then what each piece hands on (its last row or its total), run along the few rows that stand
for pieces, and joined back on. So a task holds one piece, or one row for each piece of a group; the result is that of the plain windows.

Null keys are a group like others. Rows without a place come first, in a piece of their own. Rows of equal place are in one piece, in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut

PIECE = 10_000
_NOWHERE = -(1 << 62)  # piece of rows without a place


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]


def _renamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"_key_{k}" for k in keys})


@dataclass(frozen=True)
class Along:
    """The way along groups: their key columns, the columns that order their rows, and whether rows are worked out by pieces (column _piece)."""

    key: list[str]
    order: list[str]
    pieces: bool

    def _window(self):
        return W.partitionBy(*self.key, *(["_piece"] if self.pieces else [])).orderBy(*self.order)

    def _handed_on(self, rows: DataFrame, total: Column, fold: Callable[[Column], Column], before: int) -> DataFrame:
        """rows with _from: fold of the totals of the pieces before a row's own, back to the first one or for so many."""
        pieces = rows.groupBy(*self.key, "_piece").agg(total.alias("_total"))
        upto = W.partitionBy(*self.key).orderBy("_piece").rowsBetween(before, -1)
        table = pieces.select(*self.key, "_piece", fold(F.col("_total")).over(upto).alias("_from"))
        keys = [*self.key, "_piece"]
        return rows.join(_renamed(table, keys), _same(keys), "left").drop(*(f"_key_{k}" for k in keys))

    def before(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """rows with the value of the row before; null for a group's first row."""
        held = F.struct(value.alias("v"))
        out = rows.withColumn(name, F.lag(held).over(self._window()))
        if self.pieces:
            out = self._handed_on(out, F.max_by(held, F.struct(*self.order)), F.last, -1).withColumn(name, F.coalesce(name, "_from")).drop("_from")
        return out.withColumn(name, F.col(name)["v"])

    def total(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """rows with the sum of a whole number, null being 0, over the rows up to each one."""
        value = F.coalesce(value.cast("long"), F.lit(0))
        out = rows.withColumn(name, F.sum(value).over(self._window()))
        return self._handed_on(out, F.sum(value), F.sum, W.unboundedPreceding).withColumn(name, F.col(name) + F.coalesce("_from", F.lit(0))).drop("_from") if self.pieces else out

    def most(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """rows with the largest value of the rows up to each one; null where all are null."""
        out = rows.withColumn(name, F.max(value).over(self._window()))
        return self._handed_on(out, F.max(value), F.max, W.unboundedPreceding).withColumn(name, F.greatest(name, "_from")).drop("_from") if self.pieces else out


def along(rows: DataFrame, key: str, order: list[str], run: Callable[[DataFrame, Along], DataFrame], size: int | None = None, place: str | None = None) -> DataFrame:
    """run(rows, Along) for short groups of rows and for long ones, united; place, the first order column unless given, is a number that doesn't fall along the order."""
    marked = rows.withColumn("_piece", F.coalesce(F.floor(F.col(place or order[0]) / (size or PIECE)), F.lit(_NOWHERE)))
    long = cut(_renamed(marked.where("_piece <> 0").select(key).distinct(), [key]))
    if long.isEmpty():
        return run(rows, Along([key], order, False))
    apart = cut(marked.join(long, _same([key]), "left_semi"))
    short = run(rows.join(long, _same([key]), "left_anti"), Along([key], order, False))
    return short.unionByName(run(apart, Along([key], order, True)).drop("_piece"))
