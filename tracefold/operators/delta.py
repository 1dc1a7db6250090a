"""Differences of integers within a batch, and their running sums.

A batch is one window: the state spans all of it. Bound batches first (see flatten.batched), as one
batch is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_WORD = (1 << 32) - 1


def _whole(high: Column, low: Column) -> Column:
    """high * 2 ** 32 + low as a long, modulo 2 ** 64: as messages have it, without an overflow."""
    carried = (high + F.shiftright(low, 32)).bitwiseAND(F.lit(_WORD))
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(_WORD)))


def delta(column: Column, batch: Sequence[Column | str], order: Sequence[Column | str]) -> Column:
    """The column less its last value that isn't null, modulo 2 ** 64; the first is absolute; nulls stay and don't count."""
    column, before = column.cast("long"), Window.partitionBy(*batch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(column, ignorenulls=True).over(before), F.lit(0).cast("long"))
    return _whole(F.shiftright(column, 32) - F.shiftright(last, 32), column.bitwiseAND(F.lit(_WORD)) - last.bitwiseAND(F.lit(_WORD)))


def undelta(column: Column, batch: Sequence[Column | str], order: Sequence[Column | str]) -> Column:
    """The inverse of delta. Words are summed apart, so that no sum overflows in a batch of less than 2 ** 31 rows."""
    column, upto = column.cast("long"), Window.partitionBy(*batch).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(column.isNotNull(), _whole(F.sum(F.shiftright(column, 32)).over(upto), F.sum(column.bitwiseAND(F.lit(_WORD))).over(upto)))


def encode(df: DataFrame, column: str, batch: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the differences of a column."""
    return df.withColumn(name, delta(F.col(column), batch, order))


def decode(df: DataFrame, column: str, batch: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the running sums of a column of differences."""
    return df.withColumn(name, undelta(F.col(column), batch, order))
