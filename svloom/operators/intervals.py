"""Intervals: gaps and islands, overlap joins, band joins. Half-open [start, end) throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Positions of one island window. Distinct starts in it bound a task's rows, however many events share a start.
ISLAND_BIN = 1 << 20


def islands(df: DataFrame, keys: list[str], start: str, end: str, distance: int, names: tuple[str, str] = ("island_start", "island_end"), bin_size: int = ISLAND_BIN) -> DataFrame:
    """Adds the range of each row's gap cluster: a new one begins where start exceeds the largest end so far by more than ``distance``.

    Rows with a null key or start have no place and go. A key as hot as one chromosome does not end up in one task: rows shrink to one per key and start, windows run inside bins of
    positions, and what crosses bins (largest end, open cluster) comes from one summary row per bin."""
    first, last = names
    spot = [*keys, start]
    df = df.dropna(subset=spot)
    points = df.groupBy(*spot).agg(F.max(end).alias("__e")).withColumn("__bin", F.floor(F.col(start) / bin_size))
    bins = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = points.groupBy(*keys, "__bin").agg(F.max("__e").alias("__m")).withColumn("__carry", F.max("__m").over(bins)).drop("__m")
    inside = Window.partitionBy(*keys, "__bin").orderBy(start)
    so_far = F.greatest(F.col("__carry"), F.max("__e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    gap = so_far.isNull() | ((F.col(start) > so_far) & (F.col(start) - so_far > distance))
    # a row for each start, staged: it is read four times below
    flagged = staged(points.join(reach, [*keys, "__bin"]).withColumn("__open", F.when(gap, F.col(start))).drop("__carry"))
    opened = flagged.groupBy(*keys, "__bin").agg(F.max("__open").alias("__o")).withColumn("__before", F.max("__o").over(bins)).drop("__o")
    within = F.max("__open").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = flagged.join(opened, [*keys, "__bin"]).withColumn(first, F.coalesce(within, F.col("__before")))
    ends = placed.groupBy(*keys, first).agg(F.max("__e").alias(last))
    return df.join(placed.join(ends, [*keys, first]).select(*spot, first, last), spot)


def islands_within(df: DataFrame, keys: list[str], start: str, end: str, distance: int, names: tuple[str, str]) -> DataFrame:
    """The same for keys that already are small groups: plain windows over one exchange. Windows stream and spill; ties do not matter."""
    first, last = names
    order = Window.partitionBy(*keys).orderBy(start)
    so_far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = so_far.isNull() | ((F.col(start) > so_far) & (F.col(start) - so_far > distance))
    out = df.withColumn("__open", F.when(gap, F.col(start)))
    out = out.withColumn(first, F.max("__open").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")
    return out.withColumn(last, F.max(end).over(Window.partitionBy(*keys, first)))


def island_ranges(df: DataFrame, keys: list[str], start: str, end: str, distance: int, bin_size: int = ISLAND_BIN) -> DataFrame:
    """The clusters themselves: keys, island_start, island_end, n (rows)."""
    return islands(df, keys, start, end, distance, bin_size=bin_size).groupBy(*keys, "island_start", "island_end").agg(F.count("*").alias("n"))


def bins_of(start: Column, end: Column, size: int) -> Column:
    """All bins that [start, end) touches, one at least."""
    return F.sequence(F.floor(start / size), F.greatest(F.floor((end - 1) / size), F.floor(start / size)))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int = 4096, how: str = "inner", row_key: list[str] | None = None) -> DataFrame:
    """Rows of left and right with equal keys and overlapping ranges; column names must differ but for the keys.

    Both sides are dealt by key and bin; a pair that shares several bins is kept in the first only, so nothing needs a distinct.
    ``how``: inner, left_semi, left_anti; the last two need ``row_key``, columns that tell left rows apart. bin_size should be near the
    usual length."""
    ls, le, rs, re_ = (F.col(c) for c in (*left_range, *right_range))
    a = left.withColumn("__bin", F.explode(bins_of(ls, le, bin_size)))
    b = right.withColumn("__bin", F.explode(bins_of(rs, re_, bin_size)))
    meets = (ls < re_) & (rs < le) & (F.col("__bin") == F.greatest(F.floor(ls / bin_size), F.floor(rs / bin_size)))
    if how == "inner":
        return a.join(b, [*keys, "__bin"]).where(meets).drop("__bin")
    some = a.join(b, [*keys, "__bin"]).where(meets).select(*row_key).distinct()
    return left.join(some, row_key, how)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], bands: list[tuple[str, str, int]]) -> DataFrame:
    """Rows with equal keys and right position in [left - r, left + r) for each (left column, right column, r).

    The first band makes an equi-join of it: left positions go to their own and the neighbouring bins."""
    x, y, r = bands[0]
    size = max(1, r)
    a = left.withColumn("__bin", F.explode(F.sequence(F.floor((F.col(x) - r) / size), F.floor((F.col(x) + r) / size))))
    b = right.withColumn("__bin", F.floor(F.col(y) / size))
    out = a.join(b, [*keys, "__bin"]).drop("__bin")
    for x, y, r in bands:
        out = out.where((F.col(y) >= F.greatest(F.col(x) - r, F.lit(0))) & (F.col(y) < F.col(x) + r))
    return out
