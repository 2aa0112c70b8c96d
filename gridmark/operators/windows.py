"""Ordered operators inside a group: segments, runs, fills, causal velocities and trailing windows.

Frames of features end at the current row, so a value never depends on a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def filled(value: Column, w: WindowSpec) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(so_far(w))


def with_segments(df: DataFrame, keys: list[str], order: list[str], breaks: Column, into: str = "seg") -> DataFrame:
    """Numbers the stretches that begin where ``breaks`` is true (as the group's first row always does), from 1."""
    w = ordered(keys, *order)
    starts = F.when(F.row_number().over(w) == 1, 1).when(breaks, 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn(into, F.sum("_starts").over(so_far(w))).drop("_starts")


def gap_segments(df: DataFrame, keys: list[str], time: str, most_gap: int, into: str = "seg", tie: tuple[str, ...] = ()) -> DataFrame:
    """Segments that end at a gap of more than ``most_gap``."""
    return with_segments(df, keys, [time, *tie], F.col(time) - F.lag(time).over(ordered(keys, time, *tie)) > most_gap, into)


def with_runs(df: DataFrame, keys: list[str], order: list[str], value: str, into: str = "run") -> DataFrame:
    """Numbers the runs of an unchanged value; null is a value."""
    return with_segments(df, keys, order, ~F.col(value).eqNullSafe(F.lag(value).over(ordered(keys, *order))), into)


def time_since(mark: Column, time: Column, w: WindowSpec) -> Column:
    """Time since ``mark`` last held; null before it first does."""
    return time - filled(F.when(mark, time), w)


def causal_velocity(df: DataFrame, keys: list[str], time: str, values: list[str], steps: int, seg: str = "seg") -> DataFrame:
    """``v<value>`` per second from the row ``steps`` rows back in the segment, or its first row; null on that first row.  Times are micros."""
    w = Window.partitionBy(*keys, seg).orderBy(time)
    t0 = F.coalesce(F.lag(time, steps).over(w), F.first(time).over(so_far(w)))
    out = {f"v{v}": F.try_divide(F.col(v) - F.coalesce(F.lag(v, steps).over(w), F.first(v).over(so_far(w))), (F.col(time) - t0) / 1e6) for v in values}
    return df.withColumns(out)


def held(value: Column, fresh: Column, time: Column, w: WindowSpec, most_age: int) -> tuple[Column, Column]:
    """The last fresh value at most ``most_age`` old, and its age."""
    last = filled(F.when(fresh, F.struct(value.alias("v"), time.alias("t"))), w)
    young = time - last["t"] <= most_age
    return F.when(young, last["v"]), F.when(young, time - last["t"])


def rolling_count(flag: Column, w: WindowSpec, rows: int) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(-(rows - 1), 0))


def rolling(value: Column, how: str, w: WindowSpec, rows: int) -> Column:
    """max, min, avg or sum of the last rows, nulls left out."""
    return getattr(F, how)(value).over(w.rowsBetween(-(rows - 1), 0))


def trailing(how: Column, keys: list[str], time: str, back: int, until: int = 0) -> Column:
    """An aggregate over the rows from ``back`` before a row's time to ``until`` after it (negative: before)."""
    return how.over(Window.partitionBy(*keys).orderBy(time).rangeBetween(-back, until))


def changes(value: str, keys: list[str], order: list[str], df: DataFrame) -> DataFrame:
    """(keys, changes): how often a value changes, nulls carried over; the first value is no change."""
    w = ordered(keys, *order)
    carried = df.withColumn("_v", filled(F.col(value), w))
    before = F.lag("_v").over(w)
    return carried.withColumn("_c", before.isNotNull() & (F.col("_v") != before)).groupBy(*keys).agg(F.count_if("_c").alias("changes"))


def time_shares(df: DataFrame, keys: list[str], time: str, value: str, kinds: list[str], window: int, most_hold: int, seg: str = "seg") -> DataFrame:
    """For each kind ``share_<kind>``: of the time from max(segment start, t - window) to t, how much rows of that value hold.

    A row holds until the next one of its segment, ``most_hold`` at most.  The integral so far is a running sum, so the share is a difference of
    two sums: at t, and at t - window, where the last row before is continued.
    """
    w = Window.partitionBy(*keys, seg).orderBy(time)
    t = F.col(time)
    gap = F.least(F.lead(time).over(w) - t, F.lit(most_hold))
    rows = df.withColumn("_hold", F.coalesce(gap, F.lit(0))).withColumn("_start", F.first(time).over(so_far(w)))
    rows = rows.withColumns({f"_sum_{k}": F.coalesce(F.sum(F.when(F.col(value) == k, F.col("_hold")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k in kinds})
    past = w.rangeBetween(Window.unboundedPreceding, -window)
    edge = t - window
    out = {}
    for k in kinds:
        then = F.last(F.struct(F.col(f"_sum_{k}").alias("s"), t.alias("t"), F.col(value).alias("v"), F.col("_hold").alias("h"))).over(past)
        at_edge = F.coalesce(then["s"] + F.when(then["v"] == k, F.least(edge - then["t"], then["h"])).otherwise(0), F.lit(0))
        out[f"share_{k}"] = F.try_divide(F.col(f"_sum_{k}") - at_edge, F.least(t - F.col("_start"), F.lit(window)))
    return rows.withColumns(out).drop("_hold", "_start", *[f"_sum_{k}" for k in kinds])
