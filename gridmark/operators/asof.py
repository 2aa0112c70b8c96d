"""Joins by time: as-of backward, forward and nearest, intervals, interpolation, and the regular grid.

An as-of join unions both sides and carries the last row of the right side forward in one window, so each side is shuffled once by its
keys and a row meets no more than one other.  One that looks ahead runs the same window backwards: a frame up to the current row grows by a row at a time, while
one that reaches to the group's end is read anew for each row.  Rows with a null time match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_first: bool, right_order: list[str], columns: dict[str, str]) -> DataFrame:
    r = right.where(F.col(right_time).isNotNull())
    order = F.struct(*[F.col(c) for c in right_order]) if right_order else F.struct(F.lit(0).alias("none"))
    b = r.select(*keys, F.col(right_time).alias("_t"), F.lit(0 if right_first else 2).alias("_side"), order.alias("_o"), F.struct(*columns).alias("_r"))
    row = F.struct(*left.columns)
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_l"))
    return a.unionByName(b, allowMissingColumns=True)


def _taken(merged: DataFrame, left: DataFrame, keys: list[str], pick: Column, columns: dict[str, str]) -> DataFrame:
    got = merged.withColumn("_got", pick).where("_side = 1")
    own = [F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in left.columns]  # keys of the window itself, so that later windows need no further shuffle
    return got.select(*own, *[F.col(f"_got.{c}").alias(name) for c, name in columns.items()])


def _so_far(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from_here(keys: list[str]) -> WindowSpec:
    """The rows from the current one on, as a frame that grows: the last of them is the next.  Null times come first, before any row that could match."""
    return Window.partitionBy(*keys).orderBy(F.desc_nulls_first("_t"), F.desc("_side"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: dict[str, str], *, inclusive: bool = True, most_age: int | None = None, right_order: list[str] | None = None) -> DataFrame:
    """Each left row with ``columns`` of the latest right row at or before it (before it, if not inclusive), at most ``most_age`` old."""
    m = _merged(left, right, keys, left_time, right_time, inclusive, right_order or [], columns)
    pick = F.last(F.when(F.col("_r").isNotNull(), F.struct("_r", "_t")), ignorenulls=True).over(_so_far(keys))
    if most_age is not None:
        m = m.withColumn("_pick", pick)
        return _taken(m, left, keys, F.when(F.col("_t") - F.col("_pick._t") <= most_age, F.col("_pick._r")), columns)
    return _taken(m, left, keys, pick["_r"], columns)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: dict[str, str], *, strict: bool = False, right_order: list[str] | None = None) -> DataFrame:
    """Each left row with ``columns`` of the first right row at or after it (after it, if strict)."""
    m = _merged(left, right, keys, left_time, right_time, strict, right_order or [], columns)
    return _taken(m, left, keys, F.last("_r", ignorenulls=True).over(_from_here(keys)), columns)


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: dict[str, str], *, tolerance: int, right_order: list[str] | None = None) -> DataFrame:
    """Each left row with ``columns`` of the nearest right row within ``tolerance``; at equal gaps the earlier one."""
    m = _merged(left, right, keys, left_time, right_time, True, right_order or [], columns)
    seen = F.when(F.col("_r").isNotNull(), F.struct("_r", "_t"))
    m = m.withColumns({
        "_before": F.last(seen, ignorenulls=True).over(_so_far(keys)),
        "_after": F.last(seen, ignorenulls=True).over(_from_here(keys)),
    })
    back, ahead = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    near = F.when(back.isNotNull() & (back <= tolerance) & (ahead.isNull() | (back <= ahead)), F.col("_before._r")).when(ahead <= tolerance, F.col("_after._r"))
    return _taken(m, left, keys, near, columns)


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, width: int, *, closed: str = "right") -> DataFrame:
    """Points with every interval of equal keys that holds them.

    Both sides are cut into cells of ``width``, so a key's rows meet only in the cells that an interval spans.  ``closed``: which end belongs
    to an interval, ``left``, ``right`` or ``both``.
    """
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_cell", F.floor(F.col(time) / width))
    t = F.col(time)
    inside = {"right": (t > F.col(start)) & (t <= F.col(end)), "left": (t >= F.col(start)) & (t < F.col(end)), "both": t.between(F.col(start), F.col(end))}[closed]
    return p.join(cells, [*keys, "_cell"]).where(inside).drop("_cell")


def interpolated(points: DataFrame, at: DataFrame, keys: list[str], time: str, at_time: str, values: list[str], *, most_gap: int | None = None) -> DataFrame:
    """``at`` with ``values`` on the straight line between the points around each time; null outside, or over a gap of more than ``most_gap``."""
    w = Window.partitionBy(*keys).orderBy(time)
    lines = points.select(*keys, F.col(time).alias("_t0"), F.lead(time).over(w).alias("_t1"), *[F.col(v).alias(f"_a_{v}") for v in values], *[F.lead(v).over(w).alias(f"_b_{v}") for v in values])
    got = asof_backward(at, lines, keys, at_time, "_t0", {c: c for c in lines.columns if c not in keys})
    t, whole = F.col(at_time) - F.col("_t0"), F.col("_t1") - F.col("_t0")
    usable = F.col("_t1").isNotNull() & (F.lit(True) if most_gap is None else whole <= most_gap)
    line = {v: F.when(t == 0, F.col(f"_a_{v}")).when(usable, F.col(f"_a_{v}") + (F.col(f"_b_{v}") - F.col(f"_a_{v}")) * t / whole) for v in values}
    return got.select(*at.columns, *[e.alias(v) for v, e in line.items()])


def grid(frames: DataFrame, keys: list[str], time: str, step: int) -> DataFrame:
    """(keys, k, tick): a tick for every multiple of ``step`` from a group's first row to its last."""
    span = frames.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    first, last = F.ceil(F.col("a") / step).cast("long"), F.floor(F.col("b") / step).cast("long")
    k = F.explode(F.when(first <= last, F.sequence(first, last)))
    return span.select(*keys, k.alias("k")).withColumn("tick", F.col("k") * step)


def resampled(frames: DataFrame, keys: list[str], time: str, step: int, columns: dict[str, str], most_age: int, order: list[str] | None = None) -> DataFrame:
    """The grid with ``columns`` of the latest frame at or before each tick; ticks whose frame is older than ``most_age`` have nulls."""
    return asof_backward(grid(frames, keys, time, step), frames, keys, "tick", time, columns, most_age=most_age, right_order=order)
