"""Look-ahead labels.  This is the only module whose windows reach past the current row for the sake of a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_events(events: DataFrame, kind: Column) -> DataFrame:
    """The rows that have a ``kind`` (set_play, shot, goal)."""
    return events.withColumn("kind", kind).where("kind IS NOT NULL")


def counts_ahead(rows: DataFrame, events: DataFrame, keys: list[str], row_time: str, event_time: str, kinds: list[str], horizons: dict[str, int]) -> DataFrame:
    """``rows`` with ``n_<kind>_<horizon>``: events of a kind in (t, t + horizon] with equal keys.

    Rows and events are unioned and counted in one window, so no row is paired with an event.
    """
    e = events.select(*keys, F.col(event_time).alias("_t"), F.col("kind").alias("_kind"))
    r = rows.select(*keys, F.col(row_time).alias("_t"), F.struct(*rows.columns).alias("_row"))
    both = r.unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t")
    counts = {f"n_{k}_{name}": F.coalesce(F.sum(F.when(F.col("_kind") == k, 1).otherwise(0)).over(w.rangeBetween(1, h)), F.lit(0)) for k in kinds for name, h in horizons.items()}
    return both.withColumns(counts).where("_row IS NOT NULL").select("_row.*", *counts)


def grid_labels(rows: DataFrame, events: DataFrame, keys: list[str], row_time: str, event_time: str, eligible: Column, horizons: dict[str, int], set_play_phase: Column | None = None) -> DataFrame:
    """``label_mask_h``, ``label_shot_h`` and ``label_goal_h`` for each horizon; labels are null where masked."""
    counted = counts_ahead(rows, events, keys, row_time, event_time, ["shot", "goal", "set_play"], horizons)
    free = ~F.coalesce(set_play_phase, F.lit(False)) if set_play_phase is not None else F.lit(True)
    out = {}
    for h in horizons:
        mask = F.coalesce(eligible, F.lit(False)) & free & (F.col(f"n_set_play_{h}") == 0)
        out[f"label_mask_{h}"] = mask
        out |= {f"label_{k}_{h}": F.when(mask, F.col(f"n_{k}_{h}") > 0) for k in ("shot", "goal")}
    return counted.withColumns(out).drop(*[f"n_{k}_{h}" for k in ("shot", "goal", "set_play") for h in horizons])


def without_positive(rows: DataFrame, events: DataFrame, keys: list[str], row_time: str, event_time: str, label: str, mask: str, horizon: int) -> DataFrame:
    """Events with no positive row in [t - horizon, t), with a reason: no_rows, masked, or other."""
    r = rows.select(*keys, F.col(row_time).alias("_t"), F.col(label).alias("_label"), F.col(mask).alias("_mask"))
    e = events.select(*keys, F.col(event_time).alias("_t"), F.struct(*events.columns).alias("_event"))
    both = e.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-horizon, -1)
    seen = both.withColumns({"_n": F.count("_mask").over(w), "_free": F.bool_or("_mask").over(w), "_hit": F.bool_or(F.coalesce("_label", F.lit(False))).over(w)})
    reason = F.when(F.col("_n") == 0, "no_rows").when(~F.coalesce("_free", F.lit(False)), "masked").otherwise("other")
    return seen.where("_event IS NOT NULL AND NOT coalesce(_hit, false)").select("_event.*", reason.alias("reason"))


def seconds_bin(seconds: Column) -> Column:
    """The bin of a time to the next shot: 0-1, 1-2, 2-3, 3-5 seconds, lower ends open."""
    return F.when(seconds <= 1, "0-1").when(seconds <= 2, "1-2").when(seconds <= 3, "2-3").when(seconds <= 5, "3-5")
