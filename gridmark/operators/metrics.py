"""Metrics of scores and alarms, calibration, folds and comparisons.

Scores are grouped by equal value first; running sums then go over distinct scores.  They are dealt out by ranges of the score: each range sums up its own, the sums of the
ranges before are added (a row for each range and group), and no task holds more than a range.  Exact quantiles read the same running counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.operators import sequential
from gridmark.session import hinted, staged


def _running(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """(by, p, pos, n, pos_at, n_at): the counts at a score and at or above it, ``pos_all`` and ``n_all`` of the group."""
    at = df.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    rows = _ranged(at, by, ["pos", "n"])
    totals = rows.groupBy(*by).agg(F.sum("pos").alias("pos_all"), F.sum("n").alias("n_all"))
    return rows.join(totals, by) if by else rows.crossJoin(F.broadcast(totals))  # one row


def _ranged(at: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """Distinct scores (by, p, counts) with ``<count>_at``: the running sums from the highest score of a group down to this one.

    Scores are cut into ranges once and written with their range, as a cut made anew could fall elsewhere.
    """
    cut = staged(at.repartitionByRange(F.col("p").desc(), *by).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by, "_range").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    starts = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    rows = cut.withColumns({f"{c}_at": F.sum(c).over(own) for c in counts}).join(hinted(starts, 1_000_000), [*by, "_range"])
    return rows.select(*by, "p", *counts, *[(F.col(f"{c}_at") + F.col(f"_{c}")).alias(f"{c}_at") for c in counts])


def quantiles(df: DataFrame, p: str, shares: list[float]) -> list[float]:
    """Exact quantiles of a column, on the straight line between the ranks around each; empty without values.  What reaches the driver is two values for each share."""
    at = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.count("*").alias("n"))
    rows = _ranged(at, [], ["n"])
    n = rows.agg(F.sum("n")).first()[0] or 0
    if not n:
        return []
    places = [s * (n - 1) for s in shares]
    ranks = sorted({n - 1 - r for x in places for r in (math.floor(x), math.ceil(x))})  # counted from the highest
    wanted = rows.sparkSession.createDataFrame([(r,) for r in ranks], "rank long")
    found = {r["rank"]: r["p"] for r in rows.join(F.broadcast(wanted), (F.col("rank") < F.col("n_at")) & (F.col("rank") >= F.col("n_at") - F.col("n"))).select("rank", "p").collect()}
    low, high = ([found[n - 1 - f(x)] for x in places] for f in (math.floor, math.ceil))
    return [a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, places, strict=True)]


def threshold_free(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, positives, pr_auc, roc_auc, brier, log_loss).  Average precision groups ties; ROC AUC counts them half.

    pr_auc is null without positives, roc_auc without both classes.  Rows with a null score or label don't count.
    """
    by = by or []
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(p).alias("p"), F.col(y).cast("int").alias("y"))
    r = _running(rows, "p", "y", by)
    neg, neg_at = F.col("n") - F.col("pos"), F.col("n_at") - F.col("pos_at")
    below = (F.col("n_all") - F.col("pos_all")) - neg_at
    curve = r.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum(F.try_divide(F.col("pos") * F.col("pos_at"), F.col("n_at") * F.col("pos_all"))).alias("pr_auc"),
        F.sum(F.try_divide(F.col("pos") * (below + 0.5 * neg), F.col("pos_all") * (F.col("n_all") - F.col("pos_all")))).alias("roc_auc"),
    )
    c = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = rows.groupBy(*by).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(-F.when(F.col("y") == 1, F.ln(c)).otherwise(F.ln(1 - c))).alias("log_loss"))
    return curve.join(loss, by) if by else curve.crossJoin(F.broadcast(loss))  # one row each


def calibration(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """(bin, n, mean_p, share): bins by exact quantile edges, an edge belongs to the bin above; empty bins are absent."""
    rows = df.where(F.col(p).isNotNull())
    edges = quantiles(rows, p, [i / bins for i in range(1, bins)])
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(p))) if edges else F.lit(0)
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))


def score_alarms(shots: DataFrame, alarms: DataFrame, keys: list[str], grace: int, width: int, by: list[str] | None = None) -> DataFrame:
    """Each shot with the alarm that it takes: (shot_id, alarm_id, lead_us), nulls for a missed one.

    An active alarm goes before one in grace, then the latest start, then the least id.  The alarm that started last before a shot is looked up in one window, and tells
    all where alarms follow each other (``possession.alarms``): no shot is paired with an alarm.  Only a shot that an earlier start may reach, as its alarm outlasts later
    ones, is joined with all that hold it.  ``width``: the cells of that join.
    """
    by = by or []
    every = [*by, *keys]
    a = alarms.dropna(subset=[*every, "start_us", "end_us"]).select(*every, "alarm_id", "start_us", "end_us")
    points = shots.select(*every, F.col("ts_us").alias("_t"), F.lit(False).alias("_is"), "shot_id")
    both = points.unionByName(a.select(*every, F.col("start_us").alias("_t"), F.lit(True).alias("_is"), "alarm_id", "end_us"), allowMissingColumns=True)
    before = Window.partitionBy(*every).orderBy("_t", "_is", F.desc("alarm_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_is"), F.struct("alarm_id", F.col("_t").alias("start_us"), "end_us")), ignorenulls=True).over(before)
    seen = both.withColumns({"_a": last, "_reach": F.max("end_us").over(before)}).where("NOT _is")
    seen = staged(seen.select(*every, "shot_id", F.col("_t").alias("ts_us"), "_a", "_reach"), "last-alarms")
    t, end, reach = F.col("ts_us"), F.col("_a.end_us"), F.col("_reach")
    holds = t <= end + grace
    open_ = F.coalesce((t > end) & ((reach >= t) | (~holds & (reach + grace >= t))), F.lit(False))
    own = F.when(holds, F.col("_a"))
    taken = seen.where(~open_).select(*by, "shot_id", own["alarm_id"].alias("alarm_id"), (t - own["start_us"]).alias("lead_us"))
    rest = seen.where(open_).select(*every, "shot_id", "ts_us")
    return taken if rest.isEmpty() else taken.unionByName(_held(rest, a, every, grace, width, by))


def _held(shots: DataFrame, alarms: DataFrame, keys: list[str], grace: int, width: int, by: list[str]) -> DataFrame:
    """``score_alarms`` by a join with all alarms that hold a shot."""
    from gridmark.operators.asof import interval_join

    got = interval_join(shots, alarms.withColumn("_until", F.col("end_us") + grace), keys, "ts_us", "start_us", "_until", width)
    best = got.groupBy(*by, "shot_id").agg(F.min(F.struct((F.col("ts_us") > F.col("end_us")).alias("late"), (-F.col("start_us")).alias("s"), "alarm_id", (F.col("ts_us") - F.col("start_us")).alias("lead_us"))).alias("b"))
    return best.select(*by, "shot_id", "b.alarm_id", "b.lead_us")


def alarm_summary(taken: DataFrame, alarms: DataFrame, n_matches: Column, by: list[str]) -> DataFrame:
    """(by, shots, missed, miss_rate, median_lead_us, n_alarms, false_alarms, false_per_match) from ``score_alarms``."""
    shots = taken.groupBy(*by).agg(F.count("*").alias("shots"), F.count_if(F.col("alarm_id").isNull()).alias("missed"), F.percentile("lead_us", 0.5).alias("median_lead_us"))
    hit = taken.where("alarm_id IS NOT NULL").select(*by, "alarm_id").distinct().withColumn("_hit", F.lit(1))
    own = alarms.join(hit, [*by, "alarm_id"], "left").groupBy(*by).agg(F.count("*").alias("n_alarms"), F.count_if(F.col("_hit").isNull()).alias("false_alarms"))
    both = shots.join(own, by, "left").fillna(0, ["n_alarms", "false_alarms"])
    return both.withColumns({"miss_rate": F.try_divide(F.col("missed"), F.col("shots")), "false_per_match": F.col("false_alarms") / n_matches})


def choose_tau(summary: DataFrame, most_false: float, by: list[str] | None = None) -> DataFrame:
    """The row (of each ``by``) with the lowest miss rate among those within the budget, ties to the higher tau; else with the fewest false alarms, flagged."""
    inside = F.col("false_per_match") <= most_false
    order = F.struct((~inside).alias("over"), F.when(inside, F.col("miss_rate")).otherwise(F.col("false_per_match")).alias("worth"), (-F.col("tau")).alias("t"))
    best = summary.groupBy(*by or []).agg(F.min_by(F.struct(*[c for c in summary.columns if c not in (by or [])]), order).alias("b"), F.min(order).alias("o"))
    return best.select(*by or [], "b.*", F.col("o.over").alias("over_budget"))


def stratified_folds(matches: DataFrame, match: str, source: str, size: str, folds: int, seed: str) -> DataFrame:
    """``matches`` with ``fold``: blocks of ``folds`` matches of like size, dealt out by a hash inside each block."""
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col(match).cast("string")))
    by_size = Window.partitionBy(source).orderBy(F.col(size).desc(), match)
    blocks = matches.withColumn("_block", F.floor((F.row_number().over(by_size) - 1) / folds))
    place = F.row_number().over(Window.partitionBy(source, "_block").orderBy(mixed, match)) - 1
    return blocks.withColumn("fold", place.cast("int")).drop("_block")


class SmallestFold:
    """Gives each match of a source the fold with the fewest matches, then the least size, then the least number; what it keeps is two numbers for each fold."""

    def __init__(self, params: dict) -> None:
        self.load = [[0, 0] for _ in range(params["_folds"])]

    def step(self, row: dict) -> list[dict]:
        fold, size, out = row["_fold"], row["_size"] or 0, []
        if fold is None:
            fold = min(range(len(self.load)), key=lambda f: (*self.load[f], f))
            out = [{"_match": row["_match"], "fold": fold}]
        fold = int(fold)  # pandas has no whole numbers beside nulls
        self.load[fold] = [self.load[fold][0] + 1, self.load[fold][1] + size]
        return out

    def end(self) -> list[dict]:
        return []


def appended_folds(frozen: DataFrame, matches: DataFrame, match: str, source: str, size: str, folds: int, seed: str) -> DataFrame:
    """(match, source, size, fold): frozen assignments, which never move, and later matches.

    A source without frozen matches is dealt out anew (``stratified_folds``); each later match of another goes, in the order of its id, to the fold that is smallest then.
    One row is one match, so the one pass over a source's matches is short.
    """
    late = matches.select(match, source, size).join(frozen.select(match), match, "left_anti")
    old = frozen.select(source).distinct()
    fresh = stratified_folds(late.join(old, source, "left_anti"), match, source, size, folds, seed).select(match, source, size, "fold")
    late = late.join(old, source)
    both = frozen.select(source, F.col(match).alias("_match"), F.col(size).cast("long").alias("_size"), F.col("fold").cast("int").alias("_fold")).unionByName(late.select(source, F.col(match).alias("_match"), F.col(size).cast("long").alias("_size"), F.lit(None).cast("int").alias("_fold")))
    both = both.withColumns({"_late": F.col("_fold").isNull(), "_folds": F.lit(folds)})
    kind = matches.schema[match].dataType.simpleString()
    dealt = sequential.batch(both, [source], ["_late", "_match"], SmallestFold, f"_match {kind}, fold int", ["_folds"])
    dealt = dealt.select(F.col("_match").alias(match), "fold").join(late, match).select(match, source, size, "fold")
    return frozen.select(match, source, size, "fold").unionByName(dealt).unionByName(fresh)


def refreshed_sizes(frozen: DataFrame, current: DataFrame, match: str, size: str) -> DataFrame:
    """``frozen`` with the sizes that ``current`` has now, and ``changed``; folds never move."""
    now = current.select(match, F.col(size).alias("_now"))
    rows = frozen.join(now, match, "left").withColumn("_new", F.coalesce("_now", size))
    return rows.withColumn("changed", ~F.col("_new").eqNullSafe(F.col(size))).withColumn(size, F.col("_new")).select(*frozen.columns, "changed")


def inner_split(matches: DataFrame, match: str, source: str, size: str, every: int, seed: str) -> DataFrame:
    """``matches`` with ``held``: one of each block of ``every`` matches of like size."""
    return stratified_folds(matches, match, source, size, every, seed).withColumn("held", F.col("fold") == 0).drop("fold")


def paired(a: DataFrame, b: DataFrame, on: list[str], metric: str, higher: bool = True) -> DataFrame:
    """(n, wins, mean_delta) of b against a over their common keys."""
    both = a.select(*on, F.col(metric).alias("_a")).join(b.select(*on, F.col(metric).alias("_b")), on)
    delta = F.col("_b") - F.col("_a")
    return both.agg(F.count("*").alias("n"), F.count_if(delta > 0 if higher else delta < 0).alias("wins"), F.avg(delta).alias("mean_delta"))
