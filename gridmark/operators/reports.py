"""Reports over scores, labels, shots and alarms: one aggregation each, keyed so that many runs, sources or bins share a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.operators import metrics
from gridmark.operators.windows import filled, ordered


def flag_counts(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """(keys, n, a count for each flag)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()])


def share_summary(df: DataFrame, keys: list[str], share: str, weight: str, positives: str) -> DataFrame:
    """(keys, matches, rows, weighted_share, min_share, median_share, max_share, positives, rate) over rows of one match each."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("matches"), F.sum(weight).alias("rows"), (F.sum(F.col(share) * F.col(weight)) / F.sum(weight)).alias("weighted_share"), F.min(share).alias("min_share"),
        F.percentile(share, 0.5).alias("median_share"), F.max(share).alias("max_share"), F.sum(positives).alias("positives"), (F.sum(positives) / F.sum(weight)).alias("rate"),
    )


def better_mapping(df: DataFrame, keys: list[str], cluster: str, is_home: Column) -> DataFrame:
    """(keys, n, known, accuracy, coverage): the share right under the better of both ways to name two clusters; a null cluster is unknown."""
    c = F.col(cluster)
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(c).alias("known"), F.count_if((c == 0) == is_home).alias("_a"), F.count_if((c == 1) == is_home).alias("_b"))
    return by.select(*keys, "n", "known", F.try_divide(F.greatest("_a", "_b"), "known").alias("accuracy"), (F.col("known") / F.col("n")).alias("coverage"))


def mirrored_rows(df: DataFrame, time: str, stride: int, mirror: dict[str, Column]) -> DataFrame:
    """Every ``stride``-th row, and each again with the columns of ``mirror`` replaced; ``mirrored`` tells them apart."""
    kept = df.where(F.pmod(F.col(time), F.lit(stride)) == 0)
    return kept.withColumn("mirrored", F.lit(False)).unionByName(kept.withColumns(mirror).withColumn("mirrored", F.lit(True)))


def lead_table(taken: DataFrame, edges: list[int], by: list[str]) -> DataFrame:
    """(by, bin, shots): shots by how many of the edges their lead reaches; -1 for missed ones."""
    place = F.when(F.col("lead_us").isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col("lead_us") >= e)))
    return taken.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("shots"))


def matched_budget(summary: DataFrame, budgets: list[float]) -> DataFrame:
    """(budget, tau, miss_rate): for each budget of false alarms a match the lowest miss rate that keeps it; the higher tau at a tie."""
    rows = summary.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("false_per_match <= budget")
    return rows.groupBy("budget").agg(F.min(F.struct("miss_rate", (-F.col("tau")).alias("t"))).alias("b")).select("budget", (-F.col("b.t")).alias("tau"), "b.miss_rate")


def assigned_sources(have: DataFrame, folds: DataFrame, match: str, source: str) -> DataFrame:
    """(source, matches, known, role): ``cv`` if all matches of a source have a fold, ``partial`` if some, ``external`` if none."""
    rows = have.join(folds.select(match, F.lit(1).alias("_f")).distinct(), match, "left")
    by = rows.groupBy(source).agg(F.count("*").alias("matches"), F.count("_f").alias("known"))
    return by.withColumn("role", F.when(F.col("known") == F.col("matches"), "cv").when(F.col("known") > 0, "partial").otherwise("external"))


def gate_bars(result: DataFrame, base: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """(keys, bar, value, limit, ok): each measure against its base, times an inclusive limit; groups with another denominator ``n`` aren't ok."""
    b = base.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*limits, "n")])
    rows = result.join(b, keys, "left")
    bars = F.explode(F.array(*[F.struct(F.lit(c).alias("bar"), F.col(c).cast("double").alias("value"), (F.col(f"_{c}") * x).cast("double").alias("limit")) for c, x in limits.items()])).alias("b")
    rows = rows.select(*keys, F.col("n").eqNullSafe(F.col("_n")).alias("_same"), bars)
    return rows.select(*keys, "b.*", F.coalesce(F.col("_same") & (F.col("b.value") <= F.col("b.limit")), F.lit(False)).alias("ok"))


def feature_separation(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(feature, n, auc, oriented, finite, useful): each feature's AUC, its distance from chance, and whether enough of it is known."""
    cells = df.select(y, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("c")).select(y, "c.*")
    known = cells.where(F.col("v").isNotNull() & ~F.isnan("v"))
    auc = metrics.threshold_free(known.select("feature", (F.col("v")).alias("v"), y), "v", y, ["feature"]).select("feature", "roc_auc")
    n = cells.groupBy("feature").agg(F.count("*").alias("n"), (F.count_if(F.col("v").isNotNull() & ~F.isnan("v")) / F.count("*")).alias("finite"))
    return n.join(auc, "feature", "left").select("feature", "n", F.col("roc_auc").alias("auc"), F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("oriented"), "finite", (F.col("finite") >= 0.5).alias("useful"))


def sensitivity(runs: DataFrame, base: DataFrame, run: str, fold: str, value: str) -> DataFrame:
    """(run, mean_delta, worse): each run's mean difference from the base over folds, and on how many folds it is worse (lower)."""
    b = base.select(fold, F.col(value).alias("_base"))
    rows = runs.join(b, fold).withColumn("_d", F.col(value) - F.col("_base"))
    return rows.groupBy(run).agg(F.avg("_d").alias("mean_delta"), F.count_if(F.col("_d") < 0).alias("worse"))


def picked(configs: DataFrame, value: str, cost: str, target: float, band: float, name: str) -> DataFrame:
    """The config to take: of those whose cost is at most ``target`` the cheapest within ``band`` of the best value; the least name at a tie."""
    ok = configs.where(F.col(cost) <= target)
    best = ok.agg(F.max(value).alias("_best"))
    return ok.crossJoin(F.broadcast(best)).where(F.col(value) >= F.col("_best") - band).drop("_best").orderBy(cost, name).limit(1)  # one row of the best


def chosen_model(losses: DataFrame, fold: str, old: str, new: str, n: str, least_folds: int) -> DataFrame:
    """(old, new, better, take_new): pooled losses by size, on how many folds the new one is lower, and whether both favour it."""
    by = losses.agg((F.sum(F.col(old) * F.col(n)) / F.sum(n)).alias("old"), (F.sum(F.col(new) * F.col(n)) / F.sum(n)).alias("new"), F.count_if(F.col(new) < F.col(old)).alias("better"))
    return by.withColumn("take_new", (F.col("new") < F.col("old")) & (F.col("better") >= least_folds))


def staleness(df: DataFrame, keys: list[str], time: str, tie: list[str], fresh: Column, value: str) -> DataFrame:
    """``df`` with since_seen (time since ``fresh`` held), since_change (since the value of fresh rows changed), gap (to the row before) and held (their last value)."""
    w = ordered(keys, time, *tie)
    rows = df.withColumn("_v", F.when(fresh, F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turned = F.col("_v").isNotNull() & (before.isNull() | ~before["v"].eqNullSafe(F.col("_v.v")))
    rows = rows.withColumn("_turn", F.when(turned, F.col(time)))
    last = filled(F.col("_v"), w)
    return rows.withColumns({"since_seen": F.col(time) - last["t"], "since_change": F.col(time) - filled(F.col("_turn"), w), "gap": F.col(time) - F.lag(time).over(w), "held": last["v"]}).drop("_v", "_turn")


def binned_report(df: DataFrame, bin_: Column, p: str, y: str, wrong: Column) -> DataFrame:
    """(bin, n, share, positives, wrong, pr_auc) by a bin of the rows."""
    rows = df.withColumn("bin", bin_)
    by = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.count_if(wrong).alias("wrong"))
    ap = metrics.threshold_free(rows, p, y, ["bin"]).select("bin", "pr_auc")
    every = F.sum("n").over(Window.partitionBy())  # one row for each bin
    return by.withColumn("share", F.col("n") / every).join(ap, "bin", "left")


def first_hits(marks: DataFrame, hits: DataFrame, keys: list[str], time: str, before: int, after: int, id_: str, width: int) -> DataFrame:
    """``marks`` with ``delay``: from each mark to its earliest hit between ``before`` earlier and ``after`` later; null without one."""
    from gridmark.operators.asof import interval_join

    ranges = marks.withColumns({"_from": F.col(time) - before, "_to": F.col(time) + after, "_mark": F.col(time)}).select(*keys, id_, "_from", "_to", "_mark")
    met = interval_join(hits.select(*keys, time), ranges, keys, time, "_from", "_to", width, closed="both")
    first = met.groupBy(id_).agg((F.min(time) - F.min("_mark")).alias("delay"))
    return marks.join(first, id_, "left")


def active_feed(events: DataFrame, ticks: DataFrame, keys: list[str], time: str, tick: str, last: int, twin_of: Column, twins: DataFrame, on: list[str], width: int) -> DataFrame:
    """(keys, tick, events): at each tick the ids of the events of the ``last`` micros, newest first, without those that have a twin.

    ``twin_of``: which events may be one; ``twins``: the rows they are twins of, equal on ``on``.
    """
    from gridmark.operators.asof import interval_join

    alone = events.where(~F.coalesce(twin_of, F.lit(False))).unionByName(events.where(twin_of).join(twins.select(*on).distinct(), on, "left_anti").select(*events.columns))
    spans = alone.withColumn("_until", F.col(time) + last)
    met = interval_join(ticks, spans, keys, tick, time, "_until", width, closed="both")
    return met.groupBy(*keys, tick).agg(F.transform(F.sort_array(F.collect_list(F.struct(time, "event_id")), asc=False), lambda e: e["event_id"]).alias("events"))
