"""Joins, aggregates and set operations on tables that need no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.session import hinted


def apart(dx: Column, dy: Column) -> Column:
    """The distance as the root of a sum of squares, not as ``hypot``, whose last digit differs: which of two equal distances is the lesser hangs on it.

    Exact decimals are subtracted as such and squared as doubles.
    """
    dx, dy = dx.cast("double"), dy.cast("double")
    return F.sqrt(dx * dx + dy * dy)


def nearest(objects: DataFrame, targets: DataFrame, on: list[str], within: float | None = None) -> DataFrame:
    """For each target row (``on``, bx, by) its nearest object (x, y), ties by object_id; objects out of reach don't count."""
    d = apart(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    near = objects.join(targets, on).withColumn("d", d)
    near = near if within is None else near.where(F.col("d") <= within)
    return near.groupBy(*on).agg(F.min_by(F.struct("object_id", "team", "d"), F.struct("d", "object_id")).alias("n")).select(*on, "n.*")


def tie_weights(objects: DataFrame, on: list[str], distance: str, eps: float = 1e-9) -> DataFrame:
    """(on, team, weight): the teams of all objects within eps of the least distance share it; unknown teams take a share nobody gets."""
    least = F.min(distance).over(Window.partitionBy(*on))
    near = objects.withColumn("_least", least).where(F.col(distance) <= F.col("_least") + eps)
    teams = near.groupBy(*on).agg(F.collect_set(F.coalesce("team", F.lit("?"))).alias("teams"))
    return teams.select(*on, F.explode("teams").alias("team"), (F.lit(1.0) / F.size("teams")).alias("weight")).where("team != '?'")


def team_shape(objects: DataFrame, on: list[str], halfway: float = 0.0) -> DataFrame:
    """Per frame and team in one aggregation: centroid, extremes and counts, for home and away side by side."""
    out = []
    for t in ("home", "away"):
        own = F.col("team") == t
        out += [F.avg(F.when(own, F.col("x"))).alias(f"{t}_x"), F.avg(F.when(own, F.col("y"))).alias(f"{t}_y"), F.max(F.when(own, F.col("x"))).alias(f"{t}_max_x"), F.min(F.when(own, F.col("x"))).alias(f"{t}_min_x"), F.count_if(own & (F.col("x") > halfway)).alias(f"{t}_past"), F.count_if(own).alias(f"{t}_n")]
    return objects.groupBy(*on).agg(*out)


def mutual_nearest(a: DataFrame, b: DataFrame, on: list[str], gate: float) -> DataFrame:
    """(on, a_id, b_id, d): pairs within the gate of which each is the other's nearest.  ``a``, ``b``: (on, id, x, y).

    In a crowd this can leave more rows unmatched than an optimal assignment would.  All pairs of a group are made: for the few of a frame; ``crowds.mutual_nearest`` is for more.
    """
    pairs = a.select(*on, F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select(*on, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by")), on)
    return mutual(pairs.withColumn("d", apart(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("d") <= gate), on)


def mutual(pairs: DataFrame, on: list[str]) -> DataFrame:
    """The pairs (on, a_id, b_id, d) that come first for both, by d, a_id and b_id."""
    first = {s: F.row_number().over(Window.partitionBy(*on, s).orderBy("d", F.col("a_id").asc_nulls_last(), F.col("b_id").asc_nulls_last())) for s in ("a_id", "b_id")}
    return pairs.withColumns({"_a": first["a_id"], "_b": first["b_id"]}).where("_a = 1 AND _b = 1").select(*on, "a_id", "b_id", "d")


def candidates_alone(labels: DataFrame, found: DataFrame, on: list[str], radius: float, alone: float, confidence: float) -> DataFrame:
    """Labels (on, x, y) with their nearest candidate within a radius, if no other is within ``alone`` of the label and it is confident."""
    f = found.select(*on, F.col("x").alias("fx"), F.col("y").alias("fy"), "confidence")
    near = labels.join(f, on).withColumn("d", F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy")))
    w = Window.partitionBy(*on).orderBy("d")
    near = near.withColumns({"_n": F.row_number().over(w), "_next": F.lead("d").over(w)})
    return near.where((F.col("_n") == 1) & (F.col("d") <= radius) & (F.col("_next").isNull() | (F.col("_next") > alone)) & (F.col("confidence") >= confidence)).drop("_n", "_next")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def seeded_sample(df: DataFrame, keys: list[str], row_id: str, share: float, seed: str) -> DataFrame:
    """A share of each group's rows, one at least, chosen by a hash of seed and id; the sampling is the feature.

    Hashes are counted by their first four digits; running counts tell which of these buckets a group takes whole, and rows are ranked inside a bucket only, so a
    group of any size is sorted in pieces.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(row_id).cast("string")))
    rows = df.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, 4))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    counts = rows.groupBy(*own, F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*names))})
    counts = counts.withColumn("_take", F.greatest(F.lit(1), F.ceil(F.col("_all") * share))).where("_before < _take").select(*names, "_b", "_before", "_take")
    on = F.col("_bucket") == F.col("_b")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_h", row_id))
    taken = rows.join(hinted(counts, 1_000_000), on).withColumn("_rank", rank)
    return taken.where(F.col("_before") + F.col("_rank") <= F.col("_take")).select(*df.columns)


def majority(df: DataFrame, keys: list[str], value: str, least: int, share: float) -> DataFrame:
    """(keys, value, n, share): a group's most common value, if it has enough rows and share; ties to the lesser value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b"), F.sum("n").alias("all"))
    return best.select(*keys, f"b.{value}", "b.n", (F.col("b.n") / F.col("all")).alias("share")).where((F.col("all") >= least) & (F.col("share") >= share))


def shares(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """(keys, n, hits, rate, of_all): a flag's rate by group, and the group's share of all hits."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"))
    return by.withColumns({"rate": F.col("hits") / F.col("n"), "of_all": F.try_divide(F.col("hits"), F.sum("hits").over(Window.partitionBy()))})


def distances(df: DataFrame, keys: list[str], d: str, within: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(d).alias("n"), F.percentile(d, 0.5).alias("median"), F.percentile(d, 0.9).alias("p90"), F.avg((F.col(d) <= within).cast("double")).alias("share_within"))


def offset_sweep(a: DataFrame, b: DataFrame, keys: list[str], tick: str, shifts: list[int], hit: Column) -> DataFrame:
    """(shift, n, hits, share): how often ``hit`` holds between a's rows and b's rows ``shift`` ticks later."""
    moved = a.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn(tick, F.col(tick) + F.col("shift"))
    both = moved.join(b, [*keys, tick])
    return both.groupBy("shift").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("share", F.col("hits") / F.col("n"))


def plateau_middle(sweep: DataFrame) -> DataFrame:
    """(shift): the middle of the shifts that reach the best share."""
    best = sweep.withColumn("_best", F.max("share").over(Window.partitionBy())).where("share = _best")
    return best.agg(F.element_at(F.array_sort(F.collect_list("shift")), (F.floor((F.count("*") - 1) / 2) + 1).cast("int")).alias("shift"))


def replaced(df: DataFrame, new: DataFrame, keep: Column) -> DataFrame:
    """The rows where ``keep`` holds (null keeps), and the new ones."""
    return df.where(F.coalesce(keep, F.lit(True))).unionByName(new, allowMissingColumns=True)


def swapped(grid: DataFrame, state: DataFrame, on: list[str], column: str, age: str, most_age: float) -> DataFrame:
    """``grid`` with a column from ``state``, null where its age is beyond ``most_age``; ``covered`` tells rows that the state lacks."""
    s = state.select(*on, F.col(column).alias("_new"), F.col(age).alias("_age"), F.lit(True).alias("_covered"))
    got = grid.join(s, on, "left")
    return got.withColumns({column: F.when(F.col("_age") <= most_age, F.col("_new")), "covered": F.coalesce("_covered", F.lit(False))}).drop("_new", "_age", "_covered")


def drop_report(df: DataFrame, reason: str, keys: list[str]) -> DataFrame:
    """Counts by reason of the rows that a conversion has marked instead of deleting."""
    return df.where(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count("*").alias("n"))
