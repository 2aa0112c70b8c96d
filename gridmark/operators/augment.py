"""Faults for robustness tests: deterministic noise on objects, keyed by seed, arm and row, so that any order of work gives the same faults."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions.scalars import normal, uniform
from gridmark.operators import machines, sequential

#: The arms in the one order in which they are applied.
ARMS = ("camera_drift", "player_noise", "ball_noise", "ball_false", "no_ball_z", "ball_miss", "geom_loss", "player_miss", "team_flip", "team_unknown", "id_fragment")
SERIES = ["match_id", "period"]
# Mean lengths of episodes and correlation times of noise in ticks, the spread of a drift by its scale, and how near the ball teams are confused twice as often.
MEAN_TICKS = {"ball_false": 5, "ball_miss": 20, "geom_loss": 10, "player_miss": 10, "team_flip": 30, "team_unknown": 30}
TAU_TICKS = {"camera_drift": 30, "player_noise": 5, "ball_noise": 10}
DRIFT_SPREAD, NEAR_BALL_M = 1.3, 10.0
PEOPLE = ("player", "goalkeeper")


def episodes(df: DataFrame, keys: list[str], tick: str, share: float, mean: float, seed: str, into: str, since: str | None = None) -> DataFrame:
    """``df`` with a boolean ``into``: episodes of geometric length with the given mean that cover about ``share`` of the rows.

    ``df`` has one row for each tick of a series.  A start covers its length in ticks; rows between the latest end so far and their start are free.
    ``since``: a further column with the latest start up to a row.
    """
    start = uniform(F.lit(seed), F.lit("start"), *map(F.col, [*keys, tick])) < 1 - math.exp(math.log(1 - share) / mean)
    length = F.floor(F.ln(F.greatest(uniform(F.lit(seed), F.lit("length"), *map(F.col, [*keys, tick])), F.lit(1e-12))) / math.log(1 - 1 / max(mean, 1.000001))) + 1
    w = Window.partitionBy(*keys).orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_end", F.when(start, F.col(tick) + length)).withColumn(into, F.coalesce(F.max("_end").over(w) > F.col(tick), F.lit(False)))
    return (out.withColumn(since, F.max(F.when(F.col("_end").isNotNull(), F.col(tick))).over(w)) if since else out).drop("_end")


def _noise(params: dict) -> machines.Autoregressive:
    return machines.Autoregressive(int(params["tau_us"]), params["sigma"])


def correlated(df: DataFrame, keys: list[str], time: str, row_id: str, tau_us: int, sigma: float, seed: str) -> DataFrame:
    """(keys, event_id, noise): an AR(1) series over each group."""
    z = df.select(*keys, F.col(time).alias("ts_us"), F.col(row_id).alias("event_id"), normal(F.lit(seed), *map(F.col, keys), F.col(row_id)).alias("z"), F.lit(tau_us).alias("tau_us"), F.lit(float(sigma)).alias("sigma"))
    return sequential.batch(z, keys, ["ts_us", "event_id"], _noise, "event_id long, noise double", params=["tau_us", "sigma"])


def drifts(objects: DataFrame, keys: list[str], axes: list[str], tau: int, seed: str) -> DataFrame:
    """(keys, k, axes): for each series of ``keys`` and each axis a stationary AR(1) series of spread 1 over its ticks; a gap in the ticks decays like time."""
    rows = objects.select(*keys, "k").distinct().withColumn("_axis", F.explode(F.array(*[F.lit(a) for a in axes])))
    noise = correlated(rows, [*keys, "_axis"], "k", "k", tau, 1.0, seed)
    return noise.groupBy(*keys, F.col("event_id").alias("k")).agg(*[F.max(F.when(F.col("_axis") == a, F.col("noise"))).alias(a) for a in axes])


def ball_carried(objects: DataFrame) -> DataFrame:
    """(match_id, period, k, bx, by): the visible ball, carried forward over all ticks of a period; null before the first."""
    ball = F.min_by(F.when((F.col("object_type") == "ball") & F.col("visible"), F.struct("x", "y")), F.when((F.col("object_type") == "ball") & F.col("visible"), F.col("object_id")))
    w = Window.partitionBy(*SERIES).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return objects.groupBy(*SERIES, "k").agg(ball.alias("_b")).withColumn("_b", F.last("_b", ignorenulls=True).over(w)).select(*SERIES, "k", F.col("_b.x").alias("bx"), F.col("_b.y").alias("by"))


def shifted(objects: DataFrame, which: Column, dx: Column, dy: Column) -> DataFrame:
    """``objects`` moved by (dx, dy) where ``which`` holds; null noise moves nothing."""
    return objects.withColumns({c: F.when(which, F.col(c) + F.coalesce(d, F.lit(0.0))).otherwise(F.col(c)) for c, d in (("x", dx), ("y", dy))})


def hidden(objects: DataFrame, which: Column) -> DataFrame:
    return objects.withColumn("visible", F.col("visible") & ~F.coalesce(which, F.lit(False)))


def without_ball_z(objects: DataFrame) -> DataFrame:
    return objects.withColumn("z", F.when(F.col("object_type") != "ball", F.col("z")))


def false_ball(objects: DataFrame, active: str, since: str, seed: str) -> DataFrame:
    """The visible ball 5 to 30 metres away during episodes, in one direction for each episode (its start is ``since``)."""
    keys = [F.col("match_id"), F.col("period"), F.col(since)]
    far, turn = 5 + 25 * uniform(F.lit(seed), F.lit("far"), *keys), 2 * math.pi * uniform(F.lit(seed), F.lit("turn"), *keys)
    return shifted(objects, F.col(active) & (F.col("object_type") == "ball") & F.col("visible"), far * F.cos(turn), far * F.sin(turn))


def team_fault(objects: DataFrame, active: str, flip: bool) -> DataFrame:
    """The other team, or none, during a visible person's episodes."""
    other = F.when(F.col("team") == "home", "away").when(F.col("team") == "away", "home") if flip else F.lit(None).cast("string")
    which = F.col(active) & F.col("team").isNotNull() & F.col("visible") & F.col("object_type").isin(*PEOPLE)
    return objects.withColumn("team", F.when(which, other).otherwise(F.col("team")))


def fragmented_ids(objects: DataFrame, life_ticks: float, seed: str) -> DataFrame:
    """Track ids with a suffix that grows at random breaks, one in ``life_ticks`` rows."""
    w = Window.partitionBy(*SERIES, "object_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.sum(F.when(uniform(F.lit(seed), F.lit("break"), "match_id", "period", "object_id", "k") < 1 / life_ticks, 1).otherwise(0)).over(w)
    return objects.withColumn("object_id", F.when(F.col("object_type") == "ball", F.col("object_id")).otherwise(F.concat_ws("~", "object_id", breaks)))


def severity(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """What an arm did: RMS of moved positions, shares of rows hidden and of teams changed."""
    a = after.select(*on, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("visible").alias("_v"), F.col("team").alias("_t"))
    both = before.join(a, on)
    return both.agg(F.sqrt(F.avg((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2)).alias("rms"), F.avg((F.col("visible") & ~F.col("_v")).cast("double")).alias("hidden"), F.avg((~F.col("team").eqNullSafe(F.col("_t"))).cast("double")).alias("team_changed"))


def noisy(objects: DataFrame, arm: str, amount: float, seed: str, ball: DataFrame) -> DataFrame:
    """Objects moved by AR(1) series: each person by its own, the ball by the period's, or all by the camera's offset and scale about ``ball`` (``ball_carried``)."""
    if arm == "camera_drift":
        d = drifts(objects, SERIES, ["dx", "dy", "ds"], TAU_TICKS[arm], seed).join(ball, [*SERIES, "k"], "left")
        out, scale = objects.join(d, [*SERIES, "k"], "left"), amount / DRIFT_SPREAD
        moved = {c: F.col(f"d{c}") * scale + F.col("ds") * (scale / 20) * (F.col(c) - F.coalesce(f"b{c}", F.lit(0.0))) for c in ("x", "y")}
        return shifted(out, F.lit(True), moved["x"], moved["y"]).drop("dx", "dy", "ds", "bx", "by")
    kinds, keys = (PEOPLE, [*SERIES, "object_id"]) if arm == "player_noise" else (("ball",), SERIES)
    which = F.col("object_type").isin(*kinds)
    out = objects.join(drifts(objects.where(which), keys, ["dx", "dy"], TAU_TICKS[arm], seed), [*keys, "k"], "left")
    return shifted(out, which, amount * F.col("dx"), amount * F.col("dy")).drop("dx", "dy")


def confused(objects: DataFrame, clean: DataFrame, ball: DataFrame, arm: str, share: float, seed: str) -> DataFrame:
    """``team_fault`` in each person's episodes, and in a second set of them where it truly was within ten metres of the ball."""
    keys = [*SERIES, "object_id"]
    people = clean.where(F.col("object_type").isin(*PEOPLE)).groupBy(*keys, "k").agg(F.min_by("x", F.struct("x", "y")).alias("_x"), F.min_by("y", F.struct("x", "y")).alias("_y")).join(ball, [*SERIES, "k"], "left")
    near = F.coalesce(F.hypot(F.col("_x") - F.col("bx"), F.col("_y") - F.col("by")) <= NEAR_BALL_M, F.lit(False))
    both = episodes(episodes(people, keys, "k", share, MEAN_TICKS[arm], f"{seed}:a", "_a"), keys, "k", share, MEAN_TICKS[arm], f"{seed}:b", "_c")
    out = objects.join(both.select(*keys, "k", (F.col("_a") | (F.col("_c") & near)).alias("_on")), [*keys, "k"], "left")
    return team_fault(out.withColumn("_on", F.coalesce("_on", F.lit(False))), "_on", arm == "team_flip").drop("_on")


def applied(objects: DataFrame, ticks: DataFrame, amounts: dict[str, float], seed: str) -> DataFrame:
    """``objects`` with the asked arms in their fixed order; ``ticks``: (match_id, period, k), a row for each tick.  The ball that drift and team faults go by is the clean one."""
    out, ball = objects, ball_carried(objects)
    for arm in (a for a in ARMS if a in amounts):
        amount, key = amounts[arm], f"{seed}:{arm}"
        if arm == "no_ball_z":
            out = without_ball_z(out)
        elif arm == "id_fragment":
            out = fragmented_ids(out, amount, key)
        elif arm in TAU_TICKS:
            out = noisy(out, arm, amount, key, ball)
        elif arm in ("team_flip", "team_unknown"):
            out = confused(out, objects, ball, arm, amount, key)
        else:
            keys = [*SERIES, "object_id"] if arm == "player_miss" else SERIES
            series = out.where(F.col("object_type").isin(*PEOPLE)).select(*keys, "k").distinct() if arm == "player_miss" else ticks
            on = episodes(series, keys, "k", amount, MEAN_TICKS[arm], key, "_on", "_since").select(*keys, "k", "_on", "_since")
            out = out.join(on, [*keys, "k"], "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
            if arm == "ball_false":
                out = false_ball(out, "_on", "_since", key)
            else:
                which = {"ball_miss": F.col("object_type") == "ball", "player_miss": F.col("object_type").isin(*PEOPLE), "geom_loss": F.lit(True)}[arm]
                out = hidden(out, which & F.col("_on"))
            out = out.drop("_on", "_since")
    return out.select(*objects.columns)
