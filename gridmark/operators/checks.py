"""Checks of converted matches, and the small rules that prepare them: alignment, sides, keepers, drift, samples, shootouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.operators.windows import filled, ordered


def usable(objects: DataFrame) -> DataFrame:
    """Balls, players and keepers that are visible, not interpolated and at a finite place."""
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    return objects.where(F.col("object_type").isin("ball", "player", "goalkeeper") & F.col("visible") & ~F.col("interpolated") & finite)


def home_frame(objects: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The usable objects with x and y turned so that the home team attacks to the right."""
    rows = usable(objects).join(frames.select(*keys, "home_attacks_positive_x"), keys)
    sign = F.when(F.col("home_attacks_positive_x"), 1.0).otherwise(-1.0)
    return rows.withColumns({"x": F.col("x") * sign, "y": F.col("y") * sign}).drop("home_attacks_positive_x")


def attack_direction(period: Column, first: Column, third: Column) -> Column:
    """Whether home attacks to the right: ``first`` in period 1 and the reverse in 2, ``third`` in 3 and the reverse in 4; null elsewhere."""
    return F.when(period == 1, first).when(period == 2, ~first).when(period == 3, third).when(period == 4, ~third)


def moved_shootout(frames: DataFrame, shootouts: DataFrame) -> DataFrame:
    """Frames of period 4 from a match's ``start_s`` on become period 5: dead, of no team, and timed from there.  ``shootouts``: (match_id, start_s)."""
    rows = frames.join(shootouts.select("match_id", F.col("start_s").alias("_from")), "match_id", "left")
    late = F.coalesce((F.col("period") == 4) & (F.col("timestamp_s") >= F.col("_from")), F.lit(False))
    return rows.withColumn("_late", late).withColumns({
        "period": F.when(F.col("_late"), 5).otherwise(F.col("period")).cast("long"), "timestamp_s": F.when(F.col("_late"), F.col("timestamp_s") - F.col("_from")).otherwise(F.col("timestamp_s")),
        "ball_state": F.when(F.col("_late"), "dead").otherwise(F.col("ball_state")), "possession_team": F.when(~F.col("_late"), F.col("possession_team")),
    }).drop("_late", "_from")


def event_alignment(events: DataFrame, objects: DataFrame, keys: list[str], *, least: int = 30, most: float = 5.0) -> DataFrame:
    """(match_id, period, n, median_d, ok): how far a coded event's player is from the ball where both are visible.

    ``events`` have ``keys``, match_id, period and object_id.  Periods of at least ``least`` events and a median beyond ``most`` aren't ok.
    """
    seen = objects.where("visible")
    ball = seen.where("object_type = 'ball'").select(*keys, F.col("x").alias("bx"), F.col("y").alias("by"))
    who = seen.where("object_type <> 'ball'").select(*keys, "object_id", "x", "y")
    d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    by = events.join(who, [*keys, "object_id"]).join(ball, keys).withColumn("d", d).groupBy("match_id", "period").agg(F.count("*").alias("n"), F.percentile("d", 0.5).alias("median_d"))
    return by.withColumn("ok", ~((F.col("n") >= least) & (F.col("median_d") > most)))


def without_periods(df: DataFrame, alignment: DataFrame) -> DataFrame:
    """``df`` without the periods whose alignment isn't ok."""
    return df.join(alignment.where("NOT ok").select("match_id", "period"), ["match_id", "period"], "left_anti")


def side_check(rows: DataFrame, keys: list[str], side: str, y: Column) -> DataFrame:
    """(keys, left, right, gap): mean y of the left players less that of the right ones; ``y`` in the team's direction of attack."""
    by = rows.withColumn("_y", y).groupBy(*keys).pivot(side, ["left", "right"]).agg(F.avg("_y"))
    return by.withColumn("gap", F.col("left") - F.col("right"))


def keeper_direction(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, keeper_x, home_attacks_positive_x): the home keeper's mean x by period; home attacks to the right where it is negative."""
    by = rows.groupBy(*keys).agg(F.avg("x").alias("keeper_x"))
    return by.withColumn("home_attacks_positive_x", F.col("keeper_x") < 0)


def keeper_side(rows: DataFrame, keys: list[str], cluster: str, x: str, keeper_x: str) -> DataFrame:
    """(keys, cluster): of two clusters, 0 and 1, the one whose mean x is nearer to the keeper's; ties go to 0."""
    means = rows.groupBy(*keys).agg(F.avg(F.when(F.col(cluster) == 0, F.col(x))).alias("m0"), F.avg(F.when(F.col(cluster) == 1, F.col(x))).alias("m1"), F.first(keeper_x).alias("k"))
    nearer = F.abs(F.col("m1") - F.col("k")) < F.abs(F.col("m0") - F.col("k"))
    return means.select(*keys, F.when(F.coalesce(nearer, F.lit(False)), 1).otherwise(0).alias("keeper_cluster"))


def cutaways(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cutaway): frames of which no player is visible."""
    return objects.groupBy(*keys).agg((~F.coalesce(F.bool_or(F.when(F.col("object_type").isin("player", "goalkeeper"), F.col("visible"))), F.lit(False))).alias("cutaway"))


def surely(ranges: DataFrame, frames: DataFrame, keys: list[str], time: str, start: str, end: str, flag: str, width: int) -> DataFrame:
    """``ranges`` with whether ``flag`` holds on all their frames, of which there must be one."""
    from gridmark.operators.asof import interval_join

    inside = interval_join(frames, ranges, keys, time, start, end, width, closed="both").groupBy(*keys, start, end).agg(F.bool_and(flag).alias("_all"))
    return ranges.join(inside, [*keys, start, end], "left").withColumn(f"surely_{flag}", F.coalesce("_all", F.lit(False))).drop("_all")


def context_carried(frames: DataFrame, keys: list[str], order: list[str], values: list[str], view: str) -> DataFrame:
    """``frames`` with the last known ``values`` (``last_<value>``) and how many frames ago the view switched."""
    w = ordered(keys, *order)
    rows = frames.withColumns({f"last_{v}": filled(F.col(v), w) for v in values})
    rows = rows.withColumn("_n", F.row_number().over(w))
    switched = ~F.col(view).eqNullSafe(F.lag(view).over(w)) | (F.col("_n") == 1)
    return rows.withColumn("since_switch", F.col("_n") - filled(F.when(switched, F.col("_n")), w)).drop("_n")


def drift(pairs: DataFrame, keys: list[str], offset: str, most: float) -> DataFrame:
    """(keys, offset, spread, ok): the mean of a clip's pair offsets; not ok if they spread by more than ``most``."""
    by = pairs.groupBy(*keys).agg(F.avg(offset).alias("offset"), (F.max(offset) - F.min(offset)).alias("spread"))
    return by.withColumn("ok", F.col("spread") <= most)


def lost_samples(sampled: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """Sampled ids that are gone."""
    return sampled.join(current.select(*on).distinct(), on, "left_anti")


def bad_intervals(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that are empty, or begin before the one before them has ended."""
    before = F.max(end).over(ordered(keys, start, end).rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("why", F.when(F.col(start) >= F.col(end), "empty").when(F.col(start) < before, "overlap")).where("why IS NOT NULL")


def periodic(ranges: DataFrame, start: str, end: str, every: int, into: str = "tick") -> DataFrame:
    """The multiples of ``every`` inside each range [start, end)."""
    first = F.ceil(F.col(start) / every).cast("long")
    last = F.ceil(F.col(end) / every).cast("long") - 1
    return ranges.withColumn(into, F.explode(F.when(first <= last, F.transform(F.sequence(first, last), lambda i: i * every))))


def outside(points: DataFrame, marked: DataFrame, keys: list[str], time: str, start: str, end: str, width: int) -> DataFrame:
    """Points that no marked interval [start, end) of their keys holds.

    Each point looks at the furthest end of the intervals that have begun: one sort of both sides, no pairs.
    """
    p = points.withColumns({"_at": F.col(time), "_reach": F.lit(None).cast("long")})
    m = marked.select(*keys, F.col(start).cast("long").alias("_at"), F.col(end).cast("long").alias("_reach"), F.lit(True).alias("_mark"))
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(m, allowMissingColumns=True).withColumn("_furthest", F.max("_reach").over(w))
    return both.where(F.col("_mark").isNull() & ~F.coalesce(F.col("_furthest") > F.col(time), F.lit(False))).select(*points.columns)


def ladder(cases: dict[str, Column], other: str) -> Column:
    """The name of the first case that holds, else ``other``."""
    out = F.lit(other)
    for name, holds in reversed(cases.items()):
        out = F.when(holds, name).otherwise(out)
    return out


def tracks_filled(detections: DataFrame, keys: list[str], time: str, box: list[str], most_age: int) -> DataFrame:
    """Boxes per row of a track: its own, or the last one moved on at its last speed for at most ``most_age``; null beyond."""
    w = ordered(keys, time)
    have = F.col(box[0]).isNotNull()
    now = F.when(have, F.struct(F.col(time).alias("_t"), *box))
    last = filled(now, w)
    rows = detections.withColumn("_now", now)
    before = F.last("_now", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_speed", F.when(have & before.isNotNull() & (F.col(time) > before["_t"]), F.struct(*[((F.col(b) - before[b]) / (F.col(time) - before["_t"])).alias(b) for b in box])))
    rows = rows.withColumns({"_last": last, "_moves": filled(F.when(have, F.struct(F.col("_speed").alias("s"))), w)["s"]})
    age = F.col(time) - F.col("_last._t")
    filled_in = {b: F.when(have, F.col(b)).when(age <= most_age, F.col(f"_last.{b}") + age * F.coalesce(F.col(f"_moves.{b}"), F.lit(0.0))) for b in box}
    return rows.withColumns({f"filled_{b}": c for b, c in filled_in.items()}).drop("_now", "_speed", "_last", "_moves")


def sanity(objects: DataFrame, frames: DataFrame, events: DataFrame, most_speed: float = 12.0) -> DataFrame:
    """A row for each match that shows whether coordinates and events line up: shots, how far they are from the ball, the score, speeds, and shares of frames."""
    ball = objects.where("object_type = 'ball'").groupBy("match_id", "frame_id").agg(F.min_by(F.struct("x", "y"), "object_id").alias("b"))
    at = events.where("event_type IN ('shot', 'goal')").join(ball, ["match_id", "frame_id"], "left")
    shot, d = F.col("event_type") == "shot", F.hypot(F.col("x") - F.col("b.x"), F.col("y") - F.col("b.y"))
    far = F.when(shot, d)
    shots = at.groupBy("match_id").agg(
        F.count_if(shot).alias("shots"), F.count_if(shot & d.isNull()).alias("shots_without_ball"), F.percentile(far, 0.5).alias("shot_to_ball_median"), F.percentile(far, 0.9).alias("shot_to_ball_p90"),
        *[F.count_if((F.col("event_type") == "goal") & (F.col("team") == t)).alias(f"score_{t}") for t in ("home", "away")],
    )
    people, speed = objects.where("object_type <> 'ball'"), F.hypot("vx", "vy")
    fast = people.groupBy("match_id").agg(F.percentile(speed, 0.99).alias("player_speed_p99"), F.count_if(speed > most_speed).alias("rows_too_fast"))
    seen = people.groupBy("match_id", "frame_id").agg(F.bool_or("visible").alias("seen")).groupBy("match_id").agg((1 - F.avg(F.col("seen").cast("double"))).alias("frames_all_estimated"))
    alive = frames.groupBy("match_id").agg(F.avg((F.col("ball_state") == "alive").cast("double")).alias("frames_ball_alive"))
    rows = alive.join(shots, "match_id", "left").join(fast, "match_id", "left").join(seen, "match_id", "left")
    return rows.fillna(0, ["shots", "shots_without_ball", "score_home", "score_away", "rows_too_fast"])


def frozen_folds(assignments: DataFrame, frozen: DataFrame, match: str) -> DataFrame:
    """``assignments`` (match, fold) that are those of the frozen table, neither more nor less; anything else is an error."""
    from gridmark.operators import validate

    if odd := validate.equal_keys(assignments, frozen, [match, "fold"]).head(3):
        raise ValueError(f"assignments differ from the frozen folds: {odd}")
    return assignments


def carrier_teams(states: DataFrame, objects: DataFrame, keys: list[str], carrier: str = "carrier") -> DataFrame:
    """``states`` with ``carrier_team``, the team that a carrier's object has in the match (of several, the least)."""
    teams = objects.groupBy(*keys, F.col("object_id").alias(carrier)).agg(F.min("team").alias("carrier_team"))
    return states.join(teams, [*keys, carrier], "left")


def on_video(events: DataFrame, frames: DataFrame, clips: DataFrame, kinds: list[str], fps: float) -> DataFrame:
    """Events of the ``kinds`` on the frames of each clip's run: (clip, run_frame, event columns), none before the run begins.

    ``clips``: (clip, match_id, period, offset_s, start_s): period time less video time, and the video second at which the run begins.
    """
    timed = events.where(F.col("event_type").isin(*kinds)).join(frames.select("match_id", "frame_id", "period", "timestamp_s"), ["match_id", "frame_id"])
    at = F.round((F.col("timestamp_s") - F.col("offset_s") - F.col("start_s")) * fps).cast("long")
    return timed.join(clips, ["match_id", "period"]).withColumn("run_frame", at).where("run_frame >= 0").select("clip", "run_frame", *events.columns)


def goal_times(events: DataFrame, frames: DataFrame, starts: DataFrame, synced: DataFrame | None = None) -> DataFrame:
    """(match_id, utc_us, team, set_piece) of goals in periods whose start in UTC is known; ``synced``: hand-labelled ones, in the same shape, of matches without frames."""
    timed = events.where("event_type = 'goal'").join(frames.select("match_id", "frame_id", "period", "timestamp_s"), ["match_id", "frame_id"]).join(starts, ["match_id", "period"])
    out = timed.select("match_id", (F.col("start_us") + F.round(F.col("timestamp_s") * 1e6).cast("long")).alias("utc_us"), "team", "set_piece")
    return out if synced is None else out.unionByName(synced.select("match_id", "utc_us", "team", F.lit(None).cast("string").alias("set_piece")))


def earlier_attempts(results: DataFrame, version: str, source: str) -> DataFrame:
    """Each result with those of the versions it was derived from, however far back: (root, depth, result columns).  A source without a result is an error."""
    lost = results.where(F.col(source).isNotNull()).join(results.select(F.col(version).alias(source)).distinct(), source, "left_anti")
    if bad := lost.select(version, source).head(3):
        raise ValueError(f"no result of the source, run it first: {bad}")
    level, depth = results.select(F.col(version).alias("root"), F.lit(0).alias("depth"), *results.columns), 0
    out, most = level, results.count()
    while depth < most and not (up := level.where(F.col(source).isNotNull()).select("root", F.col(source).alias("_up"))).isEmpty():
        depth += 1
        level = up.join(results, up["_up"] == results[version]).select("root", F.lit(depth).alias("depth"), *results.columns)
        out = out.unionByName(level)
    return out
