"""Alarms, team hysteresis, and carrier / possession / ball state as window expressions.

Each of these looks like a loop over rows, but what a row's state depends on is always one earlier row: the last that sets or clears it.  So each is a
``last`` over the rows so far, all windows share the keys of the group, and one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions import geometry as G
from gridmark.operators.asof import asof_forward
from gridmark.operators.windows import filled, ordered, so_far

#: Why an alarm ends, in the order in which reasons count when several hold on one row.
ENDS = ("dead", "team", "p", "stale")


def _reasons(time: Column, p: Column, team: Column, dead: Column, own: Column, seen: Column, low: Column, stale_us: int) -> dict[str, Column]:
    """What ends an alarm of the team ``own`` on a row; ``seen``: when p was last known."""
    return dict(zip(ENDS, (dead, team != own, p < low, p.isNull() & (time - seen > stale_us)), strict=True))


def alarms(df: DataFrame, keys: list[str], tie: list[str], tau: Column | float, *, low: float = 0.8, stale_us: int = 2_000_000) -> DataFrame:
    """(keys, team, start_us, end_us, ended_by): alarms with hysteresis on the series (ts_us, p, team, dead) of each group.

    A row with p above ``tau``, a team, and the ball not dead sets the alarm to its team.  Death, p below ``low * tau``, or p unknown for more than
    ``stale_us`` clears it, as does a row of another team; a row may end one alarm and start the next.  What hasn't ended, ends as ``period`` on the last row.

    The last setting or clearing row so far decides, unless a row of another team came after it.
    """
    tau = F.lit(tau) if isinstance(tau, float) else tau
    w = ordered(keys, "ts_us", *tie)
    dead, floor = F.coalesce("dead", F.lit(False)), F.lit(low) * tau
    rows = df.withColumns({"_n": F.row_number().over(w), "_seen": filled(F.when(F.col("p").isNotNull(), F.col("ts_us")), w), "_floor": floor, "_dead": dead})
    time, p, team = F.col("ts_us"), F.col("p"), F.col("team")
    sets = ~F.col("_dead") & (p > tau) & team.isNotNull()
    clears = F.col("_dead") | (p < F.col("_floor")) | (p.isNull() & (time - F.col("_seen") > stale_us))
    rows = rows.withColumn("_mark", filled(F.when(F.coalesce(sets, F.lit(False)), F.struct("_n", team.alias("team"))).when(F.coalesce(clears, F.lit(False)), F.struct("_n", F.lit(None).cast("string").alias("team"))), w))
    rows = rows.withColumn("_other", F.max(F.when(team != F.col("_mark.team"), F.col("_n"))).over(so_far(w)))
    rows = rows.withColumn("_on", F.when(F.coalesce(F.col("_other") < F.col("_mark._n"), F.lit(True)), F.col("_mark.team")))
    rows = rows.withColumns({"_was": F.lag("_on").over(w), "_last": F.lead("_n").over(w).isNull()})
    begins = F.col("_on").isNotNull() & ~F.col("_on").eqNullSafe(F.col("_was"))
    turns = rows.withColumn("_begins", begins).where(F.col("_begins") | (F.col("_was").isNotNull() & F.col("_on").isNull()) | F.col("_last"))
    turns = turns.withColumn("_next", F.lead(F.struct("ts_us", "p", "team", "_dead", "_seen", "_floor")).over(w))
    then = {c: F.col(f"_next.{c}") for c in ("ts_us", "p", "team", "_dead", "_seen", "_floor")}
    why = F.lit("period")
    for name, holds in reversed(_reasons(then["ts_us"], then["p"], then["team"], then["_dead"], F.col("_on"), then["_seen"], then["_floor"], stale_us).items()):
        why = F.when(holds, name).otherwise(why)
    return turns.where("_begins").select(*keys, F.col("_on").alias("team"), F.col("ts_us").alias("start_us"), F.coalesce(then["ts_us"], F.col("ts_us")).alias("end_us"), why.alias("ended_by"))


class AlarmSteps:
    """``alarms`` for a stream: the open alarm is (team, start, when p was last known)."""

    def __init__(self, tau: float, low: float = 0.8, stale_us: int = 2_000_000) -> None:
        self.tau, self.floor, self.stale_us, self.open, self.at = tau, low * tau, stale_us, None, None

    def closed(self, at: int, why: str) -> list[dict]:
        (team, start, _), self.open = self.open, None
        return [{"team": team, "start_us": start, "end_us": at, "ended_by": why}]

    def step(self, row: dict) -> list[dict]:
        self.at, p, out = row["ts_us"], row["p"], []
        known = p is not None
        if self.open:
            own, start, seen = self.open
            seen = self.at if known else seen
            holds = (row["dead"], row["team"] not in (None, own), known and p < self.floor, self.at - seen > self.stale_us)
            why = next((name for name, h in zip(ENDS, holds, strict=True) if h), None)
            if why:
                out = self.closed(self.at, why)
            else:
                self.open = [own, start, seen]
        if not self.open and known and p > self.tau and row["team"] and not row["dead"]:
            self.open = [row["team"], self.at, self.at]
        return out

    def end(self) -> list[dict]:
        return self.closed(self.at, "period") if self.open else []


def team_hysteresis(df: DataFrame, keys: list[str], tick: str, p: str, *, high: float = 0.75, low: float = 0.25, fallback: str | None = None) -> DataFrame:
    """(keys, tick, smoothed): home from ``high``, away up to ``low``, else the team before; a skipped tick forgets it.

    A row without p takes ``fallback`` if it has one.  With nothing to keep, p of 0.5 or more is home.
    """
    w = ordered(keys, tick)
    rows = df.withColumn("_seg", F.col(tick) - F.row_number().over(w))
    inside = ordered([*keys, "_seg"], tick)
    other = F.col(fallback) if fallback else F.lit(None).cast("string")
    says = F.col(p).isNotNull() | other.isNotNull()
    first = F.coalesce(F.max(says.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    decided = F.when(F.col(p).isNull(), other).when(F.col(p) >= high, "home").when(F.col(p) <= low, "away").when(first, F.when(F.col(p) >= 0.5, "home").otherwise("away"))
    return rows.select(*keys, tick, filled(decided, inside).alias("smoothed"))


def smoothed(df: DataFrame, keys: list[str], tick: str, p: str, rule: str, fallback: str, margin: Column, dwell: Column, hold: Column) -> DataFrame:
    """``df`` with ``smoothed``: the team after a margin, a dwell and a hold, which may be columns, so that a sweep is one job with them among ``keys``.

    A row decides for home from 0.5 + margin, for away up to 0.5 - margin; ``dwell`` decisive rows in a row (one at least) change the team.  A row without p, or marked
    ``fallback``, shows the rule's team and, unless ``hold``, sets it; with hold it keeps the model's last team.  The first row that knows anything sets the team,
    a model row by 0.5 alone.  So the team is what the last setting row set: the row at which a run of decisive rows reaches the dwell, or a fallback row.
    """
    w = ordered(keys, tick)
    score = F.when(~F.coalesce(F.col(fallback), F.lit(False)), F.col(p))
    says = F.when(score >= 0.5 + margin, "home").when(score <= 0.5 - margin, "away")
    rows = df.withColumns({"_p": score, "_says": says})
    rows = rows.withColumns({"_n": F.row_number().over(w), "_turns": ~F.col("_says").eqNullSafe(F.lag("_says").over(w)) | (F.row_number().over(w) == 1)})
    run = F.col("_n") - filled(F.when(F.col("_turns"), F.col("_n")), w) + 1
    any_before = F.coalesce(F.max((F.col("_p").isNotNull() | F.col(rule).isNotNull()).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    first = F.when(F.col("_p").isNotNull(), F.coalesce("_says", F.when(F.col("_p") >= 0.5, "home").otherwise("away"))).otherwise(F.col(rule))
    later = F.when(F.col("_p").isNotNull(), F.when(F.col("_says").isNotNull() & (run >= F.greatest(dwell, F.lit(1))), F.col("_says"))).when(~hold, F.col(rule))
    rows = rows.withColumn("_sets", F.when(any_before, later).otherwise(first))
    now = filled(F.col("_sets"), w)
    return rows.withColumn("smoothed", F.when(F.col("_p").isNotNull() | (hold & now.isNotNull()), now).otherwise(F.col(rule))).drop("_p", "_says", "_n", "_turns", "_sets")


def smoothing_sweep(df: DataFrame, keys: list[str], tick: str, p: str, rule: str, fallback: str, truth: str, positive: str, margins: list[float], dwells: list[int], young: int = 30) -> DataFrame:
    """(margin, dwell, hold, ratios, churn, pass) of every configuration in one job: the disagreement with ``truth`` against that of the rule.

    ``overall``, ``first`` (ticks up to ``young`` after truth changed) and ``positive`` are ratios of disagreeing ticks, ``late`` is the difference of their shares on the other
    ticks, ``churn`` the ratio of changes to truth's.
    """
    w = ordered(keys, tick)
    turn = F.when(~F.col(truth).eqNullSafe(F.lag(truth).over(w)), F.col(tick))
    base = df.withColumn("_age", F.col(tick) - filled(turn, w))
    each = base.withColumns({"margin": F.explode(F.array(*map(F.lit, margins)))}).withColumn("dwell", F.explode(F.array(*map(F.lit, dwells)))).withColumn("hold", F.explode(F.array(F.lit(False), F.lit(True))))
    config = ["margin", "dwell", "hold"]
    rows = smoothed(each, [*config, *keys], tick, p, rule, fallback, F.col("margin"), F.col("dwell"), F.col("hold"))
    own = ordered([*config, *keys], tick)
    known = F.col(truth).isNotNull()
    wrong = {"_r": known & ~F.col(rule).eqNullSafe(F.col(truth)), "_l": known & ~F.col("smoothed").eqNullSafe(F.col(truth))}
    turns = {f"_t_{c}": F.coalesce(F.col(c) != F.last(c, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) for c in ("smoothed", truth)}
    rows = rows.withColumns(wrong).withColumns(turns)
    late = known & (F.col("_age") > young)
    sums = [F.count_if(late).alias("n_late")]
    for side in ("_r", "_l"):
        bad = F.col(side)
        sums += [F.count_if(bad).alias(f"all{side}"), F.count_if(bad & (F.col("_age") <= young)).alias(f"first{side}"), F.count_if(bad & F.col(positive)).alias(f"pos{side}"), F.count_if(bad & late).alias(f"late{side}")]
    by = rows.groupBy(*config).agg(*sums, F.count_if("_t_smoothed").alias("churn_l"), F.count_if(f"_t_{truth}").alias("churn_r"))
    out = by.select(*config, F.try_divide("all_l", "all_r").alias("overall"), F.try_divide("first_l", "first_r").alias("first"), F.try_divide("pos_l", "pos_r").alias("positive"), F.try_divide(F.col("late_l") - F.col("late_r"), F.col("n_late")).alias("late"), F.try_divide("churn_l", "churn_r").alias("churn"))
    # The bars of the sweep.
    return out.withColumn("passes", (F.col("overall") <= 0.9) & (F.col("first") <= 0.85) & (F.col("positive") <= 1) & (F.col("late") <= 0.01) & (F.col("churn") <= 1.25))


def candidates(objects: DataFrame, keys: list[str], frame: str, *, reach: float = 1.5, most_height: float = 1.0) -> DataFrame:
    """(keys, frame, x, y, candidate, candidate_team): the visible ball of each frame, and the nearest visible player or keeper within ``reach`` of it.

    No one reaches a ball at ``most_height`` or higher.  Ties go to the lesser object_id; of several balls the one of the least object_id counts.
    """
    seen = objects.where(F.col("visible") & F.col("x").isNotNull())
    ball = seen.where("object_type = 'ball'").groupBy(*keys, frame).agg(F.min_by(F.struct("x", "y", "z"), "object_id").alias("ball"))
    player = seen.where(F.col("object_type").isin("player", "goalkeeper")).select(*keys, frame, "object_id", "team", F.col("x").alias("px"), F.col("y").alias("py"))
    d = F.hypot(F.col("px") - F.col("ball.x"), F.col("py") - F.col("ball.y"))
    near = ball.join(player, [*keys, frame]).withColumn("d", d).where((F.col("d") <= reach) & F.coalesce(F.col("ball.z") < most_height, F.lit(True)))
    best = near.groupBy(*keys, frame).agg(F.min(F.struct("d", "object_id", "team")).alias("best"))
    return ball.join(best, [*keys, frame], "left").select(*keys, frame, "ball.x", "ball.y", F.col("best.object_id").alias("candidate"), F.col("best.team").alias("candidate_team"))


def carried(
    df: DataFrame, keys: list[str], tie: list[str], *, take_us: int = 300_000, keep_us: int = 500_000, blind_us: int = 2_000_000, window_us: int = 200_000, slow: float = 0.5, kick: float = 3.0,
    spot_us: int = 1_000_000, rest_us: int = 1_000_000, team_us: int | None = None,
) -> DataFrame:
    """``df`` with ``carrier``, ``possession``, ``ball_state`` and the trace ``streak_from``, ``ball_out``, from its ball (x, y; null if unseen) and candidate.

    The groups of ``keys`` (match and period) are independent.  A candidate who stays the candidate for ``take_us`` carries the ball; a ball unseen for more than
    ``keep_us`` ends that, another candidate at once, and nobody carries a ball that is out.  Possession is the last carrier's team, or with ``team_us`` the team
    whose players were candidates for so long.  Speed is measured between the first and the last sighting of the trailing ``window_us``, if at least half of it
    lies between them.  The ball dies when out, or when slower than ``slow`` for ``spot_us`` at a restart spot or ``rest_us`` anywhere outside the penalty areas; it
    lives again from ``kick``.  Unseen for more than ``blind_us`` its state is null.
    """
    w = ordered(keys, "ts_us", *tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    time, x, y = F.col("ts_us"), F.col("x"), F.col("y")
    seen = x.isNotNull() & y.isNotNull()
    out = seen & G.is_out(x, y)
    rows = df.withColumns({"_seen": seen, "_at": filled(F.when(seen, time), w), "ball_out": out})
    lost = ~F.col("_seen") & (F.coalesce(time - F.col("_at") > keep_us, F.lit(True)))
    free = F.col("_seen") & ~F.col("ball_out")
    rows = rows.withColumns({"_counts": F.col("_seen") | lost, "_who": F.when(free, F.col("candidate")), "_side": F.when(free, F.col("candidate_team"))})

    def streak(value: str) -> dict[str, Column]:
        """When the value of the rows that count last changed, and what the candidate's team was then."""
        old = F.last(F.when(F.col("_counts"), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(before)
        return F.col("_counts") & ~F.coalesce(old["v"].eqNullSafe(F.col(value)) & old.isNotNull(), F.lit(False))

    rows = rows.withColumns({"_who_turns": streak("_who"), "_side_turns": streak("_side")})
    rows = rows.withColumns({"_streak": filled(F.when(F.col("_who_turns"), F.struct(time.alias("t"), F.col("_side").alias("team"))), w), "_side_from": filled(F.when(F.col("_side_turns"), time), w)})
    taken = F.when(F.col("_counts"), F.struct(F.when(F.col("_who").isNotNull() & (time - F.col("_streak.t") >= take_us), F.col("_who")).alias("who")))
    rows = rows.withColumns({"_taken": taken, "carrier": filled(taken, w)["who"], "streak_from": F.when(F.col("_who").isNotNull(), F.col("_streak.t"))})
    gains = F.when(F.col("_taken.who").isNotNull(), F.col("_streak.team"))
    if team_us is not None:
        gains = F.coalesce(F.when(F.col("_side").isNotNull() & (time - F.col("_side_from") >= team_us), F.col("_side")), gains)
    rows = rows.withColumn("possession", filled(gains, w))

    # The first sighting of the window is the next one from its start on: a lookup, not a frame that is read for each row.
    sightings = rows.where("_seen").select(*keys, "ts_us", "x", "y", *tie)
    rows = asof_forward(rows.withColumn("_from", time - window_us), sightings, keys, "_from", "ts_us", {"ts_us": "_t0", "x": "_x0", "y": "_y0"}, right_order=tie)
    since = F.when(F.col("_t0") <= time, F.struct(F.col("_t0").alias("t"), F.col("_x0").alias("x"), F.col("_y0").alias("y")))
    rows = rows.withColumn("_since", since)
    apart = time - F.col("_since.t")
    rows = rows.withColumn("_speed", F.when(F.col("_seen") & ~F.col("ball_out") & (apart > 0) & (apart >= window_us / 2), F.hypot(x - F.col("_since.x"), y - F.col("_since.y")) / (apart / 1e6)))
    rows = rows.withColumn("_slow", F.when(F.col("ball_out"), False).when(F.col("_speed").isNotNull(), F.col("_speed") < slow))
    was_slow = F.last("_slow", ignorenulls=True).over(before)
    rows = rows.withColumn("_still_from", filled(F.when(F.col("_slow") & ~F.coalesce(was_slow, F.lit(False)), time), w))
    still = time - F.col("_still_from")
    rests = F.col("_slow") & ((G.at_restart_spot(x, y) & (still >= spot_us)) | (~G.in_penalty_area(x, y) & (still >= rest_us)))
    dead = filled(F.when(F.col("ball_out") | F.coalesce(rests, F.lit(False)), True).when(F.col("_speed") >= kick, False), w)
    state = F.when(time - F.col("_at") <= blind_us, F.when(F.coalesce(dead, F.lit(False)), "dead").otherwise("alive"))
    rows = rows.withColumn("ball_state", state)
    return rows.select(*df.columns, "carrier", "possession", "ball_state", "streak_from", "ball_out")


def without_orphans(states: DataFrame, objects: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """``states`` with a null carrier where the objects of the frame don't have it, as a filled-in table must not name it."""
    there = objects.select(*keys, frame, F.col("object_id").alias("carrier"), F.lit(True).alias("_there")).distinct()
    return states.join(there, [*keys, frame, "carrier"], "left").withColumn("carrier", F.when(F.col("_there"), F.col("carrier"))).select(*states.columns)
