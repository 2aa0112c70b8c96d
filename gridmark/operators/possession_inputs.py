"""Inputs of the possession model: 53 columns at each tick of the 10 Hz grid, and the same 0.5 and 1 second before.

All of it is causal and in the home frame (X grows towards the goal that home attacks).  Objects meet their frame's ball in one window and become one row for each frame;
frames and ticks then share one exchange by (match, period): a tick takes the latest frame at or before it, and looks back by time inside its *segment*, the
stretch of frames without a gap of more than 1.5 native intervals.  Shares of time are differences of running integrals, read at the tick and at the start
of its window.  Lags are one ``lag`` of a struct of all columns, kept only inside a run of ticks without a gap.

Frames: (match_id, frame_id, period, timestamp_s, home_attacks_positive_x, native_fps); objects: (match_id, frame_id, object_id, object_type, team, x, y, visible,
interpolated).  Missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions.scalars import team_code
from gridmark.operators import features, possession
from gridmark.operators.windows import filled, ordered, so_far

GRID_US = 100_000
REACH_M = 1.5
TIE_M = 1e-9
HOLD_US = 1_000_000
GAP_US = 500_000
STILL = 0.5
SIDES = (("home", 1.0), ("away", -1.0))
WINDOWS = (("05", 500_000), ("1", 1_000_000))
SPEEDS = (("02", 200_000), ("1", 1_000_000))
AHEAD = (("03", 0.3), ("05", 0.5))
SHAPES = ("centroid_x", "mean_vx_own", "past_halfway", "max_x", "min_x", "visible_n")
# The names of the columns in their order, a data contract.
BLOCK = [
    "rule_team", "rule_carrier_age_s", "rule_candidate_team", "ball_seen", "ball_age_s", "ball_x", "ball_y", "ball_vx_02", "ball_vy_02", "ball_vx_1", "ball_vy_1", "near_home_m", "near_away_m",
    *(f"nearest_{t}_{w}_{r}" for t, _ in SIDES for w, _ in WINDOWS for r in ("any", "r15")),
    "home_centroid_x", "away_centroid_x", "home_mean_vx_own", "away_mean_vx_own", "home_past_halfway", "away_past_halfway", "home_max_x", "home_min_x", "away_max_x", "away_min_x", "home_visible_n", "away_visible_n",
    *(f"diff_{s}" for s in SHAPES),
    "heads_home_03_m", "heads_home_05_m", "heads_away_03_m", "heads_away_05_m", "heads_home_angle", "heads_away_angle", "last_contact_team", "last_contact_age_s",
    "home_within5", "home_within10", "away_within5", "away_within10", "view_min_x", "view_max_x",
]
LAGS = (("lag05", 5), ("lag1", 10))
COLUMNS = BLOCK + [f"{c}_{name}" for name, _ in LAGS for c in BLOCK]
SERIES = ["match_id", "period"]
FRAME = [*SERIES, "frame_id"]


def native(frames: DataFrame) -> DataFrame:
    """(match_id, period, frame_id, ts_us, d, tol, n, seg): frames in order of time with their number and segment; ``d`` turns x into X."""
    w = ordered(SERIES, "ts_us", "frame_id")
    rate = F.when(F.col("native_fps") > 0, F.round(1.5e6 / F.col("native_fps"))).otherwise(F.raise_error(F.lit("native_fps must be a positive declared rate")).cast("double"))
    side = F.when(F.col("home_attacks_positive_x"), 1.0).when(~F.col("home_attacks_positive_x"), -1.0).otherwise(F.raise_error(F.lit("home_attacks_positive_x is null on some frames")).cast("double"))
    rows = frames.select(*SERIES, "frame_id", F.round(F.col("timestamp_s") * 1e6).cast("long").alias("ts_us"), side.alias("d"), rate.cast("long").alias("tol"))
    starts = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) > F.col("tol"), F.lit(True)).cast("int")
    return rows.withColumns({"n": F.row_number().over(w), "_starts": starts}).withColumn("seg", F.sum("_starts").over(so_far(w))).drop("_starts")


def usable(objects: DataFrame) -> DataFrame:
    """Balls, players and keepers that are visible, not interpolated, with finite places."""
    sound = [F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in ("x", "y")]
    kinds = F.col("object_type").isin("ball", "player", "goalkeeper")
    return objects.where(kinds & F.coalesce("visible", F.lit(False)) & ~F.coalesce("interpolated", F.lit(False)) & sound[0] & sound[1]).select("match_id", "frame_id", "object_id", "object_type", "team", "x", "y")


def _with_velocity(rows: DataFrame) -> DataFrame:
    """Objects with ``vx``: from the first sighting of the last 0.2 s of an unbroken track (each frame, one segment, one team), if 0.1 s lie between."""
    track = ordered([*SERIES, "object_id"], "n")
    label = F.coalesce("team", F.lit("?"))
    breaks = F.coalesce((F.col("n") - F.lag("n").over(track) != 1) | (F.col("seg") != F.lag("seg").over(track)) | (label != F.lag(label).over(track)), F.lit(True)).cast("int")
    rows = rows.withColumn("_breaks", breaks).withColumn("_track", F.sum("_breaks").over(so_far(track)))
    recent = Window.partitionBy(*SERIES, "object_id", "_track").orderBy("ts_us").rangeBetween(-200_000, 0)
    rows = rows.withColumn("_first", F.first(F.struct("X", "ts_us")).over(recent))
    apart = F.col("ts_us") - F.col("_first.ts_us")
    return rows.withColumn("vx", F.when(apart >= 100_000, (F.col("X") - F.col("_first.X")) / apart * 1e6)).drop("_breaks", "_track", "_first")


def per_frame(nat: DataFrame, objects: DataFrame) -> DataFrame:
    """One row for each frame with usable objects: its ball, nearest, shape, pressure, view and contact values, and the players as an array."""
    rows = usable(objects).join(nat, ["match_id", "frame_id"])
    rows = rows.select(*FRAME, "n", "seg", "ts_us", "object_id", "object_type", "team", "x", "y", (F.col("d") * F.col("x")).alias("X_"), (F.col("d") * F.col("y")).alias("Y_")).withColumnsRenamed({"x": "raw_x", "y": "raw_y"}).withColumnsRenamed({"X_": "X", "Y_": "Y"})
    rows = _with_velocity(rows)
    here = Window.partitionBy(*FRAME)
    is_ball = F.col("object_type") == "ball"
    rows = rows.withColumn("ball", F.min(F.when(is_ball, F.struct("object_id", "raw_x", "raw_y", "X", "Y"))).over(here))
    rows = rows.withColumn("dist", F.when(~is_ball, F.hypot(F.col("X") - F.col("ball.X"), F.col("Y") - F.col("ball.Y"))))
    rows = rows.withColumn("dmin", F.min("dist").over(here))
    seen_ball = F.first("ball")
    out: dict[str, Column] = {"ball": seen_ball, "players_n": F.count_if(~is_ball)}
    for team, s in SIDES:
        own = ~is_ball & (F.col("team") == team)
        outfield = own & (F.col("object_type") == "player")
        first = F.min(F.when(own & F.col("dist").isNotNull(), F.struct("dist", "object_id", "X", "Y")))
        out |= {
            f"near_{team}_m": F.min(F.when(own, F.col("dist"))), f"{team}_centroid_x": F.avg(F.when(own, F.col("X"))), f"{team}_past_halfway": F.count_if(outfield & (s * F.col("X") > 0)).cast("double"),
            f"{team}_max_x": F.max(F.when(outfield, F.col("X"))), f"{team}_min_x": F.min(F.when(outfield, F.col("X"))), f"{team}_visible_n": F.count_if(own).cast("double"),
            f"{team}_within5": F.when(seen_ball.isNotNull(), F.count_if(own & (F.col("dist") <= 5)).cast("double")), f"{team}_within10": F.when(seen_ball.isNotNull(), F.count_if(own & (F.col("dist") <= 10)).cast("double")),
            f"{team}_mean_vx_own": F.avg(F.when(own, -s * F.col("vx"))), f"_{team}_nearest": first,
        }
    in_view = ~is_ball | (F.col("object_id") == F.col("ball.object_id"))  # of several balls the one that counts
    out |= {"view_min_x": F.min(F.when(in_view, F.col("X"))), "view_max_x": F.max(F.when(in_view, F.col("X")))}
    out |= {"candidate": F.min(F.when(F.col("dist") <= REACH_M, F.struct("dist", "object_id", "team"))), "dmin": F.first("dmin"), "_labels": F.collect_set(F.when(F.col("dist") <= F.col("dmin") + TIE_M, F.coalesce("team", F.lit("?"))))}
    out["players"] = F.collect_list(F.when(~is_ball & F.col("team").isin("home", "away"), F.struct("team", "X", "Y")))
    return rows.groupBy(*FRAME).agg(*[c.alias(name) for name, c in out.items()])


def series(nat: DataFrame, objects: DataFrame) -> DataFrame:
    """Every frame with its ``per_frame`` values, the rule's state and, inside its segment, what later ticks read: last sighting and contact, holds, running integrals."""
    rows = nat.join(per_frame(nat, objects), FRAME, "left")
    rows = rows.withColumns({"x": F.col("ball.raw_x"), "y": F.col("ball.raw_y"), "candidate_team": F.col("candidate.team"), "candidate": F.col("candidate.object_id")})
    rows = possession.carried(rows, SERIES, ["frame_id"])
    w = ordered(SERIES, "ts_us", "frame_id")
    held_at = filled(F.when(F.col("carrier").isNotNull(), F.col("ts_us")), w)
    rows = rows.withColumns({"rule_team": F.when(F.col("possession").isNotNull(), team_code(F.col("possession")).cast("double")), "rule_carrier_age_s": (F.col("ts_us") - held_at) / 1e6})
    rows = rows.withColumn("rule_candidate_team", F.when(F.col("candidate").isNotNull() & ~F.coalesce("ball_out", F.lit(False)), team_code(F.col("candidate_team")).cast("double")))
    zeros = [f"{t}_{c}" for t, _ in SIDES for c in ("past_halfway", "visible_n")] + ["players_n"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})

    s = ordered([*SERIES, "seg"], "ts_us", "frame_id")
    close = F.col("dmin") <= REACH_M
    share = {t: F.when(F.array_contains("_labels", t), 1.0 / F.size("_labels")).otherwise(F.lit(0.0)) for t, _ in SIDES}
    weights = {f"w_{t}_any": F.coalesce(share[t], F.lit(0.0)) for t, _ in SIDES} | {f"w_{t}_r15": F.when(close, share[t]).otherwise(F.lit(0.0)) for t, _ in SIDES}
    contact = F.when(close, F.when(F.size("_labels") == 1, team_code(F.get("_labels", F.lit(0))).cast("double")).otherwise(F.lit(0.0)))
    sighted = F.when(F.col("ball").isNotNull(), F.struct(F.col("ts_us").alias("t"), F.col("ball.X").alias("X"), F.col("ball.Y").alias("Y")))
    rows = rows.withColumns({**weights, "hold": F.least(F.coalesce(F.lead("ts_us").over(s) - F.col("ts_us"), F.col("tol")), F.col("tol")), "seg_from": F.first("ts_us").over(so_far(s)), "sighted": sighted, "contact": filled(F.when(contact.isNotNull(), F.struct(F.col("ts_us").alias("t"), contact.alias("team"))), s)})
    before = s.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col("ts_us") - F.last("sighted", ignorenulls=True).over(before)["t"] > GAP_US, F.lit(False))
    rows = rows.withColumns({"_gap": F.when(F.col("sighted").isNotNull(), gap.cast("int")), **{f"sum_{k}": F.coalesce(F.sum(F.col(k) * F.col("hold")).over(before), F.lit(0.0)) for k in weights}})
    rows = rows.withColumn("sighted", F.when(F.col("sighted").isNotNull(), F.col("sighted").withField("gaps", F.coalesce(F.sum("_gap").over(so_far(s)), F.lit(0)))))
    return rows.withColumn("last_sighted", filled(F.col("sighted"), s))


def ticks(nat: DataFrame) -> DataFrame:
    """(match_id, period, k, t_us): the grid between the first and the last frame of each period."""
    ends = nat.groupBy(*SERIES).agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    first, last = F.ceil(F.col("a") / GRID_US), F.floor(F.col("b") / GRID_US)
    return ends.where(first <= last).select(*SERIES, F.explode(F.sequence(first, last)).alias("k")).withColumn("t_us", F.col("k") * GRID_US)


READ = ["w_home_any", "w_away_any", "w_home_r15", "w_away_r15"]
KEPT = ["frame_id", "ts_us", "tol", "seg", "seg_from", "hold", "sighted", "last_sighted", "contact", "rule_team", "rule_carrier_age_s", "rule_candidate_team", "possession", "carrier", "ball_state", *READ, *[f"sum_{k}" for k in READ]]


def _on_grid(nat: DataFrame, rows: DataFrame) -> DataFrame:
    """Ticks that have a frame at most 1.5 native intervals old, with it as ``f``; its segment's frames as of 0.2, 0.5 and 1 s before the tick for what looks back."""
    f = rows.select(*SERIES, F.col("ts_us").alias("_t"), F.lit(0).alias("_side"), F.col("frame_id").alias("_tie"), F.struct(*KEPT).alias("f"))
    t = ticks(nat).select(*SERIES, F.col("t_us").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), "k")
    both = f.unionByName(t, allowMissingColumns=True)
    latest = F.last("f", ignorenulls=True).over(so_far(ordered(SERIES, "_t", "_side", "_tie")))
    both = both.withColumn("_u", latest)
    # A tick without a fresh frame goes before it can join its segment.
    both = both.where("k IS NULL OR _t - _u.ts_us <= _u.tol").withColumn("seg", F.coalesce("f.seg", "_u.seg"))
    by_time = Window.partitionBy(*SERIES, "seg").orderBy("_t")
    looks = {f"_since_{name}": F.first("f.sighted", ignorenulls=True).over(by_time.rangeBetween(-w, 0)) for name, w in SPEEDS}
    place = F.when(F.col("f").isNotNull(), F.struct("f.ts_us", "f.frame_id", "f.hold", *[f"f.{k}" for k in READ], *[f"f.sum_{k}" for k in READ]))
    looks |= {f"_edge_{name}": F.max(place).over(by_time.rangeBetween(Window.unboundedPreceding, -w)) for name, w in WINDOWS}
    return both.withColumns(looks).where("k IS NOT NULL").withColumnRenamed("_t", "t_us").drop("f", "_side", "_tie").withColumnRenamed("_u", "f")


def _values(rows: DataFrame) -> dict[str, Column]:
    t, last, now = F.col("t_us"), F.col("f.last_sighted"), F.col("f.sighted")
    age = t - last["t"]
    out = {"ball_seen": now.isNotNull().cast("double"), "ball_age_s": age / 1e6, "ball_x": F.when(age <= HOLD_US, last["X"]), "ball_y": F.when(age <= HOLD_US, last["Y"])}
    for name, w in SPEEDS:
        since = F.col(f"_since_{name}")
        span = now["t"] - since["t"]
        fits = (span >= w // 2) & (span > 0) & (now["gaps"] == since["gaps"])
        out |= {f"ball_v{a.lower()}_{name}": F.when(fits, (now[a] - since[a]) / (span / 1e6)) for a in ("X", "Y")}
    for team, _ in SIDES:
        for name, w in WINDOWS:
            begin = F.greatest(F.col("f.seg_from"), t - w)
            for reach in ("any", "r15"):
                key = f"{team}_{reach}"
                at_t = F.col(f"f.sum_w_{key}") + F.col(f"f.w_{key}") * F.least(t - F.col("f.ts_us"), F.col("f.hold"))
                edge = F.col(f"_edge_{name}")
                at_a = F.coalesce(edge[f"sum_w_{key}"] + edge[f"w_{key}"] * F.least(begin - edge["ts_us"], edge["hold"]), F.lit(0.0))
                out[f"nearest_{team}_{name}_{reach}"] = F.try_divide(at_t - at_a, t - begin)
    out |= {"last_contact_team": F.col("f.contact.team"), "last_contact_age_s": (t - F.col("f.contact.t")) / 1e6}
    return out | {c: F.col(f"f.{c}") for c in ("rule_team", "rule_carrier_age_s", "rule_candidate_team")}


def _least_distance(team: str, x: Column, y: Column) -> Column:
    own = F.filter("players", lambda p: p["team"] == team)
    return F.array_min(F.transform(own, lambda p: F.hypot(p["X"] - x, p["Y"] - y)))


def _heading() -> dict[str, Column]:
    """Where the ball will be against each team's players, and the angle between its way and the team's nearest one."""
    moves = (F.col("ball_seen") == 1) & F.col("ball_vx_02").isNotNull()
    vx, vy, out = F.col("ball_vx_02"), F.col("ball_vy_02"), {}
    speed = F.hypot(vx, vy)
    for team, _ in SIDES:
        for name, h in AHEAD:
            out[f"heads_{team}_{name}_m"] = F.when(moves, _least_distance(team, F.col("ball_x") + h * vx, F.col("ball_y") + h * vy))
        dx, dy = F.col(f"_{team}_nearest.X") - F.col("ball_x"), F.col(f"_{team}_nearest.Y") - F.col("ball_y")
        cosine = F.try_divide(vx * dx + vy * dy, speed * F.hypot(dx, dy))
        out[f"heads_{team}_angle"] = F.when(moves & (speed >= STILL), F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    return out


def lagged(rows: DataFrame, columns: list[str], lags: tuple[tuple[str, int], ...] = LAGS, keys: list[str] = SERIES, tick: str = "k", seg: str = "seg") -> DataFrame:
    """``rows`` with ``<column>_<name>``: the columns so many ticks before, null where the run of ticks (no gap, one segment) began later."""
    w = ordered(keys, tick)
    breaks = F.coalesce((F.col(tick) - F.lag(tick).over(w) != 1) | (F.col(seg) != F.lag(seg).over(w)), F.lit(True))
    rows = rows.withColumn("_run_k", filled(F.when(breaks, F.col(tick)), w))
    rows = rows.withColumns({f"_{name}": F.when(F.col(tick) - n >= F.col("_run_k"), F.lag(F.struct(*columns), n).over(w)) for name, n in lags})
    return rows.withColumns({f"{c}_{name}": F.col(f"_{name}.{c}") for name, _ in lags for c in columns}).drop("_run_k", *[f"_{name}" for name, _ in lags])


def possession_inputs(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """(match_id, period, k, t_s, frame_id, players_n, the 159 ``COLUMNS`` as float) for every match at once."""
    nat = native(frames)
    per = series(nat, objects)
    grid = _on_grid(nat, per)
    rows = grid.select(*SERIES, "k", "t_us", "seg", F.col("f.frame_id").alias("frame_id"), *[c.alias(n) for n, c in _values(grid).items()])
    frame_columns = [c for c in BLOCK if c.startswith(("near_", "home_", "away_", "view_"))]
    rows = rows.join(per.select(*FRAME, "players_n", "players", "_home_nearest", "_away_nearest", *frame_columns), FRAME)
    rows = rows.withColumns(_heading()).withColumns({f"diff_{s}": F.col(f"home_{s}") - F.col(f"away_{s}") for s in SHAPES})
    rows = lagged(rows, BLOCK)
    return rows.select(*SERIES, "k", (F.col("t_us") / 1e6).alias("t_s"), "frame_id", "players_n", *[F.col(c).cast("float").alias(c) for c in COLUMNS])


def rule_grid(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """(match_id, period, k, frame_id, rule_possession_team, ball_carrier_id, ball_state, carrier_age_s): the rule's state at each tick, also where the model has none."""
    nat = native(frames)
    g = _on_grid(nat, series(nat, objects))
    return g.select(*SERIES, "k", F.col("f.frame_id").alias("frame_id"), F.col("f.possession").alias("rule_possession_team"), F.col("f.carrier").alias("ball_carrier_id"), F.col("f.ball_state").alias("ball_state"), F.col("f.rule_carrier_age_s").alias("carrier_age_s"))


def mirrored_inputs(inputs: DataFrame) -> DataFrame:
    """The inputs of the mirrored scene: teams changed and X turned around.  Twice is the identity."""
    suffixes = ["", *[f"_{name}" for name, _ in LAGS]]
    turn = ["rule_team", "rule_candidate_team", "last_contact_team", "ball_x", "ball_vx_02", "ball_vx_1", *[f"{t}_{c}" for t, _ in SIDES for c in ("centroid_x", "max_x", "min_x")], "view_min_x", "view_max_x"]
    swap = [("near_home_m", "near_away_m"), *[(f"nearest_home_{w}_{r}", f"nearest_away_{w}_{r}") for w, _ in WINDOWS for r in ("any", "r15")]]
    swap += [(f"home_{c}", f"away_{c}") for c in ("centroid_x", "mean_vx_own", "past_halfway", "visible_n", "within5", "within10")] + [("home_max_x", "away_min_x"), ("home_min_x", "away_max_x"), ("view_min_x", "view_max_x")]
    swap += [(f"heads_home_{c}", f"heads_away_{c}") for c in ("03_m", "05_m", "angle")]
    diffs = {f"diff_{s}": (f"home_{s}", f"away_{s}") for s in SHAPES}
    return features.mirrored(inputs, [c + x for x in suffixes for c in turn], [(a + x, b + x) for x in suffixes for a, b in swap], {d + x: (a + x, b + x) for x in suffixes for d, (a, b) in diffs.items()})
