"""Feature bundles of a match on its grid.  Everything here is causal: no window reaches past the row itself.

Frames have (match_id, period, k, seg, possession_team, flipped); objects (match_id, period, k, object_id, object_type, team, x, y, z, visible).  History is
rotated by the row's own sign: values that depend on the direction are computed for both ends and picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions import geometry as G

ROW = ["match_id", "period", "k"]
SERIES = ["match_id", "period", "seg"]
TICKS = 10


def gridded(frames: DataFrame) -> DataFrame:
    """``frames`` with ``seg``: a new one where a tick is missing."""
    w = Window.partitionBy("match_id", "period").orderBy("k")
    start = F.when(F.col("k") - F.lag("k").over(w) == 1, 0).otherwise(1)
    return frames.withColumn("_s", start).withColumn("seg", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def sign() -> Column:
    return F.when(F.col("flipped"), -1.0).otherwise(1.0)


def held_ball(frames: DataFrame, objects: DataFrame, most_age: int = TICKS) -> DataFrame:
    """``frames`` with the ball last seen in the segment, at most a second ago: bx, by, bz, age_s, fresh."""
    ball = objects.where("object_type = 'ball' AND visible AND x IS NOT NULL").groupBy(*ROW).agg(F.min_by(F.struct("x", "y", "z"), "object_id").alias("b"))
    rows = frames.join(ball, ROW, "left")
    w = Window.partitionBy(*SERIES).orderBy("k")
    last = F.last(F.when(F.col("b").isNotNull(), F.struct("b", "k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_last", last).withColumn("_ok", F.col("k") - F.col("_last.k") <= most_age)
    held = {"bx": "_last.b.x", "by": "_last.b.y", "bz": "_last.b.z"}
    return rows.withColumns({n: F.when(F.col("_ok"), F.col(c)) for n, c in held.items()} | {"age_s": F.when(F.col("_ok"), (F.col("k") - F.col("_last.k")) / TICKS), "fresh": F.col("b").isNotNull()}).drop("b", "_last", "_ok")


def ball_features(frames: DataFrame) -> DataFrame:
    """The ball bundle on ``held_ball`` frames: position, distance, angle, age, speed, closing speed, box, changes and time in the final third."""
    w = Window.partitionBy(*SERIES).orderBy("k")
    back = 5
    both = F.col("fresh") & F.lag("fresh", back).over(w)
    rows = frames.withColumns({"_vx": F.when(both, (F.col("bx") - F.lag("bx", back).over(w)) / (back / TICKS)), "_vy": F.when(both, (F.col("by") - F.lag("by", back).over(w)) / (back / TICKS))})
    x, y, s = F.col("bx") * sign(), F.col("by") * sign(), sign()
    distance = G.goal_distance(x, y)
    out = {"ball_x": x, "ball_y": y, "ball_z": F.col("bz"), "ball_dist": distance, "ball_angle": G.goal_angle(x, y), "ball_age_s": F.col("age_s"), "ball_speed": F.hypot("_vx", "_vy"), "ball_vgoal": G.closing_speed(x, y, F.col("_vx") * s, F.col("_vy") * s), "in_box": G.in_box(x, y)}
    for seconds in (1, 3):
        then = F.lag(F.struct("bx", "by"), seconds * TICKS).over(w)
        out[f"dist_change_{seconds}s"] = distance - G.goal_distance(then["bx"] * s, then["by"] * s)
    last5 = w.rowsBetween(-(5 * TICKS - 1), 0)
    right, left = (F.sum(F.when(F.col("bx") * e >= G.THIRD_X, 1).otherwise(0)).over(last5) / TICKS for e in (1, -1))
    out["final_third_s"] = F.when(F.col("flipped"), left).when(~F.col("flipped"), right)
    return rows.withColumns(out).drop("_vx", "_vy")


def possession_seconds(frames: DataFrame) -> DataFrame:
    """``possession_s``: time since the team last changed inside the period; no team is a value too."""
    w = Window.partitionBy("match_id", "period").orderBy("k")
    turn = F.when(~F.col("possession_team").eqNullSafe(F.lag("possession_team").over(w)) | (F.row_number().over(w) == 1), F.col("k"))
    return frames.withColumn("_turn", turn).withColumn("possession_s", (F.col("k") - F.last("_turn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))) / TICKS).drop("_turn")


def player_features(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """Counts, distances and lanes around the held ball: one join of a frame's players to its ball, one aggregation.

    A player's speed is over the five ticks before, inside the frame's segment: a gap in the grid has none.
    """
    players = objects.where("object_type IN ('player', 'goalkeeper') AND visible AND x IS NOT NULL").join(frames.select(*ROW, "seg"), ROW).select(*ROW, "seg", "object_id", "object_type", "team", "x", "y")
    old = players.select("match_id", "period", "seg", (F.col("k") + 5).alias("k"), "object_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    moving = players.join(old, [*ROW, "seg", "object_id"], "left").drop("seg")
    base = frames.where("possession_team IS NOT NULL").select(*ROW, "possession_team", sign().alias("s"), "bx", "by")
    j = moving.join(base, ROW)
    px, py, bx, by = F.col("x") * F.col("s"), F.col("y") * F.col("s"), F.col("bx") * F.col("s"), F.col("by") * F.col("s")
    attack, keeper = F.col("team") == F.col("possession_team"), F.col("object_type") == "goalkeeper"
    j = j.select(*ROW, attack.alias("attack"), keeper.alias("keeper"), "object_id", px.alias("px"), py.alias("py"), F.hypot(px - bx, py - by).alias("d"), G.in_lane(px, py, bx, by).alias("lane"), G.in_box(px, py).alias("box"), bx.alias("bx"), (F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) / 0.5).alias("speed"))
    a, d = F.col("attack"), F.coalesce(~F.col("attack"), F.lit(False))
    field = d & ~F.col("keeper")
    known = F.col("bx").isNotNull()
    made = j.groupBy(*ROW).agg(
        F.count_if(a & F.col("box")).alias("attackers_in_box"), F.count_if(d & F.col("box")).alias("defenders_in_box"), F.count_if(a & (F.col("px") >= G.THIRD_X)).alias("attackers_in_third"),
        F.max(known).alias("_known"), F.count_if(field & F.col("lane")).alias("lane_defenders"), F.count_if(d & (F.col("d") <= 3)).alias("pressure_3m"), F.count_if(d & (F.col("d") <= 6)).alias("pressure_6m"), F.count_if(d & (F.col("px") > F.col("bx"))).alias("goal_side"),
        F.min(F.when(d, F.col("d"))).alias("nearest_defender"), F.max(F.when(field, F.col("px"))).alias("defensive_line"), F.max(F.when(a, F.col("px"))).alias("furthest_attacker"),
        F.min_by(F.when(a, F.struct("object_id", "d", "speed", "px", "py")), F.when(a, F.struct("d", "object_id"))).alias("_carrier"), F.min_by(F.when(d & F.col("keeper"), F.struct("px", "py")), F.when(d & F.col("keeper"), F.col("object_id"))).alias("_keeper"),
    )
    near = ("lane_defenders", "pressure_3m", "pressure_6m", "goal_side", "nearest_defender")
    rows = frames.join(made, ROW, "left")
    out = {c: F.when(F.col("possession_team").isNotNull(), F.coalesce(c, F.lit(0))) for c in ("attackers_in_box", "defenders_in_box", "attackers_in_third")}
    out |= {c: F.when(F.col("bx").isNotNull() & F.col("possession_team").isNotNull(), F.col(c) if c == "nearest_defender" else F.coalesce(c, F.lit(0))) for c in near}
    out |= {"carrier_dist": F.col("_carrier.d"), "carrier_speed": F.col("_carrier.speed"), "carrier_goal_dist": G.goal_distance(F.col("_carrier.px"), F.col("_carrier.py")), "keeper_off_line": G.HALF_LENGTH - F.col("_keeper.px"), "keeper_lateral": F.abs(F.col("_keeper.py")), "beyond_line": F.col("furthest_attacker") - F.col("defensive_line")}
    return rows.withColumns(out).drop("_carrier", "_keeper", "_known")


def lead_features(frames: DataFrame) -> DataFrame:
    """Windowed history of the ball in the row's direction and in its possession: extremes, start, minimum and advance."""
    w = Window.partitionBy(*SERIES).orderBy("k")
    run = Window.partitionBy("match_id", "period", "_run").orderBy("k")
    series = Window.partitionBy("match_id", "period").orderBy("k")
    turn = F.when(~F.col("possession_team").eqNullSafe(F.lag("possession_team").over(series)), 1).otherwise(0)
    rows = frames.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_right": G.goal_distance(F.col("bx"), F.col("by")), "_left": G.goal_distance(-F.col("bx"), -F.col("by"))})
    ends = {}
    for end in ("_right", "_left"):
        for seconds in (2, 5):
            last = w.rowsBetween(-(seconds * TICKS - 1), 0)
            ends |= {f"dist_min_{seconds}s{end}": F.min(end).over(last), f"dist_mean_{seconds}s{end}": F.avg(end).over(last)}
        so_far = run.rowsBetween(Window.unboundedPreceding, 0)
        ends |= {f"start_dist{end}": F.first(end, ignorenulls=True).over(so_far), f"possession_min_dist{end}": F.min(end).over(so_far)}
    rows = rows.withColumns(ends)
    names = sorted({n.removesuffix("_right").removesuffix("_left") for n in ends})
    own = {n: F.when(F.col("flipped"), F.col(f"{n}_left")).when(~F.col("flipped"), F.col(f"{n}_right")) for n in names}
    own["advance"] = own["start_dist"] - F.when(F.col("flipped"), F.col("_left")).when(~F.col("flipped"), F.col("_right"))
    return rows.withColumns(own).drop("_turn", "_run", "_right", "_left", *ends)


def lead_player_features(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """``frames`` with what tells early that an attack builds up: the carrier's way to goal, outfield players near the box, the defensive line and who is beyond it.

    Each is computed for both teams attacking both ends and picked by the row's own team and end; a change is against the same team and end ``n`` ticks ago in the segment.
    """
    p = objects.where("object_type IN ('player', 'goalkeeper') AND visible AND x IS NOT NULL AND team IN ('home', 'away')")
    p = p.join(frames.select(*ROW, "bx", "by"), ROW).withColumns({"field": F.col("object_type") == "player", "d": F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))})
    here, ends = Window.partitionBy(*ROW), (("right", 1.0), ("left", -1.0))
    other = {"home": "away", "away": "home"}
    p = p.withColumns({f"deepest_{t}_{end}": F.max(F.when(F.col("field") & (F.col("team") == t), F.col("x") * e)).over(here) for t in other for end, e in ends})
    sums = []
    for t in other:
        own = F.col("team") == t
        sums.append(F.min_by(F.struct("x", "y"), F.when(own & F.col("d").isNotNull(), F.struct("d", "object_id"))).alias(f"carrier_{t}"))
        for end, e in ends:
            x, line = F.col("x") * e, F.col(f"deepest_{other[t]}_{end}")
            sums += [F.count_if(own & F.col("field") & G.near_box(x, F.col("y"))).alias(f"near_{t}_{end}"), F.first(f"deepest_{t}_{end}").alias(f"deepest_{t}_{end}"), F.count_if(own & F.col("field") & (x > line)).alias(f"past_{t}_{end}")]
    rows = frames.join(p.groupBy(*ROW).agg(*sums), ROW, "left")
    w = Window.partitionBy(*SERIES).orderBy("k")
    values = {}
    for t in other:
        for end, e in ends:
            line, carrier = F.col(f"deepest_{other[t]}_{end}"), F.col(f"carrier_{t}")
            values[t, end] = {
                "carrier_goal_dist": G.goal_distance(carrier["x"] * e, carrier["y"] * e), "att_near_box": F.coalesce(f"near_{t}_{end}", F.lit(0)), "def_near_box": F.coalesce(f"near_{other[t]}_{end}", F.lit(0)),
                "def_line_dist": G.HALF_LENGTH - line, "ball_line_gap": line - F.col("bx") * e, "att_beyond_line": F.when(line.isNotNull(), F.coalesce(f"past_{t}_{end}", F.lit(0))),
            }

    def pick(name: str, back: int = 0) -> Column:
        case = None
        for (t, end), v in values.items():
            value = F.lag(v[name], back).over(w) if back else v[name]
            holds = (F.col("possession_team") == t) & (F.col("flipped") == F.lit(end == "left"))
            case = F.when(holds, value) if case is None else case.when(holds, value)
        return case

    now = {name: pick(name) for name in values["home", "right"]}
    out = {f"carrier_goal_dist_change_{n}s": now["carrier_goal_dist"] - pick("carrier_goal_dist", n * TICKS) for n in (3, 5)}
    out |= {c: now[c] for c in ("att_near_box", "def_near_box", "def_line_dist", "ball_line_gap", "att_beyond_line")}
    out["near_box_diff"] = now["att_near_box"] - now["def_near_box"]
    out |= {f"{c}_change_3s": now[c] - pick(c, 3 * TICKS) for c in ("att_near_box", "def_near_box")}
    out["def_line_change_3s"] = now["def_line_dist"] - pick("def_line_dist", 3 * TICKS)
    return rows.withColumns(out).select(*frames.columns, *out)


def heading(frames: DataFrame, objects: DataFrame) -> DataFrame:
    """Per tick with a ball of known velocity (bvx, bvy): each team's nearest distance to where the ball will be in 0.3 and 0.5 seconds, and the
    angle between its velocity and the nearest player."""
    p = objects.where("object_type IN ('player', 'goalkeeper') AND visible AND x IS NOT NULL AND team IS NOT NULL").select(*ROW, "team", "x", "y", "object_id")
    j = p.join(frames.where("bx IS NOT NULL").select(*ROW, "bx", "by", "bvx", "bvy"), ROW)
    out = []
    for team in ("home", "away"):
        for ahead in (0.3, 0.5):
            d = F.hypot(F.col("x") - F.col("bx") - ahead * F.col("bvx"), F.col("y") - F.col("by") - ahead * F.col("bvy"))
            out.append(F.min(F.when(F.col("team") == team, d)).alias(f"{team}_ahead_{int(ahead * 10)}"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    cosine = F.try_divide(dx * F.col("bvx") + dy * F.col("bvy"), F.hypot(dx, dy) * F.hypot("bvx", "bvy"))
    out.append(F.min_by(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))), F.struct(F.hypot(dx, dy), F.col("object_id"))).alias("angle_to_nearest"))
    return frames.join(j.groupBy(*ROW).agg(*out), ROW, "left")


def match_features(frames: DataFrame, objects: DataFrame, version: str = "2") -> DataFrame:
    """All bundles on one grid, for every match at once.

    ``version``: 1 without what tells early that an attack builds up, 2 with it, 3 with version 1 and ``poss_carrier_age_s``, the age of the carrier that ``frames`` bring
    along as carrier_age_s.
    """
    rows = player_features(possession_seconds(ball_features(held_ball(gridded(frames), objects))), objects)
    if version == "3":
        return rows.withColumn("poss_carrier_age_s", F.col("carrier_age_s").cast("double"))
    return lead_player_features(lead_features(rows), objects) if version == "2" else rows


def mirrored(df: DataFrame, negate: list[str], swap: list[tuple[str, str]], diffs: dict[str, tuple[str, str]]) -> DataFrame:
    """The mirrored scene: signs turned, home and away columns swapped, differences computed anew.  Twice is the identity."""
    other = dict(swap) | {b: a for a, b in swap}
    value = {c: F.col(other.get(c, c)) for c in df.columns}
    value |= {c: -value[c] for c in negate}
    value |= {d: (value[a].cast("float") - value[b].cast("float")) for d, (a, b) in diffs.items()}
    return df.select(*[value[c].alias(c) for c in df.columns])


def graph_nodes(frames: DataFrame, objects: DataFrame, most: int = 22) -> DataFrame:
    """(match_id, period, k, nodes): the ball and its ``most`` nearest players as an ordered array of structs, in the row's direction."""
    base = frames.where("bx IS NOT NULL").select(*ROW, "possession_team", sign().alias("s"), "bx", "by")
    p = objects.where("object_type IN ('player', 'goalkeeper') AND x IS NOT NULL").join(base, ROW)
    x, y = F.col("x") * F.col("s"), F.col("y") * F.col("s")
    node = F.struct(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")).alias("ball_dist"), G.goal_distance(x, y).alias("goal_dist"), x.alias("x"), y.alias("y"), (F.col("team") == F.col("possession_team")).alias("attack"), (F.col("object_type") == "goalkeeper").alias("keeper"), F.col("visible").alias("visible"))
    near = p.select(*ROW, node.alias("node")).withColumn("n", F.row_number().over(Window.partitionBy(*ROW).orderBy("node"))).where(F.col("n") <= most)
    lists = near.groupBy(*ROW).agg(F.sort_array(F.collect_list("node")).alias("players"))
    return base.join(lists, ROW, "left").select(*ROW, F.struct((F.col("bx") * F.col("s")).alias("x"), (F.col("by") * F.col("s")).alias("y")).alias("ball"), F.coalesce("players", F.array()).alias("players"))


def graph_windows(nodes: DataFrame, steps: int = 6, apart: int = 5) -> DataFrame:
    """Each row with the nodes of the ``steps`` rows up to it, ``apart`` ticks from one to the next, null where a row is absent."""
    out = nodes.select(*ROW, F.struct("ball", "players").alias("_0"))
    for i in range(1, steps):
        old = nodes.select("match_id", "period", (F.col("k") + i * apart).alias("k"), F.struct("ball", "players").alias(f"_{i}"))
        out = out.join(old, ROW, "left")
    return out.select(*ROW, F.array(*[F.col(f"_{i}") for i in reversed(range(steps))]).alias("window"))


def goal_probability(df: DataFrame, p_shot: str, xg: str) -> Column:
    """p_shot x xG; null without either, as without a ball."""
    return F.col(p_shot) * F.col(xg)
