"""Queries on whole matches: the bound events as frames and objects of four matches of two periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.operators import checks, features
from gridmark.operators import possession_inputs as inputs
from gridmark.plans.model_queries import GRID, grid
from gridmark.plans.registry import bound, query

#: Half an hour of events is a frame, 50 ms after the last one and a little off; at 20 frames a second a missing frame or two ends a segment.
MATCH_SQL = """{BOUND},
q AS (SELECT 'm' || (object_id % 4) AS match_id, period, ts_us // 1800000000 AS frame_id, CASE WHEN event_type = 'view' THEN 'ball_' ELSE 'p_' END || object_id AS oid,
  CASE event_type WHEN 'view' THEN 'ball' WHEN 'error' THEN 'goalkeeper' ELSE 'player' END AS kind, CASE WHEN event_type <> 'view' THEN team END AS team, x, y, event_type <> 'signup' AS visible, event_id % 50 = 0 AS made, event_id FROM b),
fr AS (SELECT DISTINCT match_id, period, frame_id, frame_id * 50000 + frame_id * 7919 % 40 * 1000 AS ts_us FROM q),
ob AS (SELECT match_id, period, frame_id, oid, arg_min(kind, event_id) AS kind, arg_min(team, event_id) AS team, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, arg_min(visible, event_id) AS visible, arg_min(made, event_id) AS made FROM (SELECT * REPLACE (coalesce(team, '?') AS team) FROM q) GROUP BY ALL)"""
INPUTS_SQL = MATCH_SQL + """,
us AS (SELECT match_id, period, frame_id, oid, kind, nullif(team, '?') AS team, CASE WHEN period = 1 THEN x ELSE -x END AS x, CASE WHEN period = 1 THEN y ELSE -y END AS y FROM ob WHERE visible AND NOT made),
se AS (SELECT *, sum(starts) OVER (PARTITION BY match_id, period ORDER BY ts_us) AS seg FROM (SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY match_id, period ORDER BY ts_us) > 75000, true)::INT AS starts FROM fr)),
ba AS (SELECT match_id, period, frame_id, arg_min(x, oid) AS bx, arg_min(y, oid) AS b_y FROM us WHERE kind = 'ball' GROUP BY ALL),
pl AS (SELECT us.*, sqrt((x - bx) ** 2 + (y - b_y) ** 2) AS dist FROM us LEFT JOIN ba USING (match_id, period, frame_id) WHERE kind <> 'ball'),
nn AS (SELECT match_id, period, frame_id, min(dist) AS dmin FROM pl GROUP BY ALL),
la AS (SELECT match_id, period, frame_id, any_value(dmin) AS dmin, list_sort(list(DISTINCT coalesce(team, '?'))) AS labels FROM pl JOIN nn USING (match_id, period, frame_id) WHERE dist <= dmin + 1e-9 GROUP BY ALL),
fs AS (SELECT se.*, bx, b_y, CASE WHEN list_contains(labels, 'home') THEN 1 / len(labels) ELSE 0 END AS w_home, CASE WHEN dmin <= 1.5 AND list_contains(labels, 'away') THEN 1 / len(labels) ELSE 0 END AS w_away,
    CASE WHEN dmin <= 1.5 THEN CASE labels WHEN ['home'] THEN 1.0 WHEN ['away'] THEN -1.0 ELSE 0.0 END END AS contact, least(coalesce(lead(se.ts_us) OVER (PARTITION BY match_id, period, seg ORDER BY se.ts_us) - se.ts_us, 75000), 75000) AS hold, min(se.ts_us) OVER (PARTITION BY match_id, period, seg) AS seg_from
  FROM se LEFT JOIN ba USING (match_id, period, frame_id) LEFT JOIN la USING (match_id, period, frame_id)),
si AS (SELECT *, sum(gap) OVER (PARTITION BY match_id, period, seg ORDER BY ts_us) AS gaps FROM (SELECT *, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY match_id, period, seg ORDER BY ts_us) > 500000, false)::INT AS gap FROM fs WHERE bx IS NOT NULL)),
co AS (SELECT * FROM fs WHERE contact IS NOT NULL),
tk AS (SELECT match_id, period, unnest(generate_series(CAST(ceil(min(ts_us) / 1e5) AS BIGINT), CAST(floor(max(ts_us) / 1e5) AS BIGINT))) AS k FROM fr GROUP BY 1, 2),
g AS (SELECT tk.match_id, tk.period, k, k * 100000 AS t, fs.frame_id, fs.ts_us AS u, fs.seg, fs.seg_from FROM tk ASOF JOIN fs ON tk.match_id = fs.match_id AND tk.period = fs.period AND k * 100000 >= fs.ts_us WHERE k * 100000 - fs.ts_us <= 75000),
sh AS (SELECT g.match_id, g.period, k,
    sum(w_home * greatest(0, least(t, f.ts_us + hold) - greatest(g.seg_from, t - 1000000, f.ts_us))) / nullif(t - greatest(g.seg_from, t - 1000000), 0) AS s_home, sum(w_away * greatest(0, least(t, f.ts_us + hold) - greatest(g.seg_from, t - 500000, f.ts_us))) / nullif(t - greatest(g.seg_from, t - 500000), 0) AS s_away
  FROM g JOIN fs f ON g.match_id = f.match_id AND g.period = f.period AND g.seg = f.seg AND f.ts_us <= t AND f.ts_us > t - 1000000 - 75000 GROUP BY g.match_id, g.period, k, t, g.seg_from),
ve AS (SELECT g.match_id, g.period, k, any_value(s.ts_us) AS s_ts, any_value(s.bx) AS s_x, any_value(s.gaps) AS s_gaps, arg_min(f.bx, f.ts_us) AS f_x, min(f.ts_us) AS f_ts, arg_min(f.gaps, f.ts_us) AS f_gaps
  FROM g JOIN si s ON s.match_id = g.match_id AND s.period = g.period AND s.ts_us = g.u JOIN si f ON f.match_id = g.match_id AND f.period = g.period AND f.seg = g.seg AND f.ts_us <= g.t AND f.ts_us >= g.t - 1000000 GROUP BY g.match_id, g.period, k),
pf AS (SELECT match_id, period, frame_id, min(dist) FILTER (team = 'home') AS near_home, avg(x) FILTER (team = 'home') AS home_x, count_if(team = 'home') AS home_n, count_if(team = 'away') AS away_n, count(*) AS n FROM pl GROUP BY ALL),
vi AS (SELECT match_id, period, frame_id, min(x) AS lo FROM (SELECT match_id, period, frame_id, x FROM pl UNION ALL SELECT match_id, period, frame_id, bx FROM ba) GROUP BY ALL),
r AS (SELECT g.*, l.ts_us AS l_ts, l.bx AS l_x, c.ts_us AS c_ts, c.contact FROM g ASOF LEFT JOIN si l ON g.match_id = l.match_id AND g.period = l.period AND g.seg = l.seg AND g.t >= l.ts_us ASOF LEFT JOIN co c ON g.match_id = c.match_id AND g.period = c.period AND g.seg = c.seg AND g.t >= c.ts_us),
z AS (SELECT r.match_id, r.period, r.k, r.frame_id, r.seg, coalesce(n, 0) AS players_n, (l_ts IS NOT DISTINCT FROM u)::INT::DOUBLE AS ball_seen, (t - l_ts) / 1e6 AS ball_age_s, CASE WHEN t - l_ts <= 1000000 THEN l_x END AS ball_x,
    CASE WHEN s_ts - f_ts >= 500000 AND s_gaps = f_gaps THEN (s_x - f_x) / ((s_ts - f_ts) / 1e6) END AS ball_vx_1, near_home AS near_home_m, home_x AS home_centroid_x, coalesce(away_n, 0)::DOUBLE AS away_visible_n, (coalesce(home_n, 0) - coalesce(away_n, 0))::DOUBLE AS diff_visible_n,
    s_home AS nearest_home_1_any, s_away AS nearest_away_05_r15, contact AS last_contact_team, (t - c_ts) / 1e6 AS last_contact_age_s, lo AS view_min_x
  FROM r LEFT JOIN sh USING (match_id, period, k) LEFT JOIN ve USING (match_id, period, k) LEFT JOIN pf USING (match_id, period, frame_id) LEFT JOIN vi USING (match_id, period, frame_id)),
y AS (SELECT *, max(CASE WHEN brk THEN k END) OVER (PARTITION BY match_id, period ORDER BY k) AS run_k, lag(away_visible_n, 5) OVER (PARTITION BY match_id, period ORDER BY k) AS n5, lag(ball_x, 10) OVER (PARTITION BY match_id, period ORDER BY k) AS x10 FROM (
  SELECT *, coalesce(k - lag(k) OVER w <> 1 OR seg <> lag(seg) OVER w, true) AS brk FROM z WINDOW w AS (PARTITION BY match_id, period ORDER BY k)))
SELECT match_id, period, k, frame_id, players_n, """
SHOWN = ["ball_seen", "ball_age_s", "ball_x", "ball_vx_1", "near_home_m", "home_centroid_x", "away_visible_n", "diff_visible_n", "nearest_home_1_any", "nearest_away_05_r15", "last_contact_team", "last_contact_age_s", "view_min_x"]


def match_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frames, objects) of the bound matches: a user is an object, views are balls, errors keepers."""
    b = bound(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "ball").when(F.col("event_type") == "error", "goalkeeper").otherwise("player")
    q = b.select(
        F.concat(F.lit("m"), F.col("object_id") % 4).alias("match_id"), "period", F.floor(F.col("ts_us") / 1_800_000_000).alias("frame_id"), F.concat(F.when(kind == "ball", "ball_").otherwise("p_"), F.col("object_id")).alias("object_id"),
        kind.alias("object_type"), F.when(kind != "ball", F.col("team")).alias("team"), "x", "y", (F.col("event_type") != "signup").alias("visible"), (F.col("event_id") % 50 == 0).alias("interpolated"), "event_id",
    )
    ts = F.col("frame_id") * 50_000 + F.col("frame_id") * 7919 % 40 * 1000
    frames = q.select("match_id", "period", "frame_id").distinct().select("*", (ts / 1e6).alias("timestamp_s"), (F.col("period") == 1).alias("home_attacks_positive_x"), F.lit(20.0).alias("native_fps"))
    rest = ["object_type", "team", "x", "y", "visible", "interpolated"]
    objects = q.groupBy("match_id", "frame_id", "object_id").agg(F.min_by(F.struct(*rest), "event_id").alias("o")).select("match_id", "frame_id", "object_id", "o.*")
    return frames, objects


@query("WITH " + INPUTS_SQL + ", ".join(f"round(CAST({c} AS FLOAT)::DOUBLE, 3) AS {c}" for c in SHOWN) + ", CASE WHEN k - 5 >= run_k THEN n5 END AS away_visible_n_lag05, CASE WHEN k - 10 >= run_k THEN round(CAST(x10 AS FLOAT)::DOUBLE, 3) END AS ball_x_lag1 FROM y")
def possession_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The possession model's inputs at every tick of every match; fifteen of the 159 columns are shown."""
    rows = inputs.possession_inputs(*match_tables(spark, sf_dir))
    return rows.select("match_id", "period", "k", "frame_id", "players_n", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in SHOWN], F.col("away_visible_n_lag05").cast("double").alias("away_visible_n_lag05"), F.round(F.col("ball_x_lag1").cast("double"), 3).alias("ball_x_lag1"))


#: Purchases as shots and signups as goals on the frame of their half hour; velocities are a tenth of the place.
SANITY_SQL = MATCH_SQL + """, ev AS (SELECT 'm' || (object_id % 4) AS match_id, ts_us // 1800000000 AS frame_id, CASE event_type WHEN 'purchase' THEN 'shot' ELSE 'goal' END AS event_type, b.team, x, y FROM b WHERE event_type IN ('purchase', 'signup')),
ba AS (SELECT match_id, frame_id, arg_min(x, oid) AS bx, arg_min(y, oid) AS b_y FROM ob WHERE kind = 'ball' GROUP BY ALL),
sh AS (SELECT match_id, count_if(event_type = 'shot') AS shots, count_if(event_type = 'shot' AND bx IS NULL) AS shots_without_ball, quantile_cont(sqrt((x - bx) ** 2 + (y - b_y) ** 2), 0.5) FILTER (event_type = 'shot') AS m, quantile_cont(sqrt((x - bx) ** 2 + (y - b_y) ** 2), 0.9) FILTER (event_type = 'shot') AS q,
  count_if(event_type = 'goal' AND team = 'home') AS score_home, count_if(event_type = 'goal' AND team = 'away') AS score_away FROM ev LEFT JOIN ba USING (match_id, frame_id) GROUP BY 1),
fa AS (SELECT match_id, quantile_cont(sqrt(x * x + y * y) / 10, 0.99) AS p99, count_if(sqrt(x * x + y * y) / 10 > 5) AS fast FROM ob WHERE kind <> 'ball' GROUP BY 1),
se AS (SELECT match_id, 1 - avg(s::INT) AS hidden FROM (SELECT match_id, frame_id, bool_or(visible) AS s FROM ob WHERE kind <> 'ball' GROUP BY ALL) GROUP BY 1),
al AS (SELECT match_id, avg((frame_id % 3 > 0)::INT) AS alive FROM fr GROUP BY 1)
SELECT match_id, round(alive, 6) AS frames_ball_alive, shots, shots_without_ball, round(m, 6) AS shot_to_ball_median, round(q, 6) AS shot_to_ball_p90, score_home, score_away, round(p99, 6) AS player_speed_p99, fast AS rows_too_fast, round(hidden, 6) AS frames_all_estimated FROM al JOIN sh USING (match_id) JOIN fa USING (match_id) JOIN se USING (match_id)"""


@query("WITH " + SANITY_SQL)
def sanity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether coordinates and events of each match line up."""
    frames, objects = match_tables(spark, sf_dir)
    frames = frames.withColumn("ball_state", F.when(F.col("frame_id") % 3 > 0, "alive").otherwise("dead"))
    objects = objects.withColumns({"vx": F.col("x") / 10, "vy": F.col("y") / 10})
    b = bound(spark, sf_dir).where("event_type IN ('purchase', 'signup')")
    events = b.select(F.concat(F.lit("m"), F.col("object_id") % 4).alias("match_id"), F.floor(F.col("ts_us") / 1_800_000_000).alias("frame_id"), F.when(F.col("event_type") == "purchase", "shot").otherwise("goal").alias("event_type"), "team", "x", "y")
    rows = checks.sanity(objects, frames, events, most_speed=5.0)
    return rows.select("match_id", "shots", "shots_without_ball", "score_home", "score_away", "rows_too_fast", *[F.round(c, 6).alias(c) for c in ("frames_ball_alive", "shot_to_ball_median", "shot_to_ball_p90", "player_speed_p99", "frames_all_estimated")])


#: Outfield players, the lines of both teams at both ends, and the row's own by its team and direction.
LEAD_SQL = GRID + """, g2 AS (SELECT *, k - row_number() OVER (PARTITION BY match_id, period ORDER BY k) AS seg FROM f),
tb AS (SELECT match_id, period, k, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y FROM o WHERE event_type = 'view' GROUP BY ALL),
h AS (SELECT g2.*, CASE WHEN g2.k - t.k <= 10 THEN t.x END AS bx FROM g2 ASOF LEFT JOIN (SELECT tb.* FROM tb SEMI JOIN g2 ON tb.match_id = g2.match_id AND tb.period = g2.period AND tb.k = g2.k) t ON g2.match_id = t.match_id AND g2.period = t.period AND g2.k >= t.k),
pl AS (SELECT b.match_id, b.period, b.ts_us // {HOUR} AS k, b.event_id, CASE WHEN b.event_id % 2 = 0 THEN 'home' ELSE 'away' END AS team, b.x, b.y FROM b WHERE event_type NOT IN ('view', 'error', 'signup')),
e AS (SELECT unnest([1, -1]) AS e), t AS (SELECT unnest(['home', 'away']) AS team),
v AS (SELECT h.match_id, h.period, h.k, t.team, e.e, max(CASE WHEN pl.team <> t.team THEN pl.x * e.e END) AS line, count(*) FILTER (pl.team = t.team AND pl.x * e.e >= {NEAR_X} AND abs(pl.y) <= {NEAR_Y}) AS att, count(*) FILTER (pl.team <> t.team AND pl.x * e.e >= {NEAR_X} AND abs(pl.y) <= {NEAR_Y}) AS def, list(pl.x * e.e) FILTER (pl.team = t.team) AS xs
  FROM h CROSS JOIN t CROSS JOIN e LEFT JOIN pl ON pl.match_id = h.match_id AND pl.period = h.period AND pl.k = h.k GROUP BY ALL),
n AS (SELECT h.*, line, att, def, len(list_filter(coalesce(xs, []), lambda x: x > line)) AS past, CASE WHEN flipped THEN -1 ELSE 1 END AS s FROM h LEFT JOIN v ON v.match_id = h.match_id AND v.period = h.period AND v.k = h.k AND v.team = possession_team AND v.e = CASE WHEN flipped THEN -1 ELSE 1 END),
c AS (SELECT n.*, w.att AS att3, w.def AS def3, w.line AS line3 FROM n LEFT JOIN h o3 ON o3.match_id = n.match_id AND o3.period = n.period AND o3.k = n.k - 30 AND o3.seg = n.seg LEFT JOIN v w ON w.match_id = o3.match_id AND w.period = o3.period AND w.k = o3.k AND w.team = n.possession_team AND w.e = n.s)
SELECT match_id, period, k, att AS att_near_box, def AS def_near_box, att - def AS near_box_diff, att - att3 AS att_near_box_change_3s, def - def3 AS def_near_box_change_3s, round(52.5 - line, 6) AS def_line_dist, round(line3 - line, 6) AS def_line_change_3s, round(line - bx * s, 6) AS ball_line_gap, CASE WHEN line IS NOT NULL THEN past END AS att_beyond_line FROM c"""


@query("WITH " + LEAD_SQL.replace("{NEAR_X}", str(features.G.NEAR_X)).replace("{NEAR_Y}", str(features.G.NEAR_Y)))
def lead_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells early that an attack builds up, at every tick; players are of a team by their number's parity."""
    frames, objects = grid(spark, sf_dir)
    parity = F.when(F.substring("object_id", -9, 9).cast("long") % 2 == 0, "home").otherwise("away")
    objects = objects.withColumn("team", F.when(F.col("object_type") != "ball", parity))
    rows = features.lead_player_features(features.held_ball(features.gridded(frames), objects), objects)
    counts = ("att_near_box", "def_near_box", "near_box_diff", "att_near_box_change_3s", "def_near_box_change_3s", "att_beyond_line")
    return rows.select("match_id", "period", "k", *[F.col(c).cast("long").alias(c) for c in counts], *[F.round(c, 6).alias(c) for c in ("def_line_dist", "def_line_change_3s", "ball_line_gap")])
