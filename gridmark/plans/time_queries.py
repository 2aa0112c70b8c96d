"""Queries on time joins, windows and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.operators import asof, labels, windows
from gridmark.plans.registry import HOUR, KEYS, bound, query, table


@query("""WITH {BOUND},
g AS (SELECT match_id, period, unnest(generate_series(CAST(ceil(min(ts_us) / {HOUR}.0) AS BIGINT), CAST(floor(max(ts_us) / {HOUR}.0) AS BIGINT))) AS k FROM b GROUP BY 1, 2)
SELECT g.match_id, g.period, g.k, CASE WHEN g.k * {HOUR} - b.ts_us <= 6 * {HOUR} THEN b.event_id END AS event_id, CASE WHEN g.k * {HOUR} - b.ts_us <= 6 * {HOUR} THEN b.team END AS team
FROM g ASOF LEFT JOIN b ON g.match_id = b.match_id AND g.period = b.period AND g.k * {HOUR} >= b.ts_us""")
def grid_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grid tick with the latest state at or before it, at most six hours old."""
    b = bound(spark, sf_dir)
    return asof.resampled(b, KEYS, "ts_us", HOUR, {"event_id": "event_id", "team": "team"}, 6 * HOUR, ["event_id"]).drop("tick")


@query("""WITH {BOUND},
g AS (SELECT match_id, period, unnest(generate_series(CAST(ceil(min(ts_us) / {HOUR}.0) AS BIGINT), CAST(floor(max(ts_us) / {HOUR}.0) AS BIGINT))) AS k FROM b GROUP BY 1, 2),
s AS (SELECT g.match_id, g.period, g.k, g.k * {HOUR} AS t, CASE WHEN g.k * {HOUR} - b.ts_us <= 6 * {HOUR} THEN b.event_type END AS state, CASE WHEN g.k * {HOUR} - b.ts_us <= 6 * {HOUR} THEN b.team END AS team
  FROM g ASOF LEFT JOIN b ON g.match_id = b.match_id AND g.period = b.period AND g.k * {HOUR} >= b.ts_us),
n AS (SELECT s.match_id, s.period, s.k, s.team, s.state,
  count(*) FILTER (e.event_type = 'purchase' AND e.ts_us <= s.t + 5 * {HOUR}) AS shot5, count(*) FILTER (e.event_type = 'signup' AND e.ts_us <= s.t + 5 * {HOUR}) AS goal5, count(*) FILTER (e.event_type = 'click' AND e.ts_us <= s.t + 5 * {HOUR}) AS set5,
  count(*) FILTER (e.event_type = 'purchase' AND e.ts_us <= s.t + 3 * {HOUR}) AS shot3, count(*) FILTER (e.event_type = 'signup' AND e.ts_us <= s.t + 3 * {HOUR}) AS goal3, count(*) FILTER (e.event_type = 'click' AND e.ts_us <= s.t + 3 * {HOUR}) AS set3
  FROM s LEFT JOIN b e ON e.match_id = s.match_id AND e.period = s.period AND e.team = s.team AND e.ts_us > s.t AND e.ts_us <= s.t + 5 * {HOUR} GROUP BY ALL)
SELECT match_id, period, k, team, coalesce(team IS NOT NULL AND state <> 'error', false) AND set5 = 0 AS label_mask_h5, CASE WHEN label_mask_h5 THEN shot5 > 0 END AS label_shot_h5, CASE WHEN label_mask_h5 THEN goal5 > 0 END AS label_goal_h5,
  coalesce(team IS NOT NULL AND state <> 'error', false) AND set3 = 0 AS label_mask_h3, CASE WHEN label_mask_h3 THEN shot3 > 0 END AS label_shot_h3, CASE WHEN label_mask_h3 THEN goal3 > 0 END AS label_goal_h3 FROM n""")
def label_within_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: grid, last known state, and whether a shot or goal of the team follows within 5 and 3 hours."""
    b = bound(spark, sf_dir)
    rows = asof.resampled(b, KEYS, "ts_us", HOUR, {"event_type": "state", "team": "team"}, 6 * HOUR, ["event_id"])
    kind = F.when(F.col("event_type") == "purchase", "shot").when(F.col("event_type") == "signup", "goal").when(F.col("event_type") == "click", "set_play")
    eligible = F.col("team").isNotNull() & (F.col("state") != "error")
    return labels.grid_labels(rows, labels.label_events(b, kind), [*KEYS, "team"], "tick", "ts_us", eligible, {"h5": 5 * HOUR, "h3": 3 * HOUR}).drop("tick", "state")


@query("""WITH {BOUND}, r AS (SELECT * FROM b WHERE event_type = 'click')
SELECT b.event_id, r.event_id AS restart_id, coalesce(b.ts_us - r.ts_us <= 10 * {HOUR}, false) AS in_phase
FROM b ASOF LEFT JOIN r ON b.match_id = r.match_id AND b.period = r.period AND b.team = r.team AND b.ts_us >= r.ts_us""")
def asof_backward_by_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest restart of the team, ties inclusive, and whether it is at most ten hours old."""
    b = bound(spark, sf_dir)
    got = asof.asof_backward(b, b.where("event_type = 'click'"), [*KEYS, "team"], "ts_us", "ts_us", {"event_id": "restart_id", "ts_us": "restart_us"}, right_order=["event_id"])
    return got.select("event_id", "restart_id", F.coalesce(F.col("ts_us") - F.col("restart_us") <= 10 * HOUR, F.lit(False)).alias("in_phase"))


@query("""WITH {BOUND}, r AS (SELECT * FROM b WHERE event_type = 'purchase')
SELECT b.event_id, r.event_id AS shot_id, r.ts_us - b.ts_us AS wait_us FROM b ASOF LEFT JOIN r ON b.match_id = r.match_id AND b.period = r.period AND b.team = r.team AND b.ts_us <= r.ts_us""")
def asof_forward_by_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bound(spark, sf_dir)
    got = asof.asof_forward(b, b.where("event_type = 'purchase'"), [*KEYS, "team"], "ts_us", "ts_us", {"event_id": "shot_id", "ts_us": "shot_us"}, right_order=["event_id"])
    return got.select("event_id", "shot_id", (F.col("shot_us") - F.col("ts_us")).alias("wait_us"))


@query("""WITH {BOUND}, r AS (SELECT * FROM b WHERE event_type = 'purchase')
SELECT b.event_id, r.event_id AS shot_id FROM b ASOF LEFT JOIN r ON b.match_id = r.match_id AND b.period = r.period AND b.team = r.team AND b.ts_us < r.ts_us""")
def asof_forward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next shot of the team; a shot's own row looks for the one after it."""
    b = bound(spark, sf_dir)
    return asof.asof_forward(b, b.where("event_type = 'purchase'"), [*KEYS, "team"], "ts_us", "ts_us", {"event_id": "shot_id"}, strict=True, right_order=["event_id"]).select("event_id", "shot_id")


@query("""WITH {BOUND}, v AS (SELECT * FROM b WHERE event_type = 'view'), c AS (SELECT * FROM b WHERE event_type = 'click'),
x AS (SELECT c.event_id, p.event_id AS pid, c.ts_us - p.ts_us AS back FROM c ASOF LEFT JOIN v p ON c.match_id = p.match_id AND c.period = p.period AND c.ts_us >= p.ts_us),
y AS (SELECT c.event_id, n.event_id AS nid, n.ts_us - c.ts_us AS ahead FROM c ASOF LEFT JOIN v n ON c.match_id = n.match_id AND c.period = n.period AND c.ts_us <= n.ts_us)
SELECT event_id, CASE WHEN back <= {HOUR} AND (ahead IS NULL OR back <= ahead) THEN pid WHEN ahead <= {HOUR} THEN nid END AS frame_id FROM x JOIN y USING (event_id)""")
def asof_nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click snapped to the nearest view within an hour."""
    b = bound(spark, sf_dir)
    return asof.asof_nearest(b.where("event_type = 'click'"), b.where("event_type = 'view'"), KEYS, "ts_us", "ts_us", {"event_id": "frame_id"}, tolerance=HOUR, right_order=["event_id"]).select("event_id", "frame_id")


@query("""WITH {BOUND}, a AS (SELECT event_id AS alarm_id, match_id, period, team, ts_us AS start_us, ts_us + 2 * {HOUR} AS end_us FROM b WHERE p > 0.5),
s AS (SELECT * FROM b WHERE event_type = 'purchase')
SELECT event_id, alarm_id, in_grace, wait_us FROM (SELECT s.event_id, alarm_id, s.ts_us > end_us AS in_grace, s.ts_us - start_us AS wait_us, row_number() OVER (PARTITION BY s.event_id ORDER BY s.ts_us > end_us, start_us DESC, alarm_id) AS n
FROM s JOIN a ON s.match_id = a.match_id AND s.period = a.period AND s.team = a.team AND s.ts_us > start_us AND s.ts_us <= end_us + {HOUR}) WHERE n = 1""")
def interval_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots inside an interval or in the hour after it; an active interval goes before one in grace, then the latest start."""
    b = bound(spark, sf_dir)
    a = b.where("p > 0.5").select(*KEYS, "team", F.col("event_id").alias("alarm_id"), F.col("ts_us").alias("start_us"), (F.col("ts_us") + 2 * HOUR).alias("end_us")).withColumn("grace_us", F.col("end_us") + HOUR)
    shots = b.where("event_type = 'purchase'").select(*KEYS, "team", "event_id", "ts_us")
    got = asof.interval_join(shots, a, [*KEYS, "team"], "ts_us", "start_us", "grace_us", 3 * HOUR).withColumn("in_grace", F.col("ts_us") > F.col("end_us"))
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("in_grace", F.col("start_us").desc(), "alarm_id"))
    return got.withColumn("n", n).where("n = 1").select("event_id", "alarm_id", "in_grace", (F.col("ts_us") - F.col("start_us")).alias("wait_us"))


@query("""SELECT o_orderkey, count(l_orderkey) AS lines, min(l_shipdate) AS first_ship, count_if(l_shipdate > o_orderdate + INTERVAL 60 DAY AND l_shipdate <= o_orderdate + INTERVAL 400 DAY) AS in_window
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def interval_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose shipment falls in an interval after their order's date."""
    o, line = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    day = F.expr("INTERVAL 1 DAY")
    late = (F.col("l_shipdate") > F.col("o_orderdate") + 60 * day) & (F.col("l_shipdate") <= F.col("o_orderdate") + 400 * day)
    return line.join(o, line["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.min("l_shipdate").alias("first_ship"), F.count_if(late).alias("in_window"))


@query("""WITH {BOUND}, v AS (SELECT match_id, period, ts_us, value, lead(ts_us) OVER w AS t1, lead(value) OVER w AS v1 FROM b WHERE event_type = 'view' WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us)),
c AS (SELECT * FROM b WHERE event_type = 'click')
SELECT c.event_id, round(CASE WHEN c.ts_us = v.ts_us THEN v.value WHEN v.t1 - v.ts_us <= 12 * {HOUR} THEN v.value + (v.v1 - v.value) * (c.ts_us - v.ts_us) / (v.t1 - v.ts_us) END, 6) AS value_at
FROM c ASOF LEFT JOIN v ON c.match_id = v.match_id AND c.period = v.period AND c.ts_us >= v.ts_us""")
def interpolated_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value on the line between the views around each click."""
    b = bound(spark, sf_dir)
    got = asof.interpolated(b.where("event_type = 'view'").select(*KEYS, "ts_us", F.col("value").alias("value_at")), b.where("event_type = 'click'").select("event_id", *KEYS, "ts_us"), KEYS, "ts_us", "ts_us", ["value_at"], most_gap=12 * HOUR)
    return got.select("event_id", F.round("value_at", 6).alias("value_at"))


@query("""WITH {BOUND}, m AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 6 * {HOUR} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS seg FROM m)
SELECT match_id, period, seg::BIGINT AS seg, count(*) AS n_rows, min(ts_us) AS start_us, max(ts_us) AS end_us FROM n GROUP BY ALL""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.gap_segments(bound(spark, sf_dir), KEYS, "ts_us", 6 * HOUR, tie=("event_id",))
    return rows.groupBy(*KEYS, "seg").agg(F.count("*").alias("n_rows"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


@query("""WITH {BOUND} SELECT event_id, ts_us - max(CASE WHEN event_type = 'click' THEN ts_us END) OVER w AS since_click_us, last_value(CASE WHEN event_type <> 'error' THEN team END IGNORE NULLS) OVER w AS last_team
FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def time_since_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.ordered(KEYS, "ts_us", "event_id")
    return bound(spark, sf_dir).select("event_id", windows.time_since(F.col("event_type") == "click", F.col("ts_us"), w).alias("since_click_us"), windows.filled(F.when(F.col("event_type") != "error", F.col("team")), w).alias("last_team"))


@query("""WITH {BOUND}, m AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE team END AS holder FROM b),
n AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR holder IS DISTINCT FROM lag(holder) OVER w THEN 1 ELSE 0 END AS s FROM m WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS run FROM n)
SELECT event_id, run::BIGINT AS run, ts_us - first_value(ts_us) OVER (PARTITION BY match_id, period, run ORDER BY ts_us, event_id) AS held_us FROM r""")
def possession_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of an unchanged holder (nobody is a holder too), and how long it has lasted."""
    rows = bound(spark, sf_dir).withColumn("holder", F.when(F.col("event_type") != "error", F.col("team")))
    rows = windows.with_runs(rows, KEYS, ["ts_us", "event_id"], "holder")
    return rows.select("event_id", "run", (F.col("ts_us") - F.first("ts_us").over(windows.ordered([*KEYS, "run"], "ts_us", "event_id"))).alias("held_us"))


@query("""WITH {BOUND}, m AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN team END IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS v FROM b),
n AS (SELECT *, lag(v) OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS u FROM m) SELECT match_id, period, count_if(u IS NOT NULL AND u <> v) AS changes FROM n GROUP BY ALL""")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir).withColumn("holder", F.when(F.col("event_type") != "error", F.col("team")))
    return windows.changes("holder", KEYS, ["ts_us", "event_id"], rows)


@query("""WITH {BOUND}, m AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 48 * {HOUR} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM b WINDOW w AS (PARTITION BY match_id, period, object_id ORDER BY ts_us)),
n AS (SELECT *, sum(s) OVER (PARTITION BY match_id, period, object_id ORDER BY ts_us) AS seg FROM m),
v AS (SELECT *, coalesce(lag(ts_us, 3) OVER w, first_value(ts_us) OVER w) AS t0, coalesce(lag(x, 3) OVER w, first_value(x) OVER w) AS x0, coalesce(lag(y, 3) OVER w, first_value(y) OVER w) AS y0 FROM n WINDOW w AS (PARTITION BY match_id, period, object_id, seg ORDER BY ts_us))
SELECT event_id, round(CASE WHEN ts_us > t0 THEN (x - x0) / ((ts_us - t0) / 1e6) END, 9) AS vx, round(CASE WHEN ts_us > t0 THEN (y - y0) / ((ts_us - t0) / 1e6) END, 9) AS vy FROM v""")
def causal_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*KEYS, "object_id"]
    rows = windows.causal_velocity(windows.gap_segments(bound(spark, sf_dir), keys, "ts_us", 48 * HOUR), keys, "ts_us", ["x", "y"], 3)
    return rows.select("event_id", F.round("vx", 9).alias("vx"), F.round("vy", 9).alias("vy"))


@query("""WITH {BOUND}, m AS (SELECT event_id, ts_us, last_value(CASE WHEN event_type = 'view' THEN x END IGNORE NULLS) OVER w AS lx, last_value(CASE WHEN event_type = 'view' THEN ts_us END IGNORE NULLS) OVER w AS lt
FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id)) SELECT event_id, round(CASE WHEN ts_us - lt <= 10 * {HOUR} THEN lx END, 6) AS held_x, CASE WHEN ts_us - lt <= 10 * {HOUR} THEN ts_us - lt END AS age_us FROM m""")
def held_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, age = windows.held(F.col("x"), F.col("event_type") == "view", F.col("ts_us"), windows.ordered(KEYS, "ts_us", "event_id"), 10 * HOUR)
    return bound(spark, sf_dir).select("event_id", F.round(value, 6).alias("held_x"), age.alias("age_us"))


@query("""WITH {BOUND} SELECT event_id, count_if(x >= 17.5) OVER w AS third_rows, round(max(x) OVER w, 6) AS max_x, round(min(x) OVER w, 6) AS min_x, round(avg(x) OVER w, 6) AS mean_x, count(*) OVER (PARTITION BY match_id, period ORDER BY ts_us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS last_2h
FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes of the last twenty rows, and the rows of the last two hours."""
    w, x = windows.ordered(KEYS, "ts_us", "event_id"), F.col("x")
    out = [F.round(windows.rolling(x, how, w, 20), 6).alias(name) for how, name in (("max", "max_x"), ("min", "min_x"), ("avg", "mean_x"))]
    return bound(spark, sf_dir).select("event_id", windows.rolling_count(x >= 17.5, w, 20).alias("third_rows"), *out, windows.trailing(F.count("*"), KEYS, "ts_us", 2 * HOUR).alias("last_2h"))


@query("""WITH {BOUND}, m AS (SELECT event_id, ts_us, x, first_value(x) OVER w AS x0, first_value(ts_us) OVER w AS t0 FROM b WINDOW w AS (PARTITION BY match_id, period, object_id ORDER BY ts_us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN ts_us - t0 >= 86400000000 THEN (x - x0) / ((ts_us - t0) / 1e6) END, 9) AS v FROM m""")
def first_sighting_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity since the first sighting of the last 48 hours, if it spans at least half of them."""
    keys = [*KEYS, "object_id"]
    first = windows.trailing(F.first(F.struct("x", "ts_us")), keys, "ts_us", 48 * HOUR)
    rows = bound(spark, sf_dir).withColumn("first", first)
    span = F.col("ts_us") - F.col("first.ts_us")
    return rows.select("event_id", F.round(F.when(span >= 24 * HOUR, (F.col("x") - F.col("first.x")) / (span / 1e6)), 9).alias("v"))


@query("""WITH {BOUND}, h AS (SELECT *, coalesce(least(lead(ts_us) OVER w - ts_us, 2 * {HOUR}), 0) AS hold FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us)),
s AS (SELECT match_id, period, min(ts_us) AS s0 FROM b GROUP BY ALL),
c AS (SELECT a.event_id, a.ts_us, s.s0, sum(CASE WHEN o.team = 'home' THEN greatest(0, least(o.ts_us + o.hold, a.ts_us) - greatest(o.ts_us, a.ts_us - 10 * {HOUR})) END) AS home, sum(CASE WHEN o.team = 'away' THEN greatest(0, least(o.ts_us + o.hold, a.ts_us) - greatest(o.ts_us, a.ts_us - 10 * {HOUR})) END) AS away
  FROM h a JOIN s USING (match_id, period) LEFT JOIN h o ON o.match_id = a.match_id AND o.period = a.period AND o.ts_us < a.ts_us AND o.ts_us >= a.ts_us - 12 * {HOUR} GROUP BY ALL)
SELECT event_id, round(CASE WHEN ts_us > s0 THEN coalesce(home, 0) / least(ts_us - s0, 10 * {HOUR}) END, 6) AS share_home, round(CASE WHEN ts_us > s0 THEN coalesce(away, 0) / least(ts_us - s0, 10 * {HOUR}) END, 6) AS share_away FROM c""")
def time_weighted_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last ten hours, the share that rows of each team hold; a row holds two hours at most."""
    rows = windows.time_shares(bound(spark, sf_dir).withColumn("seg", F.lit(1)), KEYS, "ts_us", "team", ["home", "away"], 10 * HOUR, 2 * HOUR)
    return rows.select("event_id", F.round("share_home", 6).alias("share_home"), F.round("share_away", 6).alias("share_away"))


@query("""WITH {BOUND} SELECT event_id, min(CASE WHEN event_type = 'click' THEN event_id END) OVER w AS next_restart, bool_or(event_type = 'click' AND team = 'home') OVER w AS home_restarts_later
FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def next_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least id of a later restart (the first one, as ids grow with time), and whether the home team restarts later at all.

    The frame runs backwards: one that ends at the group's end would be read anew for each row.
    """
    after = Window.partitionBy(*KEYS).orderBy(F.desc("ts_us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    click = F.col("event_type") == "click"
    return bound(spark, sf_dir).select("event_id", F.min(F.when(click, F.col("event_id"))).over(after).alias("next_restart"), F.bool_or(click & (F.col("team") == "home")).over(after).alias("home_restarts_later"))


@query("""WITH {BOUND}, h AS (SELECT event_id, match_id, period, object_id, ts_us // {HOUR} AS k, x FROM b), d AS (SELECT match_id, period, object_id, k, min(event_id) AS event_id, arg_min(x, event_id) AS x FROM h GROUP BY ALL)
SELECT a.match_id, a.period, a.object_id, a.k, round(a.x - o.x, 6) AS dx FROM d a JOIN d o ON a.match_id = o.match_id AND a.period = o.period AND a.object_id = o.object_id AND a.k - 5 = o.k""")
def lag_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same object exactly five ticks ago: an equi-join on the shifted tick, as rows may be absent."""
    d = bound(spark, sf_dir).groupBy(*KEYS, "object_id", F.floor(F.col("ts_us") / HOUR).alias("k")).agg(F.min_by("x", "event_id").alias("x"))
    o = d.select(*KEYS, "object_id", (F.col("k") + 5).alias("k"), F.col("x").alias("x0"))
    return d.join(o, [*KEYS, "object_id", "k"]).select(*KEYS, "object_id", "k", F.round(F.col("x") - F.col("x0"), 6).alias("dx"))


@query("""WITH {BOUND}, s AS (SELECT * FROM b WHERE event_type = 'purchase'), l AS (SELECT unnest([0, 1, 2, 5]) AS back),
q AS (SELECT s.event_id AS shot_id, s.match_id, s.period, l.back, s.ts_us - l.back * {HOUR} AS at FROM s, l)
SELECT q.shot_id, q.back, round(b.p, 6) AS p FROM q ASOF LEFT JOIN b ON q.match_id = b.match_id AND q.period = b.period AND q.at >= b.ts_us""")
def value_before_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last score at a shot and one, two and five hours before it."""
    b = bound(spark, sf_dir)
    q = b.where("event_type = 'purchase'").select(*KEYS, F.col("event_id").alias("shot_id"), "ts_us", F.explode(F.array(*map(F.lit, (0, 1, 2, 5)))).alias("back")).withColumn("at", F.col("ts_us") - F.col("back") * HOUR)
    return asof.asof_backward(q, b, KEYS, "at", "ts_us", {"p": "p"}, right_order=["event_id"]).select("shot_id", "back", F.round("p", 6).alias("p"))
