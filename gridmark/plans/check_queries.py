"""Queries on checks of converted matches, over the events as a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions import geometry as G
from gridmark.operators import checks
from gridmark.plans.registry import HOUR, KEYS, bound, query, table

#: Events as objects of frames of one hour: errors are the ball, signups keepers, views hidden.
OBJECTS = """o AS (SELECT match_id, period, ts_us // {HOUR} AS k, event_id, CAST(object_id AS VARCHAR) AS object_id, CASE WHEN event_type = 'error' THEN 'ball' WHEN event_type = 'signup' THEN 'goalkeeper' ELSE 'player' END AS object_type,
  team, x, y, event_type <> 'view' AS visible, value < 3 AS interpolated FROM b)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "ball").when(F.col("event_type") == "signup", "goalkeeper").otherwise("player")
    return bound(spark, sf_dir).select(*KEYS, F.floor(F.col("ts_us") / HOUR).alias("k"), "event_id", F.col("object_id").cast("string").alias("object_id"), kind.alias("object_type"), "team", "x", "y", (F.col("event_type") != "view").alias("visible"), (F.col("value") < 3).alias("interpolated"))


@query("WITH {BOUND}, " + OBJECTS + """ SELECT event_id, round(CASE WHEN (match_id + period) % 2 = 1 THEN x ELSE -x END, 6) AS x, round(CASE WHEN (match_id + period) % 2 = 1 THEN y ELSE -y END, 6) AS y, object_type
FROM o WHERE visible AND NOT interpolated AND match_id % 8 <> 7""")
def home_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable objects turned to home's direction of attack; every eighth match has no direction."""
    o = objects(spark, sf_dir)
    direction = checks.attack_direction(F.col("period"), F.col("match_id") % 2 == 0, F.lit(None).cast("boolean"))
    frames = o.select(*KEYS).distinct().where(F.col("match_id") % 8 != 7).withColumn("home_attacks_positive_x", direction)
    return checks.home_frame(o, frames, KEYS).select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "object_type")


@query("""WITH {BOUND}, f AS (SELECT match_id, event_id, CASE WHEN period = 2 THEN 4 ELSE period END AS period, ts_us / 1e6 AS t, 'alive' AS state, team FROM b), s AS (SELECT match_id, min(t) + 500000 AS start_s FROM f WHERE period = 4 AND match_id % 2 = 0 GROUP BY 1)
SELECT event_id, CASE WHEN late THEN 5 ELSE period END::BIGINT AS period, round(CASE WHEN late THEN t - start_s ELSE t END, 3) AS timestamp_s, CASE WHEN late THEN 'dead' ELSE state END AS ball_state, CASE WHEN NOT late THEN team END AS possession_team
FROM (SELECT f.*, start_s, coalesce(period = 4 AND t >= start_s, false) AS late FROM f LEFT JOIN s USING (match_id))""")
def shootout_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of a fourth period as a shootout."""
    f = bound(spark, sf_dir).select("match_id", "event_id", F.when(F.col("period") == 2, 4).otherwise(F.col("period")).alias("period"), (F.col("ts_us") / 1e6).alias("timestamp_s"), F.lit("alive").alias("ball_state"), F.col("team").alias("possession_team"))
    starts = f.where("period = 4 AND match_id % 2 = 0").groupBy("match_id").agg((F.min("timestamp_s") + 500000).alias("start_s"))
    return checks.moved_shootout(f, starts).select("event_id", "period", F.round("timestamp_s", 3).alias("timestamp_s"), "ball_state", "possession_team")


@query("WITH {BOUND}, " + OBJECTS + """, ball AS (SELECT match_id, period, k, min_by(x, event_id) AS bx, min_by(y, event_id) AS by_ FROM o WHERE visible AND object_type = 'ball' GROUP BY ALL),
who AS (SELECT DISTINCT ON (match_id, period, k, object_id) match_id, period, k, object_id, x, y FROM o WHERE visible AND object_type <> 'ball' ORDER BY match_id, period, k, object_id, event_id),
a AS (SELECT match_id, period, count(*) AS n, quantile_cont(sqrt((x - bx) ** 2 + (y - by_) ** 2), 0.5) AS m FROM who JOIN ball USING (match_id, period, k) GROUP BY ALL)
SELECT match_id, period, n, round(m, 6) AS median_d, NOT (n >= 5 AND m > 40) AS ok FROM a""")
def event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether coded players are near the ball, by period."""
    o = objects(spark, sf_dir)
    one = o.groupBy(*KEYS, "k", F.when(F.col("object_type") == "ball", "ball").otherwise(F.col("object_id")).alias("object_id"), (F.col("object_type") == "ball").alias("is_ball")).agg(F.min_by(F.struct("x", "y"), F.when(F.col("visible"), F.col("event_id"))).alias("at"))
    rows = one.where("at IS NOT NULL").select(*KEYS, "k", "object_id", F.when(F.col("is_ball"), "ball").otherwise("player").alias("object_type"), "at.x", "at.y", F.lit(True).alias("visible"))
    events = rows.where("object_type = 'player'").select(*KEYS, "k", "object_id")
    return checks.event_alignment(events, rows, [*KEYS, "k"], least=5, most=40.0).withColumn("median_d", F.round("median_d", 6))


@query("WITH {BOUND}, s AS (SELECT match_id, period, team, CASE WHEN object_id % 3 = 0 THEN 'left' WHEN object_id % 3 = 1 THEN 'right' END AS side, CASE WHEN team = 'home' THEN y ELSE -y END AS sy FROM b) "
       "SELECT team, period, round(avg(sy) FILTER (WHERE side = 'left'), 6) AS \"left\", round(avg(sy) FILTER (WHERE side = 'right'), 6) AS \"right\", round(avg(sy) FILTER (WHERE side = 'left') - avg(sy) FILTER (WHERE side = 'right'), 6) AS gap FROM s GROUP BY 1, 2")  # fmt: skip
def side_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether players on the left are left of those on the right in their team's direction."""
    side = F.when(F.col("object_id") % 3 == 0, "left").when(F.col("object_id") % 3 == 1, "right")
    out = checks.side_check(bound(spark, sf_dir).withColumn("side", side), ["team", "period"], "side", F.when(F.col("team") == "home", F.col("y")).otherwise(-F.col("y")))
    return out.select("team", "period", *[F.round(c, 6).alias(c) for c in ("left", "right", "gap")])


@query("WITH {BOUND} SELECT match_id, period, round(avg(x), 6) AS keeper_x, avg(x) < 0 AS home_attacks_positive_x FROM b WHERE event_type = 'signup' AND team = 'home' GROUP BY 1, 2")
def keeper_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home's direction from where its keeper stands."""
    return checks.keeper_direction(bound(spark, sf_dir).where("event_type = 'signup' AND team = 'home'"), KEYS).withColumn("keeper_x", F.round("keeper_x", 6))


@query("WITH {BOUND}, m AS (SELECT match_id, period, avg(CASE WHEN object_id % 3 = 0 THEN x END) AS m0, avg(CASE WHEN object_id % 3 = 1 THEN x END) AS m1, avg(CASE WHEN event_type = 'signup' THEN x END) AS k FROM b GROUP BY 1, 2) "
       "SELECT match_id, period, CASE WHEN coalesce(abs(m1 - k) < abs(m0 - k), false) THEN 1 ELSE 0 END AS keeper_cluster FROM m")  # fmt: skip
def keeper_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two clusters of outfield players a keeper belongs to."""
    b = bound(spark, sf_dir)
    k = b.groupBy(*KEYS).agg(F.avg(F.when(F.col("event_type") == "signup", F.col("x"))).alias("keeper_x"))
    rows = b.withColumn("cluster", F.when(F.col("object_id") % 3 < 2, F.col("object_id") % 3)).join(k, KEYS)
    return checks.keeper_side(rows, KEYS, "cluster", "x", "keeper_x")


@query("WITH {BOUND}, " + OBJECTS + """, f AS (SELECT match_id, period, k, NOT coalesce(bool_or(visible) FILTER (WHERE object_type <> 'ball'), false) AS cutaway FROM o GROUP BY ALL), r AS (SELECT DISTINCT match_id, period, k // 12 * 12 AS a, k // 12 * 12 + 11 AS z FROM f)
SELECT r.match_id, r.period, a, count(f.k) FILTER (WHERE cutaway) AS cut, coalesce(bool_and(cutaway), false) AS surely_cutaway FROM r LEFT JOIN f ON f.match_id = r.match_id AND f.period = r.period AND f.k BETWEEN a AND z GROUP BY ALL""")
def cutaway_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a visible player, and half days that have no other."""
    f = checks.cutaways(objects(spark, sf_dir), [*KEYS, "k"])
    a = F.floor(F.col("k") / 12) * 12
    ranges = f.groupBy(*KEYS, a.alias("a"), (a + 11).alias("z")).agg(F.count_if("cutaway").alias("cut"))
    return checks.surely(ranges, f, KEYS, "k", "a", "z", "cutaway", 24).drop("z")


@query("WITH {BOUND}, f AS (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS err, event_type = 'error' AS v, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id)), "
       "g AS (SELECT *, n = 1 OR v IS DISTINCT FROM lag(v) OVER w AS sw FROM f WINDOW w AS (PARTITION BY match_id, period ORDER BY n)) "
       "SELECT event_id, last_value(err IGNORE NULLS) OVER w AS last_err, n - max(CASE WHEN sw THEN n END) OVER w AS since_switch FROM g WINDOW w AS (PARTITION BY match_id, period ORDER BY n)")  # fmt: skip
def context_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known measure of each frame, and how long its view has held."""
    b = bound(spark, sf_dir).withColumns({"err": F.when(F.col("event_type") != "view", F.col("value")), "v": F.col("event_type") == "error"})
    return checks.context_carried(b, KEYS, ["ts_us", "event_id"], ["err"], "v").select("event_id", "last_err", "since_switch")


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS \"offset\", max(l_quantity) - min(l_quantity) AS spread, max(l_quantity) - min(l_quantity) <= 48 AS ok FROM lineitem GROUP BY 1")
def sync_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of the offsets of a supplier's lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("off"))
    return checks.drift(rows, ["l_suppkey"], "off", 48).withColumn("offset", F.round("offset", 6))


@query("""WITH {BOUND}, r AS (SELECT match_id, period, min(ts_us) AS a, max(ts_us) AS z FROM b GROUP BY 1, 2), t AS (SELECT match_id, period, unnest(generate_series(CAST(ceil(a / (12.0 * {HOUR})) AS BIGINT), CAST(ceil(z / (12.0 * {HOUR})) AS BIGINT) - 1)) * 12 * {HOUR} AS tick FROM r)
SELECT match_id, period, tick FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.match_id = t.match_id AND b.period = t.period AND event_type = 'error' AND tick >= b.ts_us AND tick < b.ts_us + 24 * {HOUR})""")
def sampled_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every half day of a series that doesn't follow an error by less than a day."""
    b = bound(spark, sf_dir)
    ticks = checks.periodic(b.groupBy(*KEYS).agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z")), "a", "z", 12 * HOUR).select(*KEYS, "tick")
    marked = b.where("event_type = 'error'").select(*KEYS, "ts_us", (F.col("ts_us") + 24 * HOUR).alias("until"))
    return checks.outside(ticks, marked, KEYS, "tick", "ts_us", "until", 24 * HOUR)


@query("WITH i AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + o_orderkey % 40 - 2 AS z FROM orders), p AS (SELECT *, max(z) OVER (PARTITION BY o_custkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_z FROM i) "
       "SELECT why, count(*) AS n FROM (SELECT CASE WHEN a >= z THEN 'empty' WHEN a < last_z THEN 'overlap' END AS why FROM p) WHERE why IS NOT NULL GROUP BY 1")  # fmt: skip
def interval_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a customer that are empty or overlap."""
    a = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", a.alias("a"), (a + F.col("o_orderkey") % 40 - 2).alias("z"))
    return checks.bad_intervals(rows, ["o_custkey"], "a", "z").groupBy("why").agg(F.count("*").alias("n"))


@query("WITH {BOUND} SELECT CASE WHEN event_type = 'error' THEN 'none' WHEN abs(x) > 50 THEN 'off_image' WHEN p < 0.01 THEN 'estimated' WHEN value > 100 THEN 'far' ELSE 'seen' END AS kind, count(*) AS n FROM b GROUP BY 1")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several reasons, in their order."""
    cases = {"none": F.col("event_type") == "error", "off_image": F.abs("x") > 50, "estimated": F.col("p") < 0.01, "far": F.col("value") > 100}
    return bound(spark, sf_dir).groupBy(checks.ladder(cases, "seen").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH {BOUND}, d AS (SELECT match_id, period, object_id, event_id, ts_us, CASE WHEN event_type <> 'view' THEN x END AS x, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY match_id, period, object_id ORDER BY ts_us, event_id)),
h AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN n END) OVER (PARTITION BY match_id, period, object_id ORDER BY n) AS n1 FROM d),
l AS (SELECT h.*, a.ts_us AS t1, a.x AS x1 FROM h LEFT JOIN h a ON a.match_id = h.match_id AND a.period = h.period AND a.object_id = h.object_id AND a.n = h.n1),
q AS (SELECT l.*, (SELECT max(b2.n) FROM h b2 WHERE b2.match_id = l.match_id AND b2.period = l.period AND b2.object_id = l.object_id AND b2.x IS NOT NULL AND b2.n < l.n1) AS n0 FROM l)
SELECT q.event_id, round(CASE WHEN q.x IS NOT NULL THEN q.x WHEN q.ts_us - t1 <= 24 * {HOUR} THEN x1 + (q.ts_us - t1) * coalesce((x1 - z.x) / nullif(t1 - z.ts_us, 0), 0) END, 6) AS filled_x
FROM q LEFT JOIN h z ON z.match_id = q.match_id AND z.period = q.period AND z.object_id = q.object_id AND z.n = q.n0""")
def tracks_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of objects, hidden ones moved on at their last speed for up to a day."""
    b = bound(spark, sf_dir).select(*KEYS, "object_id", "event_id", "ts_us", F.when(F.col("event_type") != "view", F.col("x")).alias("x"))
    return checks.tracks_filled(b, [*KEYS, "object_id"], "ts_us", ["x"], 24 * HOUR).select("event_id", F.round("filled_x", 6).alias("filled_x"))


@query("WITH {BOUND}, g AS (SELECT event_id, x, y, value / 50 AS vx, p * 10 AS vy FROM b) SELECT event_id, round(atan2(abs((52.5 - x) * (-3.66 - y) - (52.5 - x) * (3.66 - y)), (52.5 - x) * (52.5 - x) + (3.66 - y) * (-3.66 - y)), 9) AS angle, "
       "round(((52.5 - x) * vx - y * vy) / nullif(sqrt((52.5 - x) ** 2 + y ** 2), 0), 6) AS closing, abs(x) > 52.5 OR abs(y) > 34 AS is_out, abs(x) >= 36 AND abs(y) <= 20.16 AS in_area, "
       "sqrt((abs(x) - 52.5) ** 2 + (abs(y) - 34) ** 2) <= 2 OR sqrt(x * x + y * y) <= 2 OR sqrt((abs(x) - 41.5) ** 2 + y * y) <= 2 OR (abs(x) >= 47 AND abs(y) <= 9.16) AS at_spot, x >= 17.5 AS final_third, x >= 26 AND abs(y) <= 25 AS near_box FROM g")  # fmt: skip
def pitch_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles, speeds and zones of places on the pitch."""
    g = bound(spark, sf_dir).select("event_id", "x", "y", (F.col("value") / 50).alias("vx"), (F.col("p") * 10).alias("vy"))
    x, y = F.col("x"), F.col("y")
    return g.select("event_id", F.round(G.goal_angle(x, y), 9).alias("angle"), F.round(G.closing_speed(x, y, F.col("vx"), F.col("vy")), 6).alias("closing"), G.is_out(x, y).alias("is_out"), G.in_penalty_area(x, y).alias("in_area"), G.at_restart_spot(x, y).alias("at_spot"), G.in_final_third(x).alias("final_third"), G.near_box(x, y).alias("near_box"))
