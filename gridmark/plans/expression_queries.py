"""Queries on expressions over positions, cameras, codes and tapes, and on rules over frames, with the events as a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions import geometry as G
from gridmark.functions import scalars, timing
from gridmark.operators import tables, validate
from gridmark.plans.check_queries import OBJECTS, objects
from gridmark.plans.registry import HOUR, KEYS, bound, query

#: Cameras: a pitch point through a matrix, its inverse, and a rotation that looks along y.
FORWARD = [0.05, 0.0, -50.0, 0.0, 0.05, -30.0, 0.0, 0.001, 1.0]
BACK = [1.6, -1.0, 50.0, 0.0, 1.0, 30.0, 0.0, -0.001, 0.05]
ALONG_Y = [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0]
SHOTS = ["ON TARGET-GOAL", "BLOCKED", "on target-saved", "WOODWORK-OUT", "OFF TARGET-OUT", "OUT", "HEAD"]


def lits(values: list) -> list:
    return [F.lit(v) for v in values]


@query("""WITH {BOUND}, n AS (SELECT *, CASE WHEN event_type <> 'view' THEN team END AS side FROM b)
SELECT event_id, (side = 'home') <> (period = 1) AS flipped, CASE WHEN side IS NULL THEN 0 WHEN (side = 'home') = (period = 1) THEN 1 ELSE -1 END AS attack_sign,
round(CASE WHEN (side = 'home') <> (period = 1) THEN -x ELSE x END, 6) + 0.0 AS turned_x, round(CASE WHEN (side = 'home') <> (period = 1) THEN -y ELSE y END, 6) + 0.0 AS turned_y,
round(((52.5 - x) * value / 10 + 3 * y) / nullif(sqrt((52.5 - x) ** 2 + y ** 2), 0), 6) AS closing,
x BETWEEN 0 AND 52.5 AND y * 0.2 BETWEEN y + x / 52.5 * (-3.66 - y) AND y + x / 52.5 * (3.66 - y) AS in_lane,
abs(x) >= 36 AND abs(y) <= 20.16 AS area,
sqrt((52.5 - abs(x)) ** 2 + (34 - abs(y)) ** 2) <= 2 OR sqrt(x ** 2 + y ** 2) <= 2 OR sqrt((41.5 - abs(x)) ** 2 + y ** 2) <= 2 OR (abs(x) >= 47 AND abs(y) <= 9.16) AS restart_spot FROM n""")
def pitch_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions, turned positions, closing speeds, lanes and spots; views have no team, and a ball stands at the halfway line."""
    x, y, home_right = F.col("x"), F.col("y"), F.col("period") == 1
    side = F.when(F.col("event_type") != "view", F.col("team"))
    turn = G.flipped(side, home_right)
    tx, ty = G.turned(x, y, turn)
    return bound(spark, sf_dir).select(
        "event_id", turn.alias("flipped"), G.attack_sign(side, home_right).alias("attack_sign"), (F.round(tx, 6) + 0.0).alias("turned_x"), (F.round(ty, 6) + 0.0).alias("turned_y"),
        F.round(G.closing_speed(x, y, F.col("value") / 10, F.lit(-3.0)), 6).alias("closing"), G.in_lane(x, y * 0.2, F.lit(0.0), y).alias("in_lane"), G.in_penalty_area(x, y).alias("area"), G.at_restart_spot(x, y).alias("restart_spot"),
    )


@query("""WITH {BOUND}, n AS (SELECT *, 540 + y * 10 AS v, CASE WHEN event_type <> 'error' THEN 900 + x * 20 END AS l FROM b), m AS (SELECT *, (0.05 * v - 30) / (0.001 * v + 1) AS my FROM n)
SELECT event_id, round((0.1 * value - 50) / (0.001 * v + 1), 6) AS mx, round(my, 6) AS my, round(0.352 / (0.05 - 0.001 * my), 6) AS width,
CASE WHEN y > -20 THEN round(1000 * x / (y + 20) + 960, 6) END AS px, CASE WHEN y > -20 THEN round(1000 * (10 - p) / (y + 20) + 540, 6) END AS py,
CASE WHEN value > 200 THEN false WHEN event_type = 'click' THEN true ELSE coalesce(l + 20 > 0 AND v > 0 AND l < 1280 AND v - 30 < 720, false) END AS on_screen FROM m""")
def camera_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image points on the pitch, the width of a ball there, pitch points in a camera, and which boxes are in the picture."""
    u, v = F.col("value") * 2, 540 + F.col("y") * 10
    mx, my = G.projected(u, v, lits(FORWARD))
    px, py = G.pinhole(F.col("x"), F.col("y"), F.col("p"), lits(ALONG_Y), lits([0.0, 10.0, 20.0]), F.lit(1000.0), F.lit(960.0), F.lit(540.0))
    left = F.when(F.col("event_type") != "error", 900 + F.col("x") * 20)
    seen = G.on_screen(F.col("value") > 200, F.when(F.col("event_type") == "click", True), left, v - 30, left + 20, v, 1280, 720)
    numbers = {"mx": mx, "my": my, "width": G.expected_width(u, v, lits(FORWARD), lits(BACK)), "px": px, "py": py}
    return bound(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(n) for n, c in numbers.items()], seen.alias("on_screen"))


@query("""WITH {BOUND}, n AS (SELECT *, ['ON TARGET-GOAL', 'BLOCKED', 'on target-saved', 'WOODWORK-OUT', 'OFF TARGET-OUT', 'OUT', 'HEAD'][1 + event_id % 8] AS shot, md5(CAST(object_id AS VARCHAR)) AS wallet FROM b)
SELECT event_id, CASE substr('CDFGKPTOX', 1 + CAST(event_id % 9 AS INTEGER), 1) WHEN 'C' THEN 'corner' WHEN 'D' THEN 'drop_ball' WHEN 'F' THEN 'free_kick' WHEN 'G' THEN 'goal_kick' WHEN 'K' THEN 'kickoff' WHEN 'P' THEN 'penalty' WHEN 'T' THEN 'throw_in' WHEN 'O' THEN 'open_play' END AS set_piece,
['goal', 'blocked', 'unknown', 'woodwork', 'off_target', 'off_target', 'unknown', 'unknown'][1 + event_id % 8] AS outcome, CASE WHEN event_type <> 'view' THEN team || '_' || object_id END AS player,
round(CASE WHEN team = 'home' THEN value / nullif(value + event_id % 7, 0) ELSE 1 - value / nullif(value + event_id % 7, 0) END, 6) AS home_price,
left(wallet, 6) || '..' || right(wallet, 4) || ' ' || team || ' $' || CAST(round(value) AS BIGINT) || ' @ ' || CAST(least(greatest(round(p * 100), 1), 99) AS INTEGER) || 'c' AS trade,
ts_us + CAST(round(value * 1000000) AS BIGINT) AS utc_us, CAST(round_even(value * 29.97, 0) AS BIGINT) AS frame FROM n""")
def code_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of codes, outcomes and players from texts, prices and lines of trades, moments as UTC and frames; absent texts have defined results."""
    i, v = F.col("event_id"), F.col("value")
    shot = F.get(F.array(*lits(SHOTS)), (i % 8).cast("int"))
    name = F.when(F.col("event_type") != "view", F.concat_ws(" ", F.lit("Player"), F.col("object_id")))
    return bound(spark, sf_dir).select(
        "event_id", scalars.named(F.substring(F.lit("CDFGKPTOX"), (1 + i % 9).cast("int"), F.lit(1)), scalars.SET_PIECES).alias("set_piece"), scalars.shot_outcome(shot).alias("outcome"), scalars.player_ref(F.initcap("team"), name).alias("player"),
        F.round(scalars.home_price(F.col("team"), v, v + i % 7), 6).alias("home_price"), scalars.trade_text(F.md5(F.col("object_id").cast("string")), F.upper("team"), v, F.col("p")).alias("trade"),
        timing.utc_us(F.timestamp_micros("ts_us"), v).alias("utc_us"), timing.frame_of(v).alias("frame"),
    )


@query("WITH {BOUND}, " + OBJECTS + """, w AS (SELECT match_id, period, k, object_id, object_type, x * 1.2 AS x, y FROM o), bad AS (SELECT * FROM w WHERE abs(x) > 52.5 OR abs(y) > 34),
r AS (SELECT *, k - row_number() OVER (PARTITION BY match_id, period ORDER BY k) AS run FROM (SELECT DISTINCT match_id, period, k FROM bad))
SELECT match_id, period, min(k) AS first, max(k) AS last, count(DISTINCT object_id) AS n_objects, string_agg(DISTINCT object_type, ',' ORDER BY object_type) AS types, round(max(abs(x)), 6) AS max_x, round(max(abs(y)), 6) AS max_y
FROM bad JOIN r USING (match_id, period, k) GROUP BY match_id, period, run""")
def off_pitch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with objects off a pitch that is too small for them."""
    runs = validate.off_pitch_runs(objects(spark, sf_dir).withColumn("x", F.col("x") * 1.2), KEYS, "k")
    return runs.withColumns({c: F.round(c, 6) for c in ("max_x", "max_y")})


@query("""WITH {BOUND}, f AS (SELECT CAST(match_id AS VARCHAR) AS match_id, event_id, period + 3 AS period, value, event_type, CASE WHEN event_type <> 'error' THEN team END AS side,
lag(period + 3) OVER w AS old_period, lag(value) OVER w AS old_value FROM b WINDOW w AS (PARTITION BY match_id ORDER BY event_id)),
r AS (SELECT match_id, unnest([{'rule': 'period decreases', 'bad': period < old_period}, {'rule': 'timestamp decreases', 'bad': period = old_period AND value < old_value}, {'rule': 'shootout is alive', 'bad': period = 5 AND event_type <> 'view'},
{'rule': 'carrier without team', 'bad': value < 50 AND side IS NULL}, {'rule': 'set play without team', 'bad': value > 100 AND side IS NULL}]) AS u FROM f)
SELECT match_id, 'frames' AS "table", u.rule AS rule, count(*) AS n_bad FROM r WHERE u.bad GROUP BY ALL""")
def frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on frames over all matches in one plan: an event is a frame, its value the clock, and an error has no team."""
    frames = bound(spark, sf_dir).select(
        F.col("match_id").cast("string").alias("match_id"), F.col("event_id").alias("frame_id"), (F.col("period") + 3).alias("period"), F.col("value").alias("timestamp_s"), F.when(F.col("event_type") == "view", "dead").otherwise("alive").alias("ball_state"),
        F.when(F.col("value") < 50, F.col("object_id").cast("string")).alias("ball_carrier_id"), F.when(F.col("event_type") != "error", F.col("team")).alias("possession_team"), (F.col("value") > 100).alias("set_play_phase"),
    )
    return validate.frame_rules(frames).drop("sample")


@query("WITH {BOUND}, " + """g AS (SELECT match_id, period, ts_us // {HOUR} AS k, arg_min(team, event_id) AS team FROM b GROUP BY ALL), s AS (SELECT match_id, period, ts_us // {HOUR} AS k, arg_min(event_type, event_id) AS fresh, min(value) AS age FROM b WHERE event_type <> 'view' GROUP BY ALL)
SELECT match_id, period, k, CASE WHEN age <= 30 THEN fresh END AS team, age IS NOT NULL AS covered FROM g LEFT JOIN s USING (match_id, period, k)""")
def swapped_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid column replaced by a state's, null where that is too old; hours that the state lacks are marked."""
    b = bound(spark, sf_dir).withColumn("k", F.floor(F.col("ts_us") / HOUR))
    grid = b.groupBy(*KEYS, "k").agg(F.min_by("team", "event_id").alias("team"))
    state = b.where("event_type != 'view'").groupBy(*KEYS, "k").agg(F.min_by("event_type", "event_id").alias("team"), F.min("value").alias("age"))
    return tables.swapped(grid, state, [*KEYS, "k"], "team", "age", 30)
