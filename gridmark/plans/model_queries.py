"""Queries on feature bundles, models and faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions.scalars import uniform
from gridmark.operators import asof, augment, features, models
from gridmark.plans.registry import HOUR, KEYS, bound, query, table

GRID = """{BOUND}, g AS (SELECT match_id, period, unnest(generate_series(CAST(ceil(min(ts_us) / {HOUR}.0) AS BIGINT), CAST(floor(max(ts_us) / {HOUR}.0) AS BIGINT))) AS k FROM b GROUP BY 1, 2),
f AS (SELECT g.match_id, g.period, g.k, CASE WHEN g.k * {HOUR} - b.ts_us <= 6 * {HOUR} THEN b.team END AS possession_team, possession_team = 'away' AS flipped FROM g ASOF LEFT JOIN b ON g.match_id = b.match_id AND g.period = b.period AND g.k * {HOUR} >= b.ts_us),
o AS (SELECT match_id, period, ts_us // {HOUR} AS k, event_id, event_type, x, y FROM b)"""


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bound events as a match's grid and objects: ticks are hours, a view is the ball, other events are players."""
    b = bound(spark, sf_dir)
    frames = asof.resampled(b, KEYS, "ts_us", HOUR, {"team": "possession_team"}, 6 * HOUR, ["event_id"]).drop("tick").withColumn("flipped", F.col("possession_team") == "away")
    ball = F.col("event_type") == "view"
    objects = b.select(*KEYS, F.floor(F.col("ts_us") / HOUR).alias("k"), F.when(ball, F.format_string("ball_%09d", "event_id")).otherwise(F.format_string("p_%09d", "event_id")).alias("object_id"), F.when(ball, "ball").when(F.col("event_type") == "error", "goalkeeper").otherwise("player").alias("object_type"), F.when(~ball, F.col("team")).alias("team"), "x", "y", F.lit(None).cast("double").alias("z"), (F.col("event_type") != "signup").alias("visible"))
    return frames, objects


@query("WITH " + GRID + """, t AS (SELECT match_id, period, k, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y FROM o WHERE event_type = 'view' GROUP BY ALL),
h AS (SELECT f.*, CASE WHEN f.k - t.k <= 10 THEN t.x END AS bx, CASE WHEN f.k - t.k <= 10 THEN t.y END AS oy, CASE WHEN f.k - t.k <= 10 THEN (f.k - t.k) / 10 END AS age FROM f ASOF LEFT JOIN (SELECT t.* FROM t SEMI JOIN f ON t.match_id = f.match_id AND t.period = f.period AND t.k = f.k) t ON f.match_id = t.match_id AND f.period = t.period AND f.k >= t.k),
s AS (SELECT *, CASE WHEN flipped THEN -1 ELSE 1 END AS s FROM h)
SELECT match_id, period, k, round(bx * s, 6) AS ball_x, round(sqrt((52.5 - bx * s) ** 2 + oy ** 2), 6) AS ball_dist, round(age, 6) AS ball_age_s, bx * s BETWEEN 36 AND 52.5 AND abs(oy) <= 20.16 AS in_box FROM s""")
def ball_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, objects = grid(spark, sf_dir)
    rows = features.ball_features(features.held_ball(features.gridded(frames), objects))
    return rows.select(*KEYS, "k", *[F.round(c, 6).alias(c) for c in ("ball_x", "ball_dist", "ball_age_s")], "in_box")


@query("WITH " + GRID + """, n AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR possession_team IS DISTINCT FROM lag(possession_team) OVER w THEN k END AS turn FROM f WINDOW w AS (PARTITION BY match_id, period ORDER BY k))
SELECT match_id, period, k, round((k - last_value(turn IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY k)) / 10, 6) AS possession_s FROM n""")
def possession_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.possession_seconds(grid(spark, sf_dir)[0]).select(*KEYS, "k", F.round("possession_s", 6).alias("possession_s"))


@query()
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature bundle over every match in one plan."""
    return features.match_features(*grid(spark, sf_dir))


@query()
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, objects = grid(spark, sf_dir)
    nodes = features.graph_nodes(features.held_ball(features.gridded(frames), objects), objects)
    return nodes.select(*KEYS, "k", F.size("players").alias("n_players"), F.round("ball.x", 6).alias("ball_x"), F.round(F.get("players", F.lit(0))["ball_dist"], 6).alias("nearest"))


@query()
def augment_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with noise, misses, changed teams and broken ids, and by how much each was moved."""
    frames, objects = grid(spark, sf_dir)
    worse = augment.applied(objects, frames.select(*KEYS, "k"), {"player_noise": 0.9, "ball_miss": 0.1, "team_flip": 0.05, "id_fragment": 20.0}, "s")
    return worse.select(*KEYS, "k", "object_id", "object_type", "team", F.round("x", 6).alias("x"), "visible")


@query()
def correlated_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.correlated(bound(spark, sf_dir), KEYS, "ts_us", "event_id", 6 * HOUR, 1.0, "s")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, label = table(spark, sf_dir, "documents").select("doc_id", "source", (F.ln(F.col("n_chars") + 1)).alias("size"), uniform(F.col("source")).alias("place")), table(spark, sf_dir, "labels")
    return d.join(label, "doc_id").withColumn("fold", F.pmod(F.xxhash64("source"), F.lit(5)).cast("int"))


@query()
def logistic_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the floor model; folds are groups of sources, so no source is in training and scoring."""
    rows = _training(spark, sf_dir)
    return models.out_of_fold(rows, ["size", "place"], "toxic", "fold", [0, 1, 2, 3, 4]).select("doc_id", "fold", F.round("p", 6).alias("p"))


@query()
def recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores mapped by a sigmoid of their logit that is fitted on the other half."""
    rows = _training(spark, sf_dir).withColumn("p", F.least(F.greatest(F.col("size") / 12, F.lit(0.01)), F.lit(0.99)))
    a, b = models.recalibration(rows.where("fold < 3"), "p", "toxic")
    return rows.select("doc_id", F.round(models.recalibrated(F.col("p"), a, b), 6).alias("p"))
