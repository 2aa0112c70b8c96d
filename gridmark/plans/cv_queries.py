"""Nested folds, states by context and kept fits, over the bound events as matches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.operators import crossval, labels, metrics
from gridmark.plans.model_queries import grid
from gridmark.plans.registry import HOUR, KEYS, bound, query
from gridmark.session import shared_dir

TAUS = [0.05, 0.1, 0.15, 0.2]
MOST_FALSE = 3
#: A row's event, the band of its value, and whether its team has a purchase in the six hours after it.
LEARNER = crossval.Rates(("event_type", "band"), "y")


def walked(name: str, rows: str, keys: list[str]) -> str:
    """The alarms of ``rows`` (keys, ts_us, p, team, dead, n) as SQL tables: a recursive walk over the rows of each group."""
    k, rk = ", ".join(keys), ", ".join(f"r.{c}" for c in keys)
    on = " AND ".join(f"r.{c} = w.{c}" for c in keys)
    return f"""{name}_walk AS (SELECT {k}, tau, n, ts_us, CASE WHEN p > tau AND NOT dead THEN team END AS team, CASE WHEN p > tau AND NOT dead THEN ts_us END AS start_us, ts_us AS last_p, CAST(NULL AS VARCHAR) AS old_team, CAST(NULL AS BIGINT) AS old_start, CAST(NULL AS VARCHAR) AS why FROM {rows} WHERE n = 1
  UNION ALL
  SELECT {k}, tau, n, ts_us, CASE WHEN still THEN w_team WHEN starts THEN r_team END, CASE WHEN still THEN w_start WHEN starts THEN ts_us END, CASE WHEN starts THEN ts_us ELSE lp END, w_team, w_start, why
  FROM (SELECT *, w_team IS NOT NULL AND why IS NULL AS still, NOT (w_team IS NOT NULL AND why IS NULL) AND coalesce(p > tau, false) AND NOT dead AS starts FROM (
    SELECT *, CASE WHEN w_team IS NULL THEN NULL WHEN dead THEN 'dead' WHEN r_team <> w_team THEN 'team' WHEN p < 0.8::DOUBLE * tau THEN 'p' WHEN p IS NULL AND ts_us - lp > 6 * {{HOUR}} THEN 'stale' END AS why FROM (
      SELECT {rk}, r.tau, r.n, r.ts_us, r.p, r.dead, r.team AS r_team, w.team AS w_team, w.start_us AS w_start, CASE WHEN r.p IS NOT NULL THEN r.ts_us ELSE w.last_p END AS lp
      FROM {name}_walk w JOIN {rows} r ON {on} AND r.n = w.n + 1)))),
{name} AS (SELECT {k}, tau, old_team AS team, old_start AS start_us, ts_us AS end_us, why AS ended_by FROM {name}_walk WHERE why IS NOT NULL
  UNION ALL SELECT {k}, tau, team, start_us, ts_us, 'period' FROM (SELECT *, max(n) OVER (PARTITION BY {k}) AS m FROM {name}_walk) WHERE n = m AND team IS NOT NULL)"""


FOLDS_SQL = """{BOUND},
m AS (SELECT match_id, source, size, row_number() OVER (PARTITION BY source, block ORDER BY md5('cv:' || match_id), match_id) - 1 AS fold FROM (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size DESC, match_id) - 1) // 5 AS block FROM (SELECT match_id, match_id % 2 AS source, count_if(event_type = 'purchase') AS size FROM b GROUP BY 1))),
e AS (SELECT m.*, o.o AS c FROM m, (SELECT unnest([0, 1, 2, 3, 4, -1]) AS o) o),
ro AS (SELECT c, match_id, CASE WHEN row_number() OVER (PARTITION BY c, source, block ORDER BY md5('inner:' || c || ':' || match_id), match_id) = 1 THEN 'inner' ELSE 'fit' END AS role FROM (
    SELECT *, (row_number() OVER (PARTITION BY c, source ORDER BY size DESC, match_id) - 1) // 7 AS block FROM e WHERE fold <> c)
  UNION ALL SELECT c, match_id, 'test' FROM e WHERE fold = c),
pl AS (SELECT c, 'inner' AS part, match_id, CASE WHEN role = 'fit' THEN 'train' ELSE 'score' END AS use FROM ro WHERE role <> 'test'
  UNION ALL SELECT c, 'outer', match_id, CASE WHEN role = 'test' THEN 'score' ELSE 'train' END FROM ro WHERE c <> -1),
x AS (SELECT event_id, match_id, period, ts_us, team, event_type, event_type = 'error' AS dead, CAST(floor(value / 50) AS BIGINT) AS band,
  (count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY match_id, period, team ORDER BY ts_us RANGE BETWEEN 1 FOLLOWING AND 6 * {HOUR} FOLLOWING) > 0)::INT AS y FROM b),
ce AS (SELECT c, part, event_type, band, sum(y) AS pos, count(*) AS n FROM x JOIN pl USING (match_id) WHERE use = 'train' GROUP BY ALL),
ba AS (SELECT c, part, sum(pos) / sum(n) AS base FROM ce GROUP BY ALL),
s AS (SELECT pl.c, pl.part, x.*, coalesce((ce.pos + 20 * base) / (ce.n + 20), base) AS p FROM x JOIN pl ON x.match_id = pl.match_id AND use = 'score' JOIN ba ON ba.c = pl.c AND ba.part = pl.part
  LEFT JOIN ce ON ce.c = pl.c AND ce.part = pl.part AND ce.event_type = x.event_type AND ce.band = x.band)"""
TAUS_SQL = FOLDS_SQL + """,
ri AS (SELECT c, t.tau, match_id, period, ts_us, p, team, dead, row_number() OVER (PARTITION BY c, t.tau, match_id, period ORDER BY ts_us, event_id) AS n FROM s, (SELECT unnest([""" + ", ".join(map(str, TAUS)) + """]::DOUBLE[]) AS tau) t WHERE part = 'inner'),
""" + walked("ia", "ri", ["c", "tau", "match_id", "period"]).replace("SELECT c, tau, match_id, period, tau,", "SELECT c, tau, match_id, period,").replace("SELECT r.c, r.tau, r.match_id, r.period, r.tau,", "SELECT r.c, r.tau, r.match_id, r.period,") + """,
hm AS (SELECT c, match_id FROM pl WHERE part = 'inner' AND use = 'score'),
sh AS (SELECT hm.c, t.tau, event_id AS shot_id, b.match_id, period, team, ts_us FROM b JOIN hm USING (match_id), (SELECT DISTINCT tau FROM ri) t WHERE event_type = 'purchase'),
tk AS (SELECT * FROM (SELECT s.c, s.tau, s.shot_id, a.match_id || '-' || a.period || '-' || a.start_us AS alarm, s.ts_us - a.start_us AS lead_us, row_number() OVER (PARTITION BY s.c, s.tau, s.shot_id ORDER BY s.ts_us > a.end_us, a.start_us DESC) AS n
  FROM sh s JOIN ia a ON s.c = a.c AND s.tau = a.tau AND s.match_id = a.match_id AND s.period = a.period AND s.team = a.team AND s.ts_us > a.start_us AND s.ts_us <= a.end_us + {HOUR}) WHERE n = 1),
mi AS (SELECT s.c, s.tau, count(*) AS shots, count_if(k.shot_id IS NULL) AS missed FROM sh s LEFT JOIN tk k ON k.c = s.c AND k.tau = s.tau AND k.shot_id = s.shot_id GROUP BY ALL),
fa AS (SELECT a.c, a.tau, count(*) AS n_alarms, count_if(k.alarm IS NULL) AS false_alarms FROM ia a LEFT JOIN (SELECT DISTINCT c, tau, alarm FROM tk) k ON k.c = a.c AND k.tau = a.tau AND k.alarm = a.match_id || '-' || a.period || '-' || a.start_us GROUP BY ALL),
su AS (SELECT mi.c, mi.tau, shots, missed, missed / shots AS miss_rate, coalesce(n_alarms, 0) AS n_alarms, coalesce(false_alarms, 0) AS false_alarms, coalesce(false_alarms, 0) / (SELECT count(*) FROM hm WHERE hm.c = mi.c) AS false_per_match FROM mi LEFT JOIN fa USING (c, tau)),
ch AS (SELECT *, false_per_match > 3 AS over_budget FROM su QUALIFY row_number() OVER (PARTITION BY c ORDER BY false_per_match > 3, CASE WHEN false_per_match <= 3 THEN miss_rate ELSE false_per_match END, tau DESC) = 1)"""


def series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, matches, shots): the bound events with cells and labels, their matches with folds, and the purchases."""
    b = bound(spark, sf_dir)
    shots = b.where("event_type = 'purchase'")
    rows = b.select("event_id", *KEYS, "ts_us", "team", "event_type", (F.col("event_type") == "error").alias("dead"), F.floor(F.col("value") / 50).alias("band"), "value", "x", "y")
    rows = labels.counts_ahead(rows.withColumnRenamed("y", "at_y"), shots.withColumn("kind", F.lit("shot")), [*KEYS, "team"], "ts_us", "ts_us", ["shot"], {"h": 6 * HOUR})
    rows = rows.withColumn("y", (F.col("n_shot_h") > 0).cast("int")).drop("n_shot_h")
    matches = b.groupBy("match_id").agg((F.first("match_id") % 2).alias("source"), F.count_if(F.col("event_type") == "purchase").alias("size"))
    return rows, metrics.stratified_folds(matches, "match_id", "source", "size", 5, "cv"), shots.select(*KEYS, "team", F.col("event_id").alias("shot_id"), "ts_us")


def nested(spark: SparkSession, sf_dir: str) -> tuple[crossval.Nested, DataFrame]:
    """The nested scores of the rate model, and the chosen tau of each context."""
    rows, matches, shots = series(spark, sf_dir)
    n = crossval.nested_scores(rows, matches, LEARNER, "match_id")
    return n, crossval.fold_taus(n, shots, MOST_FALSE, "match_id", KEYS, ["event_id"], HOUR, 12 * HOUR, TAUS, stale_us=6 * HOUR)


@query("WITH " + FOLDS_SQL + " SELECT c AS outer_fold, part, match_id, period, event_id, round(p, 9) AS p FROM s")
def nested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inner and every tested row, each scored by a model that never saw its match."""
    n = nested(spark, sf_dir)[0]
    return n.inner.unionByName(n.outer).select(F.col("outer").cast("int").alias("outer_fold"), "part", *KEYS, "event_id", F.round("p", 9).alias("p"))


@query("WITH RECURSIVE " + TAUS_SQL + " SELECT c AS outer_fold, tau, shots, missed, round(miss_rate, 6) AS miss_rate, n_alarms::BIGINT AS n_alarms, false_alarms::BIGINT AS false_alarms, round(false_per_match, 6) AS false_per_match, over_budget FROM ch")
def nested_taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each context's tau, chosen on its inner matches; -1 is the final one."""
    t = nested(spark, sf_dir)[1]
    return t.select(F.col("outer").cast("int").alias("outer_fold"), "tau", "shots", "missed", F.round("miss_rate", 6).alias("miss_rate"), "n_alarms", "false_alarms", F.round("false_per_match", 6).alias("false_per_match"), "over_budget")


@query("WITH RECURSIVE " + TAUS_SQL + """,
rt AS (SELECT s.c, ch.tau, match_id, period, ts_us, p, team, dead, row_number() OVER (PARTITION BY s.c, match_id, period ORDER BY ts_us, event_id) AS n FROM s JOIN ch ON ch.c = s.c WHERE part = 'outer'),
""" + walked("oa", "rt", ["c", "match_id", "period"]) + " SELECT c AS outer_fold, tau, match_id, period, team, start_us, end_us, ended_by FROM oa")  # fmt: skip
def nested_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms of every match at the tau of its own fold."""
    n, taus = nested(spark, sf_dir)
    return crossval.outer_alarms(n, taus, KEYS, ["event_id"], stale_us=6 * HOUR).withColumn("outer_fold", F.col("outer").cast("int")).drop("outer")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, period, k, band, busy, home): the hours with events, their mean place and number, and on which side of the diagonal they lie."""
    b = bound(spark, sf_dir).withColumn("k", F.floor(F.col("ts_us") / HOUR))
    by = b.groupBy(*KEYS, "k").agg(F.avg("x").alias("x"), F.count("*").alias("n"), F.round(F.avg(F.col("x") + F.col("y")), 6).alias("side"))
    return by.select(*KEYS, "k", F.floor(F.round("x", 6) / 15).alias("band"), F.least("n", F.lit(3)).alias("busy"), (F.col("side") > 0).cast("int").alias("home"))


HOURS_SQL = """h AS (SELECT match_id, period, ts_us // {HOUR} AS k, CAST(floor(round(avg(x), 6) / 15) AS BIGINT) AS band, least(count(*), 3) AS busy, (round(avg(x + y), 6) > 0)::INT AS home FROM b GROUP BY ALL)"""
STATES_SQL = FOLDS_SQL + ", " + HOURS_SQL + """,
pp AS (SELECT o.fold AS c, f.fold, least(o.fold, f.fold) AS fa, greatest(o.fold, f.fold) AS fb FROM (SELECT DISTINCT fold FROM m) o, (SELECT DISTINCT fold FROM m) f),
tc AS (SELECT fa, fb, band, busy, sum(home) AS pos, count(*) AS n FROM h JOIN m USING (match_id), (SELECT DISTINCT fa, fb FROM pp) t WHERE m.fold <> fa AND m.fold <> fb GROUP BY ALL),
tb AS (SELECT fa, fb, sum(pos) / sum(n) AS base FROM tc GROUP BY ALL),
sp AS (SELECT pp.c, h.match_id, period, k, coalesce((tc.pos + 20 * base) / (tc.n + 20), base) AS p FROM h JOIN m USING (match_id) JOIN pp ON pp.fold = m.fold JOIN tb USING (fa, fb) LEFT JOIN tc ON tc.fa = pp.fa AND tc.fb = pp.fb AND tc.band = h.band AND tc.busy = h.busy),
sg AS (SELECT *, k - row_number() OVER (PARTITION BY c, match_id, period ORDER BY k) AS seg FROM sp),
sd AS (SELECT *, CASE WHEN p >= 0.55 THEN 'home' WHEN p <= 0.45 THEN 'away' WHEN row_number() OVER (PARTITION BY c, match_id, period, seg ORDER BY k) = 1 THEN CASE WHEN p >= 0.5 THEN 'home' ELSE 'away' END END AS t FROM sg)
SELECT c AS outer_fold, match_id, period, k, last_value(t IGNORE NULLS) OVER (PARTITION BY c, match_id, period, seg ORDER BY k) AS possession_team FROM sd"""


@query("WITH " + STATES_SQL)
def context_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned team of every hour in each of five contexts, one table, by models that saw neither the hour's match nor the context's fold."""
    matches = series(spark, sf_dir)[1]
    learner, path = crossval.Rates(("band", "busy"), "home"), f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    states = crossval.learned_states(hours(spark, sf_dir), matches, learner, "match_id", KEYS, "k", path, high=0.55, low=0.45)
    return states.withColumn("outer_fold", F.col("outer").cast("int")).drop("outer")


@query()
def nested_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor model on the grid's ball features with nested folds: scores of the tested ticks."""
    from gridmark.operators import features

    frames, objects = grid(spark, sf_dir)
    ball = features.ball_features(features.held_ball(features.gridded(frames), objects))
    _, matches, shots = series(spark, sf_dir)
    ticks = ball.select(*KEYS, "k", "ball_dist", "ball_age_s", (F.col("k") * HOUR).alias("ts_us"))
    rows = labels.counts_ahead(ticks, shots.withColumn("kind", F.lit("shot")), KEYS, "ts_us", "ts_us", ["shot"], {"h": 2 * HOUR}).withColumn("y", (F.col("n_shot_h") > 0).cast("int"))
    n = crossval.nested_scores(rows, matches, crossval.Logistic(("ball_dist", "ball_age_s"), "y"), "match_id")
    return n.outer.select(F.col("outer").cast("int").alias("outer_fold"), *KEYS, "k", F.round("p", 6).alias("p"))


@query()
def fit_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on all folds but the first, stopped early on held-out matches and refitted at the best round; the first fold's rows, scored."""
    rows, matches, _ = series(spark, sf_dir)
    learner = crossval.Boosted(("value", "x", "at_y"), "y", "match_id", f"{shared_dir(spark)}/fits-{uuid.uuid4().hex}", rounds=8, depth=3, rate=0.3)
    first = matches.where("fold = 0").select("match_id")
    model = learner.fit(rows.join(first, "match_id", "left_anti").withColumn("outer", F.lit(0)), ["outer"])
    scored = learner.score(model, rows.join(first, "match_id", "left_semi").withColumn("outer", F.lit(0)), ["outer"])
    return scored.select(*KEYS, "event_id", F.round("p", 6).alias("p"), F.lit(model[0][1].best_round).alias("best_round"))
