"""Queries on scores, alarms, folds and sequential states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.operators import machines, metrics, possession, sequential
from gridmark.plans.registry import HOUR, KEYS, bound, query, table

TAUS = [0.05, 0.1, 0.2, 0.3]
SCORED = "s AS (SELECT d.source, d.doc_id, least(d.n_chars / 20000, 1.0) AS p, l.toxic AS y FROM documents d JOIN labels l USING (doc_id))"

#: The alarms of all taus as a recursive walk over the rows of each (tau, match, period).
ALARMS = """{BOUND}, r AS (SELECT t.tau, match_id, period, ts_us, CASE WHEN event_type <> 'view' THEN p END AS p, team, event_type = 'error' AS dead, row_number() OVER (PARTITION BY t.tau, match_id, period ORDER BY ts_us, event_id) AS n
  FROM b, (SELECT unnest([{TAUS}]::DOUBLE[]) AS tau) t),
walk AS (SELECT tau, match_id, period, n, ts_us, CASE WHEN p > tau AND NOT dead THEN team END AS team, CASE WHEN p > tau AND NOT dead THEN ts_us END AS start_us, ts_us AS last_p, CAST(NULL AS VARCHAR) AS old_team, CAST(NULL AS BIGINT) AS old_start, CAST(NULL AS VARCHAR) AS why FROM r WHERE n = 1
  UNION ALL
  SELECT tau, match_id, period, n, ts_us, CASE WHEN still THEN w_team WHEN starts THEN r_team END, CASE WHEN still THEN w_start WHEN starts THEN ts_us END, CASE WHEN starts THEN ts_us ELSE lp END, w_team, w_start, why
  FROM (SELECT *, w_team IS NOT NULL AND why IS NULL AS still, NOT (w_team IS NOT NULL AND why IS NULL) AND coalesce(p > tau, false) AND NOT dead AS starts FROM (
    SELECT *, CASE WHEN w_team IS NULL THEN NULL WHEN dead THEN 'dead' WHEN r_team <> w_team THEN 'team' WHEN p < 0.8::DOUBLE * tau THEN 'p' WHEN p IS NULL AND ts_us - lp > 6 * {HOUR} THEN 'stale' END AS why FROM (
      SELECT r.tau, r.match_id, r.period, r.n, r.ts_us, r.p, r.dead, r.team AS r_team, w.team AS w_team, w.start_us AS w_start, CASE WHEN r.p IS NOT NULL THEN r.ts_us ELSE w.last_p END AS lp
      FROM walk w JOIN r ON r.tau = w.tau AND r.match_id = w.match_id AND r.period = w.period AND r.n = w.n + 1)))),
alarms AS (SELECT tau, match_id, period, old_team AS team, old_start AS start_us, ts_us AS end_us, why AS ended_by FROM walk WHERE why IS NOT NULL
  UNION ALL SELECT tau, match_id, period, team, start_us, ts_us, 'period' FROM (SELECT *, max(n) OVER (PARTITION BY tau, match_id, period) AS m FROM walk) WHERE n = m AND team IS NOT NULL)"""
SUMMARY = ALARMS + """, shots AS (SELECT event_id AS shot_id, match_id, period, team, ts_us FROM b WHERE event_type = 'purchase'),
taken AS (SELECT tau, shot_id, alarm, lead_us FROM (SELECT a.tau, s.shot_id, a.match_id || '-' || a.period || '-' || a.start_us AS alarm, s.ts_us - a.start_us AS lead_us, row_number() OVER (PARTITION BY a.tau, s.shot_id ORDER BY s.ts_us > a.end_us, a.start_us DESC) AS n
  FROM shots s JOIN alarms a ON s.match_id = a.match_id AND s.period = a.period AND s.team = a.team AND s.ts_us > a.start_us AND s.ts_us <= a.end_us + {HOUR}) WHERE n = 1),
m AS (SELECT t.tau, count(*) AS shots, count_if(k.shot_id IS NULL) AS missed, quantile_cont(lead_us, 0.5) AS median_lead_us FROM shots s CROSS JOIN (SELECT DISTINCT tau FROM r) t LEFT JOIN taken k ON k.tau = t.tau AND k.shot_id = s.shot_id GROUP BY 1),
f AS (SELECT a.tau, count(*) AS n_alarms, count_if(k.alarm IS NULL) AS false_alarms FROM alarms a LEFT JOIN (SELECT DISTINCT tau, alarm FROM taken) k ON k.tau = a.tau AND k.alarm = a.match_id || '-' || a.period || '-' || a.start_us GROUP BY 1),
z AS (SELECT tau, shots, missed, round(missed / shots, 6) AS miss_rate, round(median_lead_us, 1) AS median_lead_us, coalesce(n_alarms, 0)::BIGINT AS n_alarms, coalesce(false_alarms, 0)::BIGINT AS false_alarms, round(coalesce(false_alarms, 0) / 64, 6) AS false_per_match FROM m LEFT JOIN f USING (tau))"""
_TAUS = ", ".join(map(str, TAUS))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.least(F.col("n_chars") / 20000, F.lit(1.0)).alias("p"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound events as a probability series; views have no prediction, errors are dead."""
    b = bound(spark, sf_dir)
    return b.select(*KEYS, "ts_us", "event_id", F.when(F.col("event_type") != "view", F.col("p")).alias("p"), "team", (F.col("event_type") == "error").alias("dead"))


def all_alarms(spark: SparkSession, sf_dir: str, taus: list[float]) -> DataFrame:
    rows = sequential.swept(series(spark, sf_dir), "tau", taus)
    out = possession.alarms(rows, ["tau", *KEYS], ["event_id"], F.col("tau"), stale_us=6 * HOUR)
    return out.withColumn("alarm_id", F.concat_ws("-", "match_id", "period", "start_us"))


def _limit(params: dict) -> machines.RateLimit:
    return machines.RateLimit(6 * HOUR)


@query(f"WITH {SCORED}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p), c AS (SELECT *, sum(pos) OVER w AS pa, sum(n) OVER w AS na, sum(pos) OVER () AS pall, sum(n) OVER () AS nall FROM g WINDOW w AS (ORDER BY p DESC)) "
       "SELECT sum(n)::BIGINT AS n, sum(pos)::BIGINT AS positives, round(sum(pos * pa / (na * pall)), 9) AS pr_auc, round(sum(pos * ((nall - pall) - (na - pa) + 0.5 * (n - pos)) / (pall * (nall - pall))), 9) AS roc_auc, "
       "(SELECT round(avg((p - y) ** 2), 9) FROM s) AS brier, (SELECT round(avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END), 9) FROM s) AS log_loss FROM c")  # fmt: skip
def threshold_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.threshold_free(scored(spark, sf_dir), "p", "y")
    return m.select("n", "positives", *[F.round(c, 9).alias(c) for c in ("pr_auc", "roc_auc", "brier", "log_loss")])


@query(f"WITH {SCORED}, g AS (SELECT source, p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY source ORDER BY p DESC) AS pa, sum(n) OVER (PARTITION BY source ORDER BY p DESC) AS na, sum(pos) OVER (PARTITION BY source) AS pall FROM g) "
       "SELECT source, sum(n)::BIGINT AS n, CASE WHEN max(pall) > 0 THEN round(sum(pos * pa / (na * pall)), 9) END AS pr_auc FROM c GROUP BY 1")  # fmt: skip
def pr_auc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_free(scored(spark, sf_dir), "p", "y", ["source"]).select("source", "n", F.round("pr_auc", 9).alias("pr_auc"))


@query(f"WITH {SCORED}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM s) "
       "SELECT len(list_filter(q, lambda x: x <= p))::INTEGER AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS share FROM s, e GROUP BY 1")  # fmt: skip
def calibration_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(scored(spark, sf_dir), "p", "y", 10).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("share", 9).alias("share"))


@query("WITH RECURSIVE " + ALARMS.replace("{TAUS}", "0.1") + " SELECT match_id, period, team, start_us, end_us, ended_by FROM alarms")
def alarms_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_alarms(spark, sf_dir, [0.1]).drop("tau", "alarm_id")


def _summary(spark: SparkSession, sf_dir: str, taus: list[float]) -> DataFrame:
    alarms = all_alarms(spark, sf_dir, taus)
    shots = bound(spark, sf_dir).where("event_type = 'purchase'").select(*KEYS, "team", F.col("event_id").alias("shot_id"), "ts_us")
    taken = metrics.score_alarms(sequential.swept(shots, "tau", taus), alarms, [*KEYS, "team"], HOUR, 12 * HOUR, ["tau"])
    s = metrics.alarm_summary(taken, alarms, F.lit(64), ["tau"])
    return s.select("tau", "shots", "missed", F.round("miss_rate", 6).alias("miss_rate"), F.round("median_lead_us", 1).alias("median_lead_us"), "n_alarms", "false_alarms", F.round("false_per_match", 6).alias("false_per_match"))


@query("WITH RECURSIVE " + SUMMARY.replace("{TAUS}", _TAUS) + " SELECT * FROM z")
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms and their scores for every tau in one job."""
    return _summary(spark, sf_dir, TAUS)


@query("WITH RECURSIVE " + SUMMARY.replace("{TAUS}", _TAUS) + " SELECT *, false_per_match > 3 AS over_budget FROM z ORDER BY false_per_match > 3, CASE WHEN false_per_match <= 3 THEN miss_rate ELSE false_per_match END, tau DESC LIMIT 1")
def choose_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.choose_tau(_summary(spark, sf_dir, TAUS), 3)


@query("WITH {BOUND}, k AS (SELECT match_id, period, ts_us // {HOUR} AS k, avg(p) AS p FROM b GROUP BY ALL), s AS (SELECT *, k - row_number() OVER (PARTITION BY match_id, period ORDER BY k) AS seg FROM k), "
       "d AS (SELECT *, CASE WHEN p >= 0.12 THEN 'home' WHEN p <= 0.02 THEN 'away' WHEN row_number() OVER (PARTITION BY match_id, period, seg ORDER BY k) = 1 THEN CASE WHEN p >= 0.5 THEN 'home' ELSE 'away' END END AS t FROM s) "
       "SELECT match_id, period, k, last_value(t IGNORE NULLS) OVER (PARTITION BY match_id, period, seg ORDER BY k) AS smoothed FROM d")  # fmt: skip
def team_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed team per tick: decisive scores switch it, others keep it, a skipped tick forgets it."""
    k = bound(spark, sf_dir).groupBy(*KEYS, F.floor(F.col("ts_us") / HOUR).alias("k")).agg(F.avg("p").alias("p"))
    return possession.team_hysteresis(k, KEYS, "k", "p", high=0.12, low=0.02)


@query("""WITH {BOUND}, f AS (SELECT match_id, period, ts_us, event_id, CASE WHEN value >= 20 THEN object_id END AS candidate, CASE WHEN value >= 20 THEN team END AS candidate_team,
  CASE WHEN event_type <> 'error' THEN x END AS x, CASE WHEN event_type <> 'error' THEN y END AS y FROM b),
s AS (SELECT *, x IS NOT NULL AS seen, x IS NOT NULL AND (abs(x) > 52.5 OR abs(y) > 34) AS ball_out, last_value(CASE WHEN x IS NOT NULL THEN ts_us END IGNORE NULLS) OVER w AS seen_at FROM f WINDOW w AS (PARTITION BY match_id, period ORDER BY ts_us, event_id)),
c AS (SELECT *, seen OR coalesce(ts_us - seen_at > 4 * {HOUR}, true) AS counts, CASE WHEN seen AND NOT ball_out THEN candidate END AS who, CASE WHEN seen AND NOT ball_out THEN candidate_team END AS side FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS n FROM c WHERE counts),
turn AS (SELECT *, n = 1 OR who IS DISTINCT FROM lag(who) OVER (PARTITION BY match_id, period ORDER BY n) AS turns FROM k),
streak AS (SELECT *, sum(turns::INT) OVER (PARTITION BY match_id, period ORDER BY n) AS run FROM turn),
taken AS (SELECT match_id, period, event_id, CASE WHEN who IS NOT NULL AND ts_us - first_value(ts_us) OVER r >= {HOUR} THEN who END AS who, CASE WHEN who IS NOT NULL THEN first_value(ts_us) OVER r END AS streak_from,
  CASE WHEN who IS NOT NULL AND ts_us - first_value(ts_us) OVER r >= {HOUR} THEN first_value(side) OVER r END AS gains FROM streak WINDOW r AS (PARTITION BY match_id, period, run ORDER BY n)),
v AS (SELECT *, CASE WHEN seen AND NOT ball_out AND ts_us > t0 AND ts_us - t0 >= 3 * {HOUR} THEN sqrt((x - x0) ** 2 + (y - y0) ** 2) / ((ts_us - t0) / 1e6) END AS speed FROM (
  SELECT *, first_value(CASE WHEN seen THEN ts_us END IGNORE NULLS) OVER g AS t0, first_value(CASE WHEN seen THEN x END IGNORE NULLS) OVER g AS x0, first_value(CASE WHEN seen THEN y END IGNORE NULLS) OVER g AS y0
  FROM s WINDOW g AS (PARTITION BY match_id, period ORDER BY ts_us RANGE BETWEEN 6 * {HOUR} PRECEDING AND CURRENT ROW))),
i AS (SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS n, NOT ball_out AND speed < 0.0015 AS slow FROM v WHERE ball_out OR speed IS NOT NULL),
j AS (SELECT *, sum((slow AND NOT coalesce(lag_slow, false))::INT) OVER (PARTITION BY match_id, period ORDER BY n) AS rest FROM (SELECT *, lag(slow) OVER (PARTITION BY match_id, period ORDER BY n) AS lag_slow FROM i)),
life AS (SELECT match_id, period, event_id, CASE WHEN ball_out OR (slow AND ((still >= 2 * {HOUR} AND spot) OR (still >= 2 * {HOUR} AND NOT (abs(x) >= 36 AND abs(y) <= 20.16)))) THEN true WHEN speed >= 0.003 THEN false END AS died FROM (
  SELECT *, ts_us - min(CASE WHEN slow THEN ts_us END) OVER (PARTITION BY match_id, period, rest ORDER BY n) AS still,
    sqrt((abs(x) - 52.5) ** 2 + (abs(y) - 34) ** 2) <= 2 OR sqrt(x * x + y * y) <= 2 OR sqrt((abs(x) - 41.5) ** 2 + y * y) <= 2 OR (abs(x) >= 47 AND abs(y) <= 9.16) AS spot FROM j))
SELECT s.match_id, s.period, s.ts_us, s.event_id, last_value(CASE WHEN c.counts THEN coalesce(t.who, -1) END IGNORE NULLS) OVER w AS carrier, last_value(t.gains IGNORE NULLS) OVER w AS possession,
  CASE WHEN s.ts_us - s.seen_at <= 12 * {HOUR} THEN CASE WHEN coalesce(last_value(l.died IGNORE NULLS) OVER w, false) THEN 'dead' ELSE 'alive' END END AS ball_state, t.streak_from, s.ball_out
FROM s JOIN c USING (match_id, period, event_id) LEFT JOIN taken t USING (match_id, period, event_id) LEFT JOIN life l USING (match_id, period, event_id) WINDOW w AS (PARTITION BY s.match_id, s.period ORDER BY s.ts_us, s.event_id)""")
def carrier_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier, possession and ball state over the events as frames; an event of value 20 or more has its object near the ball.  No carrier is -1."""
    near, seen = F.col("value") >= 20, F.col("event_type") != "error"
    rows = bound(spark, sf_dir).select(*KEYS, "ts_us", "event_id", F.when(near, F.col("object_id")).alias("candidate"), F.when(near, F.col("team")).alias("candidate_team"), F.when(seen, F.col("x")).alias("x"), F.when(seen, F.col("y")).alias("y"))
    out = possession.carried(rows, KEYS, ["event_id"], take_us=HOUR, keep_us=4 * HOUR, blind_us=12 * HOUR, window_us=6 * HOUR, slow=0.0015, kick=0.003, spot_us=2 * HOUR, rest_us=2 * HOUR)
    return out.select(*KEYS, "ts_us", "event_id", F.coalesce("carrier", F.lit(-1)).cast("long").alias("carrier"), "possession", "ball_state", "streak_from", "ball_out")


@query("WITH RECURSIVE {BOUND}, r AS (SELECT match_id, period, event_id, ts_us, row_number() OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS n FROM b WHERE p > 0.1), "
       "walk AS (SELECT match_id, period, event_id, ts_us, n FROM r WHERE n = 1 UNION ALL SELECT x.match_id, x.period, x.event_id, x.ts_us, x.n FROM walk w, LATERAL (SELECT * FROM r WHERE r.match_id = w.match_id AND r.period = w.period AND r.ts_us - w.ts_us >= 6 * {HOUR} ORDER BY r.n LIMIT 1) x) "
       "SELECT match_id, period, event_id, ts_us FROM walk")  # fmt: skip
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High scores, none within six hours of the last that was reported."""
    rows = bound(spark, sf_dir).select(*KEYS, "ts_us", "event_id", (F.col("p") > 0.1).alias("mark"))
    return sequential.batch(rows, KEYS, ["ts_us", "event_id"], _limit, "event_id long, ts_us long")


@query("WITH m AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), "
       "k AS (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_orders DESC, c_custkey) - 1) // 5 AS block FROM m) "
       "SELECT c_custkey, c_mktsegment, n_orders, (row_number() OVER (PARTITION BY c_mktsegment, block ORDER BY md5('s:' || c_custkey), c_custkey) - 1)::INTEGER AS fold FROM k")  # fmt: skip
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    m = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_mktsegment", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"))
    return metrics.stratified_folds(m, "c_custkey", "c_mktsegment", "n_orders", 5, "s")


@query("WITH f AS (SELECT n_name, r_name, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
       "SELECT r_name, n_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, count_if(o_orderpriority = '1-URGENT') AS urgent FROM f GROUP BY GROUPING SETS ((), (r_name), (r_name, n_name))")  # fmt: skip
def fold_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled, per-group and per-subgroup rows of the same metrics."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("WITH x AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), y AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) "
       "SELECT count(*) AS n, count_if(y.v > x.v) AS wins, round(avg(y.v - x.v), 4) AS mean_delta FROM x JOIN y USING (k)")  # fmt: skip
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return metrics.paired(m.where("o_orderstatus = 'F'"), m.where("o_orderstatus = 'O'"), ["o_custkey"], "v").withColumn("mean_delta", F.round("mean_delta", 4))
