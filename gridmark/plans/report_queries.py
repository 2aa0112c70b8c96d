"""Queries on reports: summaries, lead times, gates, bins, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.operators import asof, checks, metrics, possession, reports, sequential, tables
from gridmark.plans.registry import HOUR, KEYS, bound, query, table
from gridmark.plans.score_queries import ALARMS, SCORED, SUMMARY, TAUS, _summary, all_alarms, scored, series

_TAUS = ", ".join(map(str, TAUS))


@query("WITH {BOUND} SELECT match_id, count(*) AS n, count_if(event_type = 'purchase') AS shots, count_if(event_type = 'purchase' AND value < 100) AS open_play, count_if(event_type = 'purchase' AND value >= 100) AS goals, count_if(event_type = 'error' AND value >= 100) AS disallowed FROM b GROUP BY 1")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots, open play, goals and disallowed ones of each match."""
    shot, high = F.col("event_type") == "purchase", F.col("value") >= 100
    return reports.flag_counts(bound(spark, sf_dir), ["match_id"], {"shots": shot, "open_play": shot & ~high, "goals": shot & high, "disallowed": (F.col("event_type") == "error") & high})


@query("WITH {BOUND}, m AS (SELECT match_id, match_id % 4 AS source, count(*) AS n, avg((event_type <> 'view')::INT) AS share, count_if(event_type = 'purchase') AS pos FROM b GROUP BY 1, 2) "
       "SELECT source, count(*) AS matches, sum(n)::BIGINT AS rows, round(sum(share * n) / sum(n), 9) AS weighted_share, round(min(share), 9) AS min_share, round(quantile_cont(share, 0.5), 9) AS median_share, round(max(share), 9) AS max_share, sum(pos)::BIGINT AS positives, round(sum(pos) / sum(n), 9) AS rate FROM m GROUP BY 1")  # fmt: skip
def resample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible shares and positives over the matches of each source."""
    m = bound(spark, sf_dir).groupBy("match_id", (F.col("match_id") % 4).alias("source")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") != "view").cast("double")).alias("share"), F.count_if(F.col("event_type") == "purchase").alias("pos"))
    out = reports.share_summary(m, ["source"], "share", "n", "pos")
    return out.select("source", "matches", "rows", "positives", *[F.round(c, 9).alias(c) for c in ("weighted_share", "min_share", "median_share", "max_share", "rate")])


@query("WITH {BOUND}, c AS (SELECT match_id, team, CASE WHEN event_type <> 'view' THEN object_id % 3 // 2 END AS cl FROM b) SELECT match_id, count(*) AS n, count(cl) AS known, round(greatest(count_if((cl = 0) = (team = 'home')), count_if((cl = 1) = (team = 'home'))) / count(cl), 9) AS accuracy, round(count(cl) / count(*), 9) AS coverage FROM c GROUP BY 1")
def mapping_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well two clusters tell the teams apart, under the better naming."""
    c = bound(spark, sf_dir).withColumn("cl", F.when(F.col("event_type") != "view", F.floor(F.col("object_id") % 3 / 2)))
    out = reports.better_mapping(c, ["match_id"], "cl", F.col("team") == "home")
    return out.withColumns({"accuracy": F.round("accuracy", 9), "coverage": F.round("coverage", 9)})


@query("WITH {BOUND} SELECT team, count(*) AS n, round(count_if(value > 150) / count(*), 9) AS airborne_share, round(corr(ln(p + 0.001), ln(value + 1)), 6) AS log_corr FROM b WHERE event_type <> 'error' GROUP BY 1")
def airborne_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged share of rows with a position, and the correlation of two series' logarithms."""
    b = bound(spark, sf_dir).where("event_type <> 'error'")
    flag = tables.shares(b, ["team"], F.col("value") > 150).select("team", "n", F.round("rate", 9).alias("airborne_share"))
    return flag.join(b.groupBy("team").agg(F.round(F.corr(F.ln(F.col("p") + 0.001), F.ln(F.col("value") + 1)), 6).alias("log_corr")), "team")


@query("WITH {BOUND}, q AS (SELECT match_id, period, event_id, ts_us, x, y FROM b WHERE event_type = 'purchase'), r AS (SELECT * FROM b WHERE event_type = 'click'), "
       "j AS (SELECT q.*, r.x AS hx, r.y AS hy, r.ts_us AS ht, row_number() OVER (PARTITION BY q.event_id ORDER BY r.ts_us DESC, r.event_id DESC) AS n FROM q JOIN r ON r.match_id = q.match_id AND r.period = q.period AND r.ts_us <= q.ts_us), "
       "d AS (SELECT match_id, sqrt((x - hx) ** 2 + (y - hy) ** 2) AS d FROM j WHERE n = 1 AND ts_us - ht <= 24 * {HOUR}) "
       "SELECT match_id, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(avg((d <= 20)::INT), 9) AS share_within FROM d GROUP BY 1")  # fmt: skip
def hold_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the last held position, at most a day old."""
    b = bound(spark, sf_dir)
    q = b.where("event_type = 'purchase'").select(*KEYS, "event_id", "ts_us", "x", "y")
    got = asof.asof_backward(q, b.where("event_type = 'click'"), KEYS, "ts_us", "ts_us", {"x": "hx", "y": "hy"}, most_age=24 * HOUR, right_order=["event_id"]).where("hx IS NOT NULL").withColumn("d", F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy")))
    return tables.distances(got, ["match_id"], "d", 20.0).select("match_id", "n", *[F.round(c, 6).alias(c) for c in ("median", "p90")], F.round("share_within", 9).alias("share_within"))


@query("WITH {BOUND} SELECT event_id, k, y, mirrored FROM (SELECT event_id, ts_us // {HOUR} AS k, y, false AS mirrored FROM b WHERE event_type <> 'view' UNION ALL SELECT event_id, ts_us // {HOUR}, -y, true FROM b WHERE event_type <> 'view') WHERE k % 5 = 0")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth tick of usable rows, and its mirror image."""
    rows = bound(spark, sf_dir).where("event_type <> 'view'").select("event_id", F.floor(F.col("ts_us") / HOUR).alias("k"), "y")
    return reports.mirrored_rows(rows, "k", 5, {"y": -F.col("y")})


@query("WITH RECURSIVE " + SUMMARY.replace("{TAUS}", _TAUS) + " SELECT tau, CASE WHEN lead_us IS NULL THEN -1 ELSE (lead_us >= {HOUR})::INT + (lead_us >= 6 * {HOUR})::INT + (lead_us >= 24 * {HOUR})::INT END AS bin, count(*) AS shots "
       "FROM (SELECT t.tau, s.shot_id, k.lead_us FROM shots s CROSS JOIN (SELECT DISTINCT tau FROM r) t LEFT JOIN taken k ON k.tau = t.tau AND k.shot_id = s.shot_id) GROUP BY 1, 2")  # fmt: skip
def lead_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots by how long before them their alarm began, for every tau."""
    shots = bound(spark, sf_dir).where("event_type = 'purchase'").select(*KEYS, "team", F.col("event_id").alias("shot_id"), "ts_us")
    taken = metrics.score_alarms(sequential.swept(shots, "tau", TAUS), all_alarms(spark, sf_dir, TAUS), [*KEYS, "team"], HOUR, 12 * HOUR, ["tau"])
    return reports.lead_table(taken, [HOUR, 6 * HOUR, 24 * HOUR], ["tau"])


@query("WITH RECURSIVE " + SUMMARY.replace("{TAUS}", _TAUS) + " SELECT budget, max_by(tau, -miss_rate * 1000 + tau) AS tau, min(miss_rate) AS miss_rate FROM z, (SELECT unnest([2.0, 5.0, 50.0]) AS budget) WHERE false_per_match <= budget GROUP BY 1")
def matched_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tau to take at each budget of false alarms."""
    return reports.matched_budget(_summary(spark, sf_dir, TAUS), [2.0, 5.0, 50.0])


@query("WITH RECURSIVE " + ALARMS.replace("{TAUS}", "0.05, 0.1, 0.2").replace("FROM b, (SELECT", "FROM b JOIN (SELECT").replace(" AS tau) t),", " AS tau) t ON t.tau = [0.05, 0.1, 0.2][1 + match_id % 3]::DOUBLE),")
       + " SELECT tau, count(*) AS n_alarms, count_if(ended_by = 'team') AS by_team, sum(end_us - start_us)::BIGINT AS total_us FROM alarms GROUP BY 1")
def alarms_at_fold_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of all matches in one job, each with the tau of its fold."""
    taus = F.array(*map(F.lit, (0.05, 0.1, 0.2)))
    rows = series(spark, sf_dir).withColumn("tau", F.element_at(taus, (F.col("match_id") % 3 + 1).cast("int")))
    out = possession.alarms(rows, ["tau", *KEYS], ["event_id"], F.col("tau"), stale_us=6 * HOUR)
    return out.groupBy("tau").agg(F.count("*").alias("n_alarms"), F.count_if(F.col("ended_by") == "team").alias("by_team"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


@query("WITH m AS (SELECT DISTINCT o_orderkey % 97 AS match_id, o_orderpriority AS source FROM orders), f AS (SELECT range AS match_id FROM range(60)) SELECT source, count(*) AS matches, count(f.match_id) AS known, CASE WHEN count(f.match_id) = count(*) THEN 'cv' WHEN count(f.match_id) > 0 THEN 'partial' ELSE 'external' END AS role FROM m LEFT JOIN f USING (match_id) GROUP BY 1")
def assigned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources take part in the folds."""
    m = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("match_id"), F.col("o_orderpriority").alias("source")).distinct()
    return reports.assigned_sources(m, spark.range(60).withColumnRenamed("id", "match_id"), "match_id", "source")


@query("WITH {BOUND}, q AS (SELECT match_id, period, event_id AS shot_id, ts_us, value >= 100 AS goal, unnest([0, 1, 5]) AS back FROM b WHERE event_type = 'purchase'), "
       "j AS (SELECT q.shot_id, q.back, q.goal, b.p, row_number() OVER (PARTITION BY q.shot_id, q.back ORDER BY b.ts_us DESC, b.event_id DESC) AS n FROM q JOIN b ON b.match_id = q.match_id AND b.period = q.period AND b.ts_us <= q.ts_us - q.back * {HOUR}), "
       "v AS (SELECT a.back, a.goal, a.p / nullif(z.p, 0) AS ratio FROM j a JOIN j z ON z.shot_id = a.shot_id AND z.back = 0 AND z.n = 1 WHERE a.n = 1 AND a.back > 0) SELECT back, goal, count(ratio) AS n, round(quantile_cont(ratio, 0.5), 6) AS median_ratio FROM v GROUP BY 1, 2")  # fmt: skip
def shot_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score before a shot over that at the shot: medians by how long before, and by outcome."""
    b = bound(spark, sf_dir)
    q = b.where("event_type = 'purchase'").select(*KEYS, F.col("event_id").alias("shot_id"), (F.col("value") >= 100).alias("goal"), "ts_us", F.explode(F.array(*map(F.lit, (0, 1, 5)))).alias("back")).withColumn("at", F.col("ts_us") - F.col("back") * HOUR)
    got = asof.asof_backward(q, b, KEYS, "at", "ts_us", {"p": "p_at"}, right_order=["event_id"])
    now = got.where("back = 0").select("shot_id", F.col("p_at").alias("p0"))
    rows = got.where("back > 0 AND p_at IS NOT NULL").join(now, "shot_id").withColumn("ratio", F.try_divide("p_at", "p0"))
    return rows.groupBy("back", "goal").agg(F.count("ratio").alias("n"), F.round(F.percentile("ratio", 0.5), 6).alias("median_ratio"))


@query("WITH x AS (SELECT o_orderpriority AS source, count(*) AS n, avg(o_totalprice) AS price, count_if(o_orderstatus = 'F') AS done FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), y AS (SELECT o_orderpriority AS source, count(*) AS n, avg(o_totalprice) AS price, count_if(o_orderstatus = 'F') AS done FROM orders WHERE o_orderkey % 4 < 2 GROUP BY 1), "
       "u AS (SELECT x.source, 'price' AS bar, x.price AS value, y.price * 1.01 AS lim, x.n = y.n AS same FROM x LEFT JOIN y USING (source) UNION ALL SELECT x.source, 'done', x.done, y.done * 1.05, x.n = y.n FROM x LEFT JOIN y USING (source)) "
       "SELECT source, bar, round(value, 4) AS value, round(lim, 4) AS \"limit\", same AND value <= lim AS ok FROM u")  # fmt: skip
def gate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of a run against those of a base with equal denominators."""
    o = table(spark, sf_dir, "orders")
    by = [F.count("*").alias("n"), F.avg("o_totalprice").alias("price"), F.count_if(F.col("o_orderstatus") == "F").alias("done")]
    x, y = (o.where(c).groupBy(F.col("o_orderpriority").alias("source")).agg(*by) for c in ("o_orderkey % 2 = 0", "o_orderkey % 4 < 2"))
    return reports.gate_bars(x, y, ["source"], {"price": 1.01, "done": 1.05}).select("source", "bar", F.round("value", 4).alias("value"), F.round("limit", 4).alias("limit"), "ok")


@query("WITH {BOUND}, c AS (SELECT event_type = 'purchase' AS y, unnest(['value', 'x', 'late']) AS feature, unnest([value, x, CASE WHEN ts_us % 3 = 0 THEN p END]) AS v FROM b), k AS (SELECT feature, v, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM c WHERE v IS NOT NULL), "
       "a AS (SELECT feature, (sum(r) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * count_if(NOT y)) AS auc FROM k GROUP BY 1), n AS (SELECT feature, count(*) AS n, count(v) / count(*) AS finite FROM c GROUP BY 1) "
       "SELECT feature, n, round(auc, 9) AS auc, round(greatest(auc, 1 - auc), 9) AS oriented, round(finite, 9) AS finite, finite >= 0.5 AS useful FROM n LEFT JOIN a USING (feature)")  # fmt: skip
def feature_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each feature alone tells shots from other events."""
    b = bound(spark, sf_dir).withColumns({"y": (F.col("event_type") == "purchase").cast("int"), "late": F.when(F.col("ts_us") % 3 == 0, F.col("p"))}).select("y", "value", "x", "late")
    out = reports.feature_separation(b, ["value", "x", "late"], "y")
    return out.select("feature", "n", *[F.round(c, 9).alias(c) for c in ("auc", "oriented", "finite")], "useful")


@query("WITH r AS (SELECT o_orderpriority AS run, o_custkey % 5 AS fold, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT r.run, round(avg(r.v - z.v), 4) AS mean_delta, count_if(r.v < z.v) AS worse FROM r JOIN r z ON z.fold = r.fold AND z.run = '3-MEDIUM' WHERE r.run <> '3-MEDIUM' GROUP BY 1")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs against a base run, fold by fold."""
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), (F.col("o_custkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("v"))
    return reports.sensitivity(r.where("run <> '3-MEDIUM'"), r.where("run = '3-MEDIUM'"), "run", "fold", "v").withColumn("mean_delta", F.round("mean_delta", 4))


@query("WITH c AS (SELECT p_brand AS name, avg(p_retailprice) AS worth, avg(p_size) AS cost FROM part GROUP BY 1), ok AS (SELECT * FROM c WHERE cost <= 26) SELECT name, round(worth, 4) AS worth, round(cost, 6) AS cost FROM ok WHERE worth >= (SELECT max(worth) FROM ok) - 20 ORDER BY ok.cost, name LIMIT 1")
def picked_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest of the configs that are as good as the best."""
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("worth"), F.avg("p_size").alias("cost"))
    return reports.picked(c, "worth", "cost", 26.0, 20.0, "name").select("name", F.round("worth", 4).alias("worth"), F.round("cost", 6).alias("cost"))


@query(f"WITH {SCORED}, e AS (SELECT * FROM s WHERE source NOT IN (SELECT source FROM s GROUP BY 1 HAVING count(*) >= (SELECT max(n) FROM (SELECT count(*) AS n FROM s GROUP BY source)) * 0.9)), g AS (SELECT source, count(*) AS n, sum(y)::BIGINT AS positives, round(avg((p - y) ** 2), 9) AS brier FROM e GROUP BY 1) SELECT * FROM g")
def external_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the sources that take no part in the folds (here: the small ones)."""
    s = scored(spark, sf_dir)
    sizes = s.groupBy("source").agg(F.count("*").alias("n"))
    inside = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).where("n >= most * 0.9").select("source")  # one row of the largest size
    return metrics.threshold_free(s.join(inside, "source", "left_anti"), "p", "y", ["source"]).select("source", "n", "positives", F.round("brier", 9).alias("brier"))


@query("WITH {BOUND}, f AS (SELECT *, event_type <> 'view' AS fresh, row_number() OVER (PARTITION BY match_id, period ORDER BY ts_us, event_id) AS n FROM b), "
       "t AS (SELECT *, team IS DISTINCT FROM lag(team) OVER (PARTITION BY match_id, period ORDER BY n) AS turned FROM f WHERE fresh), "
       "j AS (SELECT f.*, t.turned FROM f LEFT JOIN t USING (event_id)) "
       "SELECT event_id, ts_us - max(CASE WHEN fresh THEN ts_us END) OVER w AS since_seen, ts_us - max(CASE WHEN turned THEN ts_us END) OVER w AS since_change, ts_us - lag(ts_us) OVER w AS gap, last_value(CASE WHEN fresh THEN team END IGNORE NULLS) OVER w AS held FROM j WINDOW w AS (PARTITION BY match_id, period ORDER BY n)")  # fmt: skip
def native_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old each row's last sighting and last change of team are."""
    return reports.staleness(bound(spark, sf_dir), KEYS, "ts_us", ["event_id"], F.col("event_type") != "view", "team").select("event_id", "since_seen", "since_change", "gap", "held")


@query("WITH {BOUND}, r AS (SELECT least(CAST(floor(value / 50) AS INT), 4) AS bin, p, (event_type = 'purchase')::INT AS y, event_type = 'error' AS wrong FROM b), g AS (SELECT bin, p, sum(y) AS pos, count(*) AS n FROM r GROUP BY 1, 2), "
       "c AS (SELECT *, sum(pos) OVER (PARTITION BY bin ORDER BY p DESC) AS pa, sum(n) OVER (PARTITION BY bin ORDER BY p DESC) AS na, sum(pos) OVER (PARTITION BY bin) AS pall FROM g), a AS (SELECT bin, round(sum(pos * pa / (na * pall)), 9) AS pr_auc FROM c WHERE pall > 0 GROUP BY 1) "
       "SELECT bin, count(*) AS n, sum(y)::BIGINT AS positives, count_if(wrong) AS wrong, round(count(*) / (SELECT count(*) FROM r), 9) AS share, any_value(pr_auc) AS pr_auc FROM r LEFT JOIN a USING (bin) GROUP BY 1")  # fmt: skip
def staleness_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report by bins of a measure: sizes, positives, disagreements and average precision."""
    b = bound(spark, sf_dir).withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    out = reports.binned_report(b, F.least(F.floor(F.col("value") / 50), F.lit(4)).cast("int"), "p", "y", F.col("event_type") == "error")
    return out.select("bin", "n", "positives", "wrong", F.round("share", 9).alias("share"), F.round("pr_auc", 9).alias("pr_auc"))


@query("WITH {BOUND} SELECT m.event_id, min(h.ts_us) - m.ts_us AS delay, CASE WHEN min(h.ts_us) IS NULL THEN 'none' WHEN min(h.ts_us) < m.ts_us THEN 'before' WHEN m.value > 100 THEN 'high' ELSE 'after' END AS cause "
       "FROM b m LEFT JOIN b h ON h.match_id = m.match_id AND h.period = m.period AND h.event_type = 'click' AND h.ts_us BETWEEN m.ts_us - {HOUR} AND m.ts_us + 2 * {HOUR} WHERE m.event_type = 'purchase' GROUP BY m.event_id, m.ts_us, m.value")  # fmt: skip
def cause_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest hit around each mark, and the first of several causes."""
    b = bound(spark, sf_dir)
    marks = b.where("event_type = 'purchase'").select(*KEYS, "event_id", "ts_us", "value")
    got = reports.first_hits(marks, b.where("event_type = 'click'").select(*KEYS, "ts_us"), KEYS, "ts_us", HOUR, 2 * HOUR, "event_id", 12 * HOUR)
    cases = {"none": F.col("delay").isNull(), "before": F.col("delay") < 0, "high": F.col("value") > 100}
    return got.select("event_id", "delay", checks.ladder(cases, "after").alias("cause"))


@query("WITH {BOUND}, a AS (SELECT * FROM b WHERE event_type IN ('purchase', 'signup') AND NOT (event_type = 'signup' AND (match_id, period, ts_us // (6 * {HOUR})) IN (SELECT (match_id, period, ts_us // (6 * {HOUR})) FROM b WHERE event_type = 'purchase'))), "
       "t AS (SELECT DISTINCT match_id, period, (ts_us // (12 * {HOUR}) + 1) * 12 * {HOUR} AS tick FROM b) SELECT t.match_id, t.period, tick, string_agg(a.event_id::VARCHAR, ',' ORDER BY a.ts_us DESC, a.event_id DESC) AS events FROM t JOIN a ON a.match_id = t.match_id AND a.period = t.period AND tick BETWEEN a.ts_us AND a.ts_us + 12 * {HOUR} GROUP BY 1, 2, 3")  # fmt: skip
def active_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the last half day at each tick, newest first, a signup with a purchase beside it left out."""
    b = bound(spark, sf_dir).withColumn("cell", F.floor(F.col("ts_us") / (6 * HOUR)))
    events = b.where("event_type IN ('purchase', 'signup')").select(*KEYS, "ts_us", "event_id", "event_type", "cell")
    ticks = b.select(*KEYS, ((F.floor(F.col("ts_us") / (12 * HOUR)) + 1) * 12 * HOUR).alias("tick")).distinct()
    out = reports.active_feed(events, ticks, KEYS, "ts_us", "tick", 12 * HOUR, F.col("event_type") == "signup", events.where("event_type = 'purchase'"), [*KEYS, "cell"], 24 * HOUR)
    return out.select(*KEYS, "tick", F.array_join(F.transform("events", lambda e: e.cast("string")), ",").alias("events"))


@query("WITH f AS (SELECT o_custkey % 5 AS fold, avg(o_totalprice) AS a, avg(o_totalprice - o_orderkey % 100) AS z, count(*) AS n FROM orders GROUP BY 1) SELECT round(sum(a * n) / sum(n), 4) AS old, round(sum(z * n) / sum(n), 4) AS new, count_if(z < a) AS better, sum(z * n) < sum(a * n) AND count_if(z < a) >= 4 AS take_new FROM f")
def chosen_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a new model is better pooled and on enough folds."""
    f = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("a"), F.avg(F.col("o_totalprice") - F.col("o_orderkey") % 100).alias("z"), F.count("*").alias("n"))
    return reports.chosen_model(f, "fold", "a", "z", "n", 4).withColumns({"old": F.round("old", 4), "new": F.round("new", 4)})


@query("WITH {BOUND}, s AS (SELECT match_id, period, team, ts_us, value < 100 AS open_play FROM b WHERE event_type = 'purchase') SELECT match_id, period, team, ts_us // 1000000 AS second, open_play FROM s WHERE open_play OR match_id % 2 = 0")
def shots_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots of all matches with their open-play flag."""
    s = bound(spark, sf_dir).where("event_type = 'purchase'").withColumn("open_play", F.col("value") < 100)
    return s.where("open_play OR match_id % 2 = 0").select(*KEYS, "team", F.floor(F.col("ts_us") / 1000000).alias("second"), "open_play")
