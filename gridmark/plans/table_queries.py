"""Queries on validation, aggregation, set operations and market tapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.functions import geometry as G
from gridmark.functions import scalars, timing
from gridmark.operators import crowds, market, reviews, tables, validate, windows
from gridmark.plans.registry import HOUR, KEYS, bound, exact, query, table


@query("""WITH r AS (
SELECT o_orderstatus AS match_id, 'orders' AS "table", 'price outside its bounds' AS rule, count_if(o_totalprice > 450000) AS n_bad FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, 'orders', 'customer unknown', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1
UNION ALL SELECT o_orderstatus, 'orders', 'date decreases', count(*) FROM (SELECT o_orderstatus, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS d FROM orders) WHERE d GROUP BY 1)
SELECT * FROM r WHERE n_bad > 0""")
def validate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, monotony and orphans as one report, with an order status as the match."""
    o = table(spark, sf_dir, "orders").withColumn("match_id", F.col("o_orderstatus"))
    w = Window.partitionBy("match_id").orderBy("o_orderkey")
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    own = validate.rules(o, "orders", "match_id", {"price outside its bounds": F.col("o_totalprice") > 450000})
    falls = validate.rules(o.withColumn("d", F.col("o_orderdate") < F.lag("o_orderdate").over(w)), "orders", "match_id", {"date decreases": F.col("d")})
    return own.unionByName(falls).unionByName(validate.orphans(o, "orders", known, ["o_custkey"], "customer unknown")).drop("sample")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(quantile_cont(l_quantity, 0.9), 4) AS p90, count_if(l_discount = 0) AS no_discount, bool_or(l_tax > 0.07) AS any_taxed FROM lineitem GROUP BY 1, 2")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash aggregation with distinct counts, exact quantiles, conditional counts and flags."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.percentile("l_quantity", 0.9), 4).alias("p90"), F.count_if(F.col("l_discount") == 0).alias("no_discount"), F.bool_or(F.col("l_tax") > 0.07).alias("any_taxed"),
    )


@query("WITH {BOUND}, d AS (SELECT team, CASE WHEN abs(x) > 50 THEN 'far' WHEN event_type = 'error' THEN 'error' WHEN row_number() OVER (PARTITION BY match_id, period, object_id, ts_us // {HOUR} ORDER BY ts_us, event_id) > 1 THEN 'repeat' END AS reason FROM b) SELECT team, reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY ALL")
def drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a conversion would drop, counted by reason instead of deleted."""
    b = bound(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy(*KEYS, "object_id", F.floor(F.col("ts_us") / HOUR)).orderBy("ts_us", "event_id"))
    reason = F.when(F.abs("x") > 50, "far").when(F.col("event_type") == "error", "error").when(F.col("n") > 1, "repeat")
    return tables.drop_report(b.withColumn("n", n).withColumn("reason", reason), "reason", ["team"])


@query("""WITH {BOUND}, k AS (SELECT *, ts_us // (24 * {HOUR}) AS day FROM b), t AS (SELECT match_id, period, day, arg_min(x, event_id) AS bx, arg_min(y, event_id) AS oy FROM k WHERE event_type = 'view' GROUP BY ALL),
d AS (SELECT k.match_id, k.period, k.day, k.event_id, k.team, sqrt((k.x - bx) ** 2 + (k.y - oy) ** 2) AS d FROM k JOIN t USING (match_id, period, day) WHERE k.event_type <> 'view')
SELECT match_id, period, day, event_id AS object_id, team, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY match_id, period, day ORDER BY d, event_id) AS n FROM d WHERE d <= 30) WHERE n = 1""")
def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the event nearest to the day's first view, within 30 metres."""
    k = exact(bound(spark, sf_dir)).withColumn("day", F.floor(F.col("ts_us") / (24 * HOUR)))
    on = [*KEYS, "day"]
    t = k.where("event_type = 'view'").groupBy(*on).agg(F.min_by("x", "event_id").alias("bx"), F.min_by("y", "event_id").alias("by"))
    n = tables.nearest(k.where("event_type != 'view'").withColumn("object_id", F.col("event_id")), t, on, 30)
    return n.withColumn("d", F.round("d", 6))


@query("""WITH {BOUND}, k AS (SELECT *, ts_us // (24 * {HOUR}) AS day FROM b)
SELECT match_id, period, day, round(avg(x) FILTER (team = 'home'), 6) AS home_x, round(max(x) FILTER (team = 'home'), 6) AS home_max_x, count_if(team = 'home' AND x > 0) AS home_past, count_if(team = 'home') AS home_n, round(avg(y) FILTER (team = 'away'), 6) AS away_y, round(min(x) FILTER (team = 'away'), 6) AS away_min_x, count_if(team = 'away') AS away_n FROM k GROUP BY ALL""")
def team_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.team_shape(bound(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / (24 * HOUR))), [*KEYS, "day"])
    return s.select(*KEYS, "day", *[F.round(c, 6).alias(c) for c in ("home_x", "home_max_x")], "home_past", "home_n", *[F.round(c, 6).alias(c) for c in ("away_y", "away_min_x")], "away_n")


@query("""WITH {BOUND}, a AS (SELECT match_id, ts_us // (24 * {HOUR}) AS day, event_id AS a_id, x AS ax, y AS ay FROM b WHERE event_type = 'view'), c AS (SELECT match_id, ts_us // (24 * {HOUR}) AS day, event_id AS b_id, x AS bx, y AS oy FROM b WHERE event_type = 'click'),
p AS (SELECT match_id, day, a_id, b_id, sqrt((ax - bx) ** 2 + (ay - oy) ** 2) AS d FROM a JOIN c USING (match_id, day)), g AS (SELECT * FROM p WHERE d <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY match_id, day, a_id ORDER BY d, a_id, b_id) AS i, row_number() OVER (PARTITION BY match_id, day, b_id ORDER BY d, a_id, b_id) AS j FROM g) SELECT match_id, day, a_id, b_id, round(d, 6) AS d FROM n WHERE i = 1 AND j = 1""")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = exact(bound(spark, sf_dir)).select("match_id", F.floor(F.col("ts_us") / (24 * HOUR)).alias("day"), F.col("event_id").alias("id"), "x", "y", "event_type")
    return crowds.mutual_nearest(k.where("event_type = 'view'"), k.where("event_type = 'click'"), ["match_id", "day"], 20).withColumn("d", F.round("d", 6))


@query("""WITH {BOUND} SELECT event_id, round(sqrt((52.5 - x) ** 2 + y ** 2), 6) AS distance, round(atan2(abs((52.5 - x) * (-3.66 - y) - (52.5 - x) * (3.66 - y)), (52.5 - x) ** 2 + (3.66 - y) * (-3.66 - y)), 6) AS angle,
x BETWEEN 36 AND 52.5 AND abs(y) <= 20.16 AS box, x >= 26 AND abs(y) <= 25 AS near_box, x >= 17.5 AS third, abs(x) > 52.5 OR abs(y) > 34 AS is_out, round((x - 0.5) * 105, 6) AS ux, round(52.5 - (120 - x) * 0.9144, 6) AS yx,
CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, round(1 / (1 + exp(-value / 100)), 9) AS s, CASE team WHEN 'home' THEN 1 ELSE -1 END AS code FROM b""")
def goal_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, angles, zones, unit changes, bands and codes of every position."""
    x, y, v = F.col("x"), F.col("y"), F.col("value")
    return bound(spark, sf_dir).select(
        "event_id", F.round(G.goal_distance(x, y), 6).alias("distance"), F.round(G.goal_angle(x, y), 6).alias("angle"), G.in_box(x, y).alias("box"), G.near_box(x, y).alias("near_box"), G.in_final_third(x).alias("third"), G.is_out(x, y).alias("is_out"),
        F.round(G.unit_to_metres(x, y)[0], 6).alias("ux"), F.round(G.yards_to_metres(x, y)[0], 6).alias("yx"), scalars.bucket(v, [10, 50], ["low", "mid", "high"]).alias("band"), F.round(scalars.sigmoid(v / 100), 9).alias("s"), scalars.team_code(F.col("team")).alias("code"),
    )


@query("""SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS seconds, CAST(round(value * 10) AS BIGINT) AS tick, CAST(round(value * 1000000) AS BIGINT) AS us, CAST(floor(value * 10 + 0.000001) AS BIGINT) AS event_tick,
lpad(CAST((2700 + floor(value)::INTEGER) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((2700 + floor(value)::INTEGER) % 60 AS VARCHAR), 2, '0') AS on_clock FROM events""")
def clock_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events"), F.col("value")
    text = F.date_format("ts", "HH:mm:ss")
    return e.select("event_id", text.alias("clock"), timing.clock_seconds(text).cast("long").alias("seconds"), timing.tick(v).alias("tick"), timing.to_us(v).alias("us"), timing.event_tick(v).alias("event_tick"), timing.match_clock(F.lit(2), v).alias("on_clock"))


@query("""WITH {BOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY value DESC, event_id) AS n FROM b) SELECT match_id, period, event_id, n::INTEGER AS place FROM n WHERE n <= 6""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = tables.top_per_group(bound(spark, sf_dir), KEYS, [F.col("value").desc(), F.col("event_id")], 6)
    return top.select(*KEYS, "event_id", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("value").desc(), "event_id")).alias("place"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('7:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey), l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS n, count(*) OVER (PARTITION BY l_returnflag) AS a FROM lineitem) SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM r WHERE n <= greatest(1, ceil(a * 0.1)) GROUP BY 1""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    return tables.seeded_sample(li, ["l_returnflag"], "id", 0.1, "7").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS a FROM c) SELECT user_id, event_type, n, round(n / a, 6) AS share FROM r WHERE k = 1 AND a >= 10 AND n / a >= 0.25""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", 10, 0.25).withColumn("share", F.round("share", 6))


@query("""WITH {BOUND} SELECT team, period, count(*) AS n, count_if(event_type = 'error') AS hits, round(count_if(event_type = 'error') / count(*), 6) AS rate, round(count_if(event_type = 'error') / sum(count_if(event_type = 'error')) OVER (), 6) AS of_all FROM b GROUP BY 1, 2""")
def rates_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.shares(bound(spark, sf_dir), ["team", "period"], F.col("event_type") == "error")
    return s.withColumns({"rate": F.round("rate", 6), "of_all": F.round("of_all", 6)})


@query("""WITH {BOUND}, h AS (SELECT match_id, ts_us // {HOUR} AS k, count(*) AS c, count_if(event_type = 'view') AS v FROM b GROUP BY ALL), s AS (SELECT unnest([-2, -1, 0, 1, 2]) AS shift)
SELECT shift, count(*) AS n, count_if(x.v = y.v) AS hits, round(count_if(x.v = y.v) / count(*), 6) AS share FROM h x, s JOIN h y ON y.match_id = x.match_id AND y.k = x.k + shift GROUP BY 1""")
def offset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bound(spark, sf_dir).groupBy("match_id", F.floor(F.col("ts_us") / HOUR).alias("k")).agg(F.count_if(F.col("event_type") == "view").alias("v"))
    s = tables.offset_sweep(h.withColumnRenamed("v", "v0"), h, ["match_id"], "k", [-2, -1, 0, 1, 2], F.col("v0") == F.col("v"))
    return s.withColumn("share", F.round("share", 6))


@query("(SELECT c_custkey AS k, 'a' AS only_in FROM customer EXCEPT ALL SELECT o_custkey, 'a' FROM orders) UNION ALL (SELECT o_custkey, 'b' FROM orders EXCEPT ALL SELECT c_custkey, 'b' FROM customer)")
def key_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return validate.equal_keys(c, o, ["k"])


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS both, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_customers, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS unsold, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS large")
def except_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations, semi and anti joins as counts."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    p, li, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    counts = {
        "both": c.intersect(s), "only_customers": c.exceptAll(s.distinct()).join(s, "k", "left_anti").distinct(),
        "unsold": p.join(li, p["p_partkey"] == li["l_partkey"], "left_anti"), "large": o.join(li.where("l_quantity > 45"), o["o_orderkey"] == li["l_orderkey"], "left_semi"),
    }
    rows = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in counts])


@query("""WITH {BOUND}, q AS (SELECT a.event_id, a.p, quantile_cont(o.p, 0.5) AS med, count(o.p) AS n FROM b a LEFT JOIN b o ON o.match_id = a.match_id AND o.period = a.period AND o.ts_us < a.ts_us AND o.ts_us >= a.ts_us - 48 * {HOUR} GROUP BY 1, 2)
SELECT event_id, round(p - med, 6) AS jump FROM q WHERE n >= 5 AND p >= med + 0.08""")
def trailing_median_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values well above the median of the 48 hours before them, of five at least."""
    return market.jumps(bound(spark, sf_dir).select("event_id", *KEYS, "ts_us", "p"), KEYS, "ts_us", "p", 48 * HOUR, 0.08, 5).select("event_id", F.round("jump", 6).alias("jump"))


@query("""WITH e AS (SELECT event_id, user_id % 8 AS market, epoch_us(ts) // {HOUR} * {HOUR} AS t FROM events), d AS (SELECT market, t, lead(t) OVER (PARTITION BY market ORDER BY t) AS nxt FROM (SELECT DISTINCT market, t FROM e)),
n AS (SELECT e.event_id, e.t, least(coalesce(nxt - e.t, 2 * {HOUR}), 2 * {HOUR}) AS width, row_number() OVER (PARTITION BY e.market, e.t ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY e.market, e.t) AS c FROM e JOIN d USING (market, t)) SELECT event_id, t + CAST(floor(width * i / c) AS BIGINT) AS at_us FROM n""")
def block_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one block spread evenly until the next one, two hours at most."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("market"), (F.floor(timing.timestamp_us(F.col("ts")) / HOUR) * HOUR).alias("t"))
    return market.spread(e, ["market"], "t", "event_id", 2 * HOUR).select("event_id", "at_us")


@query("""SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(sum(value) FILTER (user_id % 2 = 0), 4) AS bought, round(sum(value) FILTER (user_id % 2 = 1), 4) AS sold FROM events GROUP BY 1""")
def tape_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows with counts, price range and volume by side."""
    return market.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", F.col("value"), F.col("user_id") % 2 == 0)


@query("""WITH {BOUND} SELECT event_id, count_if(event_type <> 'error' AND team = 'home') OVER w AS home_rows, count_if(event_type <> 'error' AND team = 'away' AND x >= 17.5) OVER w AS away_third, round(sum(value) OVER w, 4) AS total FROM b WINDOW w AS (PARTITION BY match_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def possession_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.so_far(windows.ordered(["match_id"], "ts_us", "event_id"))
    live = F.col("event_type") != "error"
    return bound(spark, sf_dir).select("event_id", F.count_if(live & (F.col("team") == "home")).over(w).alias("home_rows"), F.count_if(live & (F.col("team") == "away") & (F.col("x") >= 17.5)).over(w).alias("away_third"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("""WITH {BOUND}, s AS (SELECT * FROM b WHERE event_type = 'purchase'), f AS (SELECT * FROM b WHERE event_type <> 'purchase' AND p > 0.1)
SELECT event_id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.match_id = f.match_id AND s.period = f.period AND abs(s.ts_us - f.ts_us) <= 3 * {HOUR})""")
def false_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High scores more than three hours from any shot, found by windows over the union, without pairing rows."""
    b = bound(spark, sf_dir)
    near = windows.trailing(F.count_if(F.col("event_type") == "purchase"), KEYS, "ts_us", 3 * HOUR, 3 * HOUR)
    return b.withColumn("near", near).where("event_type != 'purchase' AND p > 0.1 AND near = 0").select("event_id")


@query("""WITH {BOUND}, a AS (SELECT match_id, team AS truth, CASE WHEN event_type <> 'view' THEN CASE WHEN x > 0 THEN 'home' ELSE 'away' END END AS inferred, event_type <> 'error' AS alive FROM b)
SELECT match_id, count(*) AS n, count_if(inferred IS NOT DISTINCT FROM truth) AS agree, count_if(alive) AS n_alive, count_if(alive AND inferred IS NOT DISTINCT FROM truth) AS agree_alive, count_if(inferred IS NULL) AS unknown, round(count_if(inferred IS NOT DISTINCT FROM truth) / count(*), 6) AS share FROM a GROUP BY ROLLUP (match_id)""")
def agreement_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a guess by the half of the pitch agrees with the team, by match and pooled."""
    b = bound(spark, sf_dir).withColumn("inferred", F.when(F.col("event_type") != "view", F.when(F.col("x") > 0, "home").otherwise("away")))
    return reviews.agreement(b, ["match_id"], "team", "inferred", F.col("event_type") != "error").drop("share_alive").withColumn("share", F.round("share", 6))


@query("""WITH {BOUND}, s AS (SELECT match_id, event_id, ts_us / 3600000000.0 AS h, p FROM b), t AS (SELECT match_id, event_id AS other, CAST(round(h) AS BIGINT) AS k FROM s WHERE p > 0.1)
SELECT s.event_id, t.other FROM s JOIN t ON s.match_id = t.match_id AND CAST(round(s.h + 2) AS BIGINT) = t.k""")
def shifted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined to those of the tick two hours later in the same match."""
    s = bound(spark, sf_dir).select("match_id", "event_id", (F.col("ts_us") / 3600000000.0).alias("h"), "p")
    return reviews.shifted_join(s, s.where("p > 0.1"), ["match_id"], "h", "h", 2, 1, {"event_id": "other"}).select("event_id", "other")
