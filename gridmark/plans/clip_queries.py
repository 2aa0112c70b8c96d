"""Queries on clips, smoothing sweeps and fold files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.operators import clips, metrics, possession
from gridmark.plans.registry import HOUR, KEYS, bound, exact, query, table

MARGINS = [0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35]
DWELLS = [0, 2, 3, 5]

#: A match's period as a clip: its events are frames, purchases the recorded frames half an hour later, signups open marks of 6 to 17 hours, which overlap.
CLIPS_SQL = """{BOUND}, fr AS (SELECT match_id * 10 + period AS clip, match_id, period, event_id AS frame_id, ts_us AS v, CASE WHEN event_type = 'click' THEN 'other' ELSE 'match' END AS vw, value > 10 AS ok FROM b),
cl AS (SELECT clip, any_value(match_id) AS match_id, any_value(period) AS period, min(v) + 24 * {HOUR} AS s, max(v) - 24 * {HOUR} AS e FROM fr GROUP BY 1),
mk AS (SELECT match_id * 10 + period AS clip, ts_us AS s, ts_us + (6 + event_id % 12) * {HOUR} AS e, ['replay', 'closeup', 'other'][1 + event_id % 3] AS label, event_id AS ord FROM b WHERE event_type = 'signup')"""


def clip_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(frames, clips, marks, truth) of the bound clips."""
    b = bound(spark, sf_dir).withColumn("clip", F.col("match_id") * 10 + F.col("period"))
    frames = b.select("clip", F.col("event_id").alias("frame_id"), F.col("ts_us").alias("video_us"), F.when(F.col("event_type") == "click", "other").otherwise("match").alias("view"), (F.col("value") > 10).alias("homography_ok"))
    spans = b.groupBy("clip").agg(F.first("match_id").alias("match_id"), F.first("period").alias("period"), (F.min("ts_us") + 24 * HOUR).alias("start"), (F.max("ts_us") - 24 * HOUR).alias("end"))
    spans = spans.withColumns({"offset_us": F.lit(HOUR // 2), "match_id": F.when(F.col("clip") % 4 != 1, F.col("match_id"))})
    label = F.element_at(F.array(F.lit("replay"), F.lit("closeup"), F.lit("other")), (1 + F.col("event_id") % 3).cast("int"))
    marks = b.where("event_type = 'signup'").select("clip", F.col("ts_us").alias("start"), (F.col("ts_us") + (6 + F.col("event_id") % 12) * HOUR).alias("end"), label.alias("label"), F.col("event_id").alias("ordinal"))
    truth = b.where("event_type = 'purchase'").select("match_id", "period", F.col("event_id").alias("truth_frame"), "ts_us")
    return frames, spans, marks, truth


@query("WITH " + CLIPS_SQL + """, cu AS (SELECT clip, s, e FROM cl WHERE s < e), pt AS (SELECT clip, s AS t FROM cu UNION SELECT clip, e FROM cu UNION SELECT clip, s FROM mk UNION SELECT clip, e FROM mk),
el AS (SELECT clip, t AS a, lead(t) OVER (PARTITION BY clip ORDER BY t) AS z FROM pt),
li AS (SELECT el.clip, a, z, EXISTS (SELECT 1 FROM mk WHERE mk.clip = el.clip AND mk.s <= a AND mk.e > a) AS marked FROM el JOIN cu ON cu.clip = el.clip AND a >= cu.s AND a < cu.e)
SELECT clip, round(sum(z - a) / 1e6, 3) AS seconds, round(coalesce(sum(z - a) FILTER (marked), 0) / 1e6, 3) AS marked_seconds, round(coalesce(sum(z - a) FILTER (NOT marked), 0) / 1e6, 3) AS live_seconds FROM li GROUP BY 1""")
def live_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each clip is, how much of it marks cover, overlapping ones once, and what is left."""
    _, spans, marks, _ = clip_tables(spark, sf_dir)
    whole = clips.measured(spans, ["clip"])
    left = clips.measured(clips.subtracted(spans, marks, ["clip"]), ["clip"]).withColumnRenamed("seconds", "live")
    live = F.coalesce("live", F.lit(0.0))
    return whole.join(left, "clip", "left").select("clip", F.round("seconds", 3).alias("seconds"), F.round(F.col("seconds") - live, 3).alias("marked_seconds"), F.round(live, 3).alias("live_seconds"))


@query("WITH " + CLIPS_SQL + """, tr AS (SELECT match_id, period, event_id AS tf, ts_us FROM b WHERE event_type = 'purchase'),
al AS (SELECT fr.*, clip % 4 <> 1 AS has_truth, v >= cl.s AND v < cl.e AS in_clip, vw = 'match' AND ok AS geo, (SELECT arg_max(label, ord) FROM mk WHERE mk.clip = fr.clip AND mk.s <= v AND v < mk.e) AS mark FROM fr JOIN cl USING (clip)),
ne AS (SELECT frame_id, tf FROM (SELECT frame_id, tf, row_number() OVER (PARTITION BY frame_id ORDER BY abs(tr.ts_us - v - {HOUR} // 2), tr.ts_us) AS n FROM al JOIN tr ON tr.match_id = al.match_id AND tr.period = al.period AND has_truth AND abs(tr.ts_us - v - {HOUR} // 2) <= 3 * {HOUR}) WHERE n = 1),
sc AS (SELECT al.*, tf FROM al LEFT JOIN ne USING (frame_id) WHERE in_clip AND mark IS NULL AND (NOT has_truth OR tf IS NOT NULL)),
o AS (SELECT event_id, x, y FROM b),
ta AS (SELECT frame_id, event_id AS id, x, y FROM sc JOIN o ON event_id BETWEEN tf AND tf + 2 WHERE has_truth),
vb AS (SELECT frame_id, event_id AS id, x, y FROM sc JOIN o ON event_id - frame_id IN (0, 1, 3) WHERE has_truth),
pp AS (SELECT a.frame_id, a.id AS ai, b.id AS bi, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM ta a JOIN vb b USING (frame_id)),
pr AS (SELECT frame_id, d FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, ai ORDER BY d, ai, bi) AS na, row_number() OVER (PARTITION BY frame_id, bi ORDER BY d, ai, bi) AS nb FROM pp WHERE d <= 30) WHERE na = 1 AND nb = 1),
ct AS (SELECT sc.*, CASE WHEN has_truth THEN (SELECT count(*) FROM ta WHERE ta.frame_id = sc.frame_id) ELSE 0 END AS nt, CASE WHEN has_truth THEN (SELECT count(*) FROM vb WHERE vb.frame_id = sc.frame_id) ELSE 0 END AS nv FROM sc),
f AS (SELECT clip, count(*) AS n_scored, count_if(has_truth) AS n_truth_frames, count_if(geo) AS n_geometry, sum(nt)::BIGINT AS n_truth, sum(nv)::BIGINT AS n_vis, sum(CASE WHEN geo THEN nt ELSE 0 END) AS ng FROM ct GROUP BY ROLLUP (clip)),
g AS (SELECT clip, count(*) AS n_pairs, count_if(d <= 10) AS n_near, count_if(d <= 10 AND geo) AS nng, quantile_cont(d, 0.5) AS median_m, quantile_cont(d, 0.9) AS p90_m FROM pr JOIN sc USING (frame_id) GROUP BY ROLLUP (clip))
SELECT f.clip, n_scored, n_truth_frames, n_geometry, n_truth, n_vis, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_near, 0) AS n_near, round(1 - n_geometry / n_scored, 6) AS geometry_missing, round(coalesce(n_near, 0) / nullif(n_truth, 0), 6) AS within_near,
  round(coalesce(nng, 0) / nullif(ng, 0), 6) AS within_near_geo, round((n_vis - coalesce(n_pairs, 0)) / nullif(n_truth_frames, 0), 6) AS unmatched_per_frame, round(median_m, 6) AS median_m, round(p90_m, 6) AS p90_m FROM f LEFT JOIN g ON f.clip IS NOT DISTINCT FROM g.clip""")
def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every clip, and of all in the row without one: unmarked frames paired in time, people paired in place."""
    frames, spans, marks, truth = clip_tables(spark, sf_dir)
    places = exact(bound(spark, sf_dir)).select("event_id", "x", "y")
    at = lambda ids, key, steps: ids.select(*ids.columns, F.explode(F.array(*[F.col(key) + s for s in steps])).alias("id"))
    people = at(truth.select("match_id", "truth_frame"), "truth_frame", (0, 1, 2)).join(places, F.col("id") == F.col("event_id")).drop("event_id")
    seen = at(frames.select("clip", "frame_id"), "frame_id", (0, 1, 3)).join(places, F.col("id") == F.col("event_id")).drop("event_id")
    rows = clips.aligned(frames, spans, marks, truth, 3 * HOUR, 12 * HOUR)
    s = clips.summary(*clips.frame_pairs(rows, seen, people, 30.0, 10.0))
    some = lambda c: F.when(F.col("n_scored") > 0, F.col(c)).alias(c)  # noqa: E731  (the SQL's count_if of no rows is null)
    return s.select("clip", "n_scored", some("n_truth_frames"), some("n_geometry"), "n_truth", "n_vis", "n_pairs", "n_near", *[F.round(c, 6).alias(c) for c in ("geometry_missing", "within_near", "within_near_geo", "unmatched_per_frame", "median_m", "p90_m")])


HOURS = """{BOUND}, h AS (SELECT match_id, period, ts_us // {HOUR} AS k, round((avg(x) + 52.5) / 105, 6) AS p, arg_max(CASE WHEN x >= 0 THEN 'home' ELSE 'away' END, (ts_us, event_id)) AS rule, count(*) = 1 AND max((ts_us // {HOUR}) % 3) = 0 AS fallback, CASE WHEN round(avg(x + y), 6) >= 0 THEN 'home' ELSE 'away' END AS truth, count_if(event_type = 'purchase') > 0 AS pos FROM b GROUP BY ALL)"""


@query("WITH RECURSIVE " + HOURS + """, c AS (SELECT m.m AS margin, d.d AS dwell, x.x AS hold FROM (SELECT unnest([""" + ", ".join(map(str, MARGINS)) + """]::DOUBLE[]) AS m) m, (SELECT unnest([""" + ", ".join(map(str, DWELLS)) + """]) AS d) d, (SELECT unnest([false, true]) AS x) x),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY k) AS n FROM h),
w AS (SELECT margin, dwell, hold, r.match_id, r.period, r.n, CASE WHEN NOT fallback THEN CASE WHEN p >= 0.5 + margin THEN 'home' WHEN p <= 0.5 - margin THEN 'away' WHEN p >= 0.5 THEN 'home' ELSE 'away' END ELSE rule END AS cur, CAST(NULL AS VARCHAR) AS cand, 0 AS cnt,
    CASE WHEN NOT fallback THEN CASE WHEN p >= 0.5 + margin THEN 'home' WHEN p <= 0.5 - margin THEN 'away' WHEN p >= 0.5 THEN 'home' ELSE 'away' END ELSE rule END AS shown FROM r, c WHERE n = 1
  UNION ALL
  SELECT margin, dwell, hold, match_id, period, n, CASE WHEN fallback THEN CASE WHEN hold THEN cur ELSE rule END WHEN switches THEN want ELSE cur END, CASE WHEN fallback OR switches OR want = cur THEN NULL ELSE want END, CASE WHEN fallback OR switches OR want = cur THEN 0 ELSE again END,
    CASE WHEN fallback THEN CASE WHEN hold THEN cur ELSE rule END WHEN switches THEN want ELSE cur END
  FROM (SELECT *, want <> cur AND again >= greatest(dwell, 1) AS switches FROM (SELECT *, CASE WHEN want IS NOT DISTINCT FROM cand THEN cnt + 1 ELSE 1 END AS again FROM (
    SELECT w.margin, w.dwell, w.hold, r.match_id, r.period, r.n, r.rule, r.fallback, w.cur, w.cand, w.cnt, CASE WHEN r.p >= 0.5 + margin THEN 'home' WHEN r.p <= 0.5 - margin THEN 'away' ELSE cur END AS want
    FROM w JOIN r ON r.match_id = w.match_id AND r.period = w.period AND r.n = w.n + 1)))),
a AS (SELECT *, k - max(CASE WHEN turn THEN k END) OVER (PARTITION BY match_id, period ORDER BY k) AS age FROM (SELECT *, truth IS DISTINCT FROM lag(truth) OVER (PARTITION BY match_id, period ORDER BY k) AS turn FROM r)),
z AS (SELECT w.margin, w.dwell, w.hold, a.*, shown, shown <> truth AS bl, rule <> truth AS br, coalesce(shown <> lag(shown) OVER (PARTITION BY margin, dwell, hold, w.match_id, w.period ORDER BY w.n), false) AS tl, coalesce(truth <> lag(truth) OVER (PARTITION BY margin, dwell, hold, w.match_id, w.period ORDER BY w.n), false) AS tt FROM w JOIN a USING (match_id, period, n)),
s AS (SELECT margin, dwell, hold, count_if(bl) / nullif(count_if(br), 0) AS overall, count_if(bl AND age <= 3) / nullif(count_if(br AND age <= 3), 0) AS "first", count_if(bl AND pos) / nullif(count_if(br AND pos), 0) AS positive, (count_if(bl AND age > 3) - count_if(br AND age > 3)) / nullif(count_if(age > 3), 0) AS late, count_if(tl) / nullif(count_if(tt), 0) AS churn FROM z GROUP BY ALL)
SELECT margin, dwell::INTEGER AS dwell, hold, round(overall, 6) AS overall, round("first", 6) AS "first", round(positive, 6) AS positive, round(late, 6) AS late, round(churn, 6) AS churn, overall <= 0.9 AND "first" <= 0.85 AND positive <= 1 AND late <= 0.01 AND churn <= 1.25 AS passes FROM s""")
def smoothing_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """56 configurations of margin, dwell and hold in one job, against the rule's team."""
    b = bound(spark, sf_dir).withColumn("k", F.floor(F.col("ts_us") / HOUR))
    h = b.groupBy(*KEYS, "k").agg(F.round((F.avg("x") + 52.5) / 105, 6).alias("p"), F.max_by(F.when(F.col("x") >= 0, "home").otherwise("away"), F.struct("ts_us", "event_id")).alias("rule"), F.count("*").alias("n"), F.round(F.avg(F.col("x") + F.col("y")), 6).alias("side"), F.count_if(F.col("event_type") == "purchase").alias("shots"))
    rows = h.select(*KEYS, "k", "p", "rule", ((F.col("n") == 1) & (F.col("k") % 3 == 0)).alias("fallback"), F.when(F.col("side") >= 0, "home").otherwise("away").alias("truth"), (F.col("shots") > 0).alias("positive"))
    out = possession.smoothing_sweep(rows, KEYS, "k", "p", "rule", "fallback", "truth", "positive", MARGINS, DWELLS, young=3)
    return out.select("margin", "dwell", "hold", *[F.round(c, 6).alias(c) for c in ("overall", "first", "positive", "late", "churn")], "passes")


@query("""WITH RECURSIVE m AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
old AS (SELECT c_custkey, c_mktsegment, size, (c_custkey // 7) % 5 AS fold FROM m WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING'),
ne AS (SELECT m.*, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM m WHERE NOT (c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING') AND c_mktsegment <> 'BUILDING'),
ld AS (SELECT c_mktsegment, list_transform([0, 1, 2, 3, 4], lambda f: len(list_filter(fs, lambda x: x = f))) AS cnt, [coalesce(sum(size) FILTER (fold = 0), 0), coalesce(sum(size) FILTER (fold = 1), 0), coalesce(sum(size) FILTER (fold = 2), 0), coalesce(sum(size) FILTER (fold = 3), 0), coalesce(sum(size) FILTER (fold = 4), 0)]::BIGINT[] AS tot FROM (SELECT *, list(fold) OVER (PARTITION BY c_mktsegment) AS fs FROM old) GROUP BY c_mktsegment, fs),
w AS (SELECT c_mktsegment, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS c_custkey, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS fold, cnt, tot FROM ld
  UNION ALL SELECT c_mktsegment, n, c_custkey, size, fold, list_transform(cnt, lambda c, i: c + (i - 1 = fold)::INT), list_transform(tot, lambda t, i: t + CASE WHEN i - 1 = fold THEN size ELSE 0 END) FROM (
    SELECT w.c_mktsegment, ne.n, ne.c_custkey, ne.size, list_sort(list_transform([0, 1, 2, 3, 4], lambda f: {'c': w.cnt[f + 1], 't': w.tot[f + 1], 'f': f}))[1].f AS fold, w.cnt, w.tot FROM w JOIN ne ON ne.c_mktsegment = w.c_mktsegment AND ne.n = w.n + 1)),
k AS (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY size DESC, c_custkey) - 1) // 5 AS block FROM m WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, c_mktsegment, size, fold::INTEGER AS fold FROM old UNION ALL SELECT c_custkey, c_mktsegment, size, fold::INTEGER FROM w WHERE n > 0
UNION ALL SELECT c_custkey, c_mktsegment, size, (row_number() OVER (PARTITION BY c_mktsegment, block ORDER BY md5('s:' || c_custkey), c_custkey) - 1)::INTEGER FROM k""")
def appended_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as matches: a third has frozen folds, one segment is new, the others go to the smallest fold each time."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    m = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_mktsegment", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    frozen = m.where("c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING'").withColumn("fold", (F.floor(F.col("c_custkey") / 7) % 5).cast("int"))
    return metrics.appended_folds(frozen, m, "c_custkey", "c_mktsegment", "size", 5, "s")
