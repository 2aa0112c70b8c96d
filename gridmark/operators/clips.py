"""Scores of clips against recorded frames: interval algebra on marks, frames paired in time, people paired in place, evidence for each labelled ball.

Times are micros.  Marks may overlap: a frame's label is that of the later mark, and lengths are measured on the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions import geometry as G
from gridmark.operators import asof, reviews, sequential, tables
from gridmark.operators.windows import so_far

#: Why a visible ball was missed, in the order in which reasons count.
MISSES = ("view_other", "no_geometry", "wrong_pick", "low_conf", "drift", "not_detected")


# Interval algebra.


def merged(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the union of each group's intervals [start, end) as disjoint ones; touching ones are joined, empty ones go."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where(F.col(start) < F.col(end)).select(*keys, start, end).withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    return rows.withColumn("_part", F.sum("_new").over(so_far(w))).groupBy(*keys, "_part").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_part")


def subtracted(spans: DataFrame, marks: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): what the union of ``marks`` leaves of the union of ``spans``.

    Each span meets its group's marks, and what is left lies between one mark and the next.
    """
    s = merged(spans, keys, start, end)
    m = merged(marks, keys, start, end).select(*[F.col(k).alias(f"_m_{k}") for k in keys], F.col(start).alias("_a"), F.col(end).alias("_b"))
    same = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]
    on = (F.col("_a") < F.col(end)) & (F.col("_b") > F.col(start))
    for c in same:
        on = on & c
    met = s.join(m, on, "left")
    w = Window.partitionBy(*keys, start, end).orderBy("_a")
    left = F.coalesce(F.lag("_b").over(w), F.col(start))
    last = F.lead("_a").over(w).isNull()
    ends = F.array(F.struct(left.alias("from"), F.coalesce("_a", end).alias("to")), F.struct(F.when(last, F.col("_b")).alias("from"), F.col(end).alias("to")))
    pieces = met.select(*keys, F.col(start).alias("_s"), ends.alias("_ends")).select(*keys, "_s", F.explode("_ends").alias("_e"))
    return pieces.select(*keys, F.greatest("_s", "_e.from").alias(start), F.col("_e.to").alias(end), F.col("_e.from").alias("_from")).where(F.col("_from").isNotNull() & (F.col(start) < F.col(end))).drop("_from")


def measured(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, seconds): the length of each group's union."""
    return merged(spans, keys, start, end).groupBy(*keys).agg((F.sum(F.col(end) - F.col(start)) / 1e6).alias("seconds"))


# Frames.


def sync_offsets(pairs: DataFrame, clip: str, video: str, truth: str, most_drift: int) -> DataFrame:
    """(clip, offset_us): the mean of truth time less video time over a clip's sync pairs; pairs that drift apart by more than ``most_drift`` are an error."""
    gap = F.col(truth) - F.col(video)
    by = pairs.groupBy(clip).agg(F.avg(gap).alias("mean"), (F.max(gap) - F.min(gap)).alias("drift"))
    refused = F.raise_error(F.concat(F.lit("sync pairs drift in clip "), F.col(clip).cast("string"))).cast("long")
    return by.select(clip, F.when(F.col("drift") > most_drift, refused).otherwise(F.round("mean").cast("long")).alias("offset_us"))


def aligned(frames: DataFrame, clips: DataFrame, marks: DataFrame, truth: DataFrame, tolerance: int, width: int) -> DataFrame:
    """``frames`` (clip, frame_id, video_us, view, homography_ok) with in_clip, mark, geometry, has_truth and the nearest truth_frame within ``tolerance``.

    ``clips``: (clip, match_id, period, start, end, offset_us), one row each; a clip without a match has no truth.  ``marks``: (clip, start, end, label, ordinal).
    ``truth``: (match_id, period, truth_frame, ts_us).  ``width``: the cells of the interval join.
    """
    c = clips.select("clip", "match_id", "period", F.col("start").alias("_from"), F.col("end").alias("_to"), "offset_us")
    rows = frames.join(c, "clip")
    label = reviews.marked_at(rows.select("clip", "frame_id", "video_us"), marks, ["clip"], "video_us", width).select("clip", "frame_id", F.col("label").alias("mark"))
    rows = rows.join(label, ["clip", "frame_id"]).withColumns({"in_clip": (F.col("video_us") >= F.col("_from")) & (F.col("video_us") < F.col("_to")), "geometry": (F.col("view") == "match") & F.col("homography_ok"), "truth_us": F.col("video_us") + F.col("offset_us"), "has_truth": F.col("match_id").isNotNull()})
    return asof.asof_nearest(rows.drop("_from", "_to", "offset_us"), truth, ["match_id", "period"], "truth_us", "ts_us", {"truth_frame": "truth_frame"}, tolerance=tolerance, right_order=["truth_frame"])


def frame_pairs(aligned: DataFrame, seen: DataFrame, truth: DataFrame, gate: float, near: float) -> tuple[DataFrame, DataFrame]:
    """(frames, pairs): each scored frame with n_truth and n_vis, and its pairs of people within ``gate`` of which each is the other's nearest.

    Scored: in the clip, unmarked and, if the clip has truth, near a truth frame.  ``seen``: (clip, frame_id, id, x, y); ``truth``: (match_id, truth_frame, id, x, y).
    """
    scored = aligned.where("in_clip AND mark IS NULL AND (NOT has_truth OR truth_frame IS NOT NULL)")
    on = ["clip", "frame_id"]
    a = scored.where("has_truth").select(*on, "match_id", "truth_frame", "geometry").join(truth, ["match_id", "truth_frame"])
    b = seen.join(scored.where("has_truth").select(*on), on)
    pairs = tables.mutual_nearest(a.select(*on, "id", "x", "y"), b.select(*on, "id", "x", "y"), on, gate)
    pairs = pairs.join(scored.select(*on, "geometry"), on).withColumn("near", F.col("d") <= near)
    counted = scored.join(a.groupBy(*on).agg(F.count("*").alias("n_truth")), on, "left").join(b.groupBy(*on).agg(F.count("*").alias("n_vis")), on, "left").fillna(0, ["n_truth", "n_vis"])
    return counted, pairs


def summary(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each clip, and one without a clip for all, even of no frames: counts, shares and error quantiles of ``frame_pairs``."""
    geo, real = F.col("geometry"), ~F.col("_none")
    none = frames.sparkSession.range(1).select(F.lit(True).alias("_none"))  # a rollup of no rows has no total
    f = frames.withColumn("_none", F.lit(False)).unionByName(none, allowMissingColumns=True).rollup("clip").agg(
        F.grouping("clip").alias("_total"), F.count_if(real).alias("n_scored"), F.count_if(F.col("has_truth")).alias("n_truth_frames"), F.count_if(F.col("view") == "match").alias("n_match_view"), F.count_if(geo).alias("n_geometry"),
        F.sum("n_truth").alias("n_truth"), F.sum(F.when(real, F.when(geo, F.col("n_truth")).otherwise(0))).alias("n_truth_geo"), F.sum("n_vis").alias("n_vis"),
    ).where("_total = 1 OR n_scored > 0").drop("_total")
    q = lambda p, c: F.percentile(c, p)
    in_geo = F.when(geo, F.col("d"))
    p = pairs.rollup("clip").agg(F.count("*").alias("n_pairs"), F.count_if("near").alias("n_near"), F.count_if(F.col("near") & geo).alias("n_near_geo"), q(0.5, F.col("d")).alias("median_m"), q(0.9, F.col("d")).alias("p90_m"), q(0.5, in_geo).alias("median_geo_m"), q(0.9, in_geo).alias("p90_geo_m"))
    both = f.alias("f").join(p.withColumnRenamed("clip", "_clip"), F.col("f.clip").eqNullSafe(F.col("_clip")), "left").drop("_clip").fillna(0, ["n_pairs", "n_near", "n_near_geo"])
    share = F.try_divide
    return both.withColumns({
        "geometry_missing": 1 - share("n_geometry", "n_scored"), "view_other": 1 - share("n_match_view", "n_scored"), "homography_rejected": 1 - share("n_geometry", "n_match_view"), "within_near": share("n_near", "n_truth"),
        "within_near_geo": share("n_near_geo", "n_truth_geo"), "unmatched_per_frame": share(F.col("n_vis") - F.col("n_pairs"), F.col("n_truth_frames")),
    })


def false_live(aligned: DataFrame, fps: float) -> DataFrame:
    """(clip, mark, seconds): how long geometry was claimed inside marks of each label."""
    return aligned.where("in_clip AND mark IS NOT NULL AND geometry").groupBy("clip", "mark").agg((F.count("*") / fps).alias("seconds"))


# Evidence for labelled balls.


def adjugate(m: list[Column]) -> list[Column]:
    """The inverse of a 3 x 3 matrix but for a factor, which a projection doesn't feel."""
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def ball_evidence(labels: DataFrame, rows: DataFrame, candidates: DataFrame, frames: DataFrame, confident: float) -> DataFrame:
    """Per labelled frame what speaks for and against the ball found there: (clip, frame_id, visible, match_view, geometry, row, has_xy, d_px, d_m, cand_hi_px, cand_px).

    ``labels``: (clip, frame_id, kind ball / none / unsure, u, v), unsure ones are left out.  ``rows``: (clip, frame_id, x1, y1, x2, y2, tracked_only, pitch_x,
    pitch_y), one a frame.  ``candidates``: (clip, frame_id, x1, y1, x2, y2, confidence).  ``frames``: (clip, frame_id, view, h, home_right); h: the image to the
    pitch, nine numbers by rows or null.  A detected ball is at its box's centre, a tracked one where its place on the pitch is in the image.
    """
    on = ["clip", "frame_id"]
    c = candidates.select(*on, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), "confidence")
    base = labels.where("kind <> 'unsure'").join(frames.select(*on, "view", "h", "home_right"), on)
    d = F.hypot(F.col("cx") - F.col("u"), F.col("cy") - F.col("v"))
    near = base.where("kind = 'ball'").select(*on, "u", "v").join(c, on).groupBy(*on).agg(F.min(d).alias("cand_px"), F.min(F.when(F.col("confidence") >= confident, d)).alias("cand_hi_px"))
    found = rows.select(*on, "x1", "y1", "x2", "y2", "tracked_only", "pitch_x", "pitch_y", F.lit(True).alias("_there"))
    both = base.join(found, on, "left").join(near, on, "left")
    h = [F.get("h", F.lit(i)) for i in range(9)]
    side = F.when(F.col("home_right"), 1.0).otherwise(-1.0)
    u, v = G.projected(side * F.col("pitch_x"), side * F.col("pitch_y"), adjugate(h))
    at_u, at_v = F.when(F.col("tracked_only"), u).otherwise((F.col("x1") + F.col("x2")) / 2), F.when(F.col("tracked_only"), v).otherwise((F.col("y1") + F.col("y2")) / 2)
    px, py = G.projected(F.col("u"), F.col("v"), h)
    visible, has_xy = F.col("kind") == "ball", F.col("pitch_x").isNotNull()
    return both.select(
        *on, visible.alias("visible"), (F.col("view") == "match").alias("match_view"), F.col("h").isNotNull().alias("geometry"), F.when(F.col("_there"), F.when(F.col("tracked_only"), "extrap").otherwise("det")).alias("row"), has_xy.alias("has_xy"),
        F.when(visible, F.hypot(at_u - F.col("u"), at_v - F.col("v"))).alias("d_px"), F.when(visible & has_xy, F.hypot(side * px - F.col("pitch_x"), side * py - F.col("pitch_y"))).alias("d_m"),
        F.when(visible, F.col("cand_hi_px")).alias("cand_hi_px"), F.when(visible, F.col("cand_px")).alias("cand_px"), at_u.alias("at_u"), at_v.alias("at_v"),
    )


def ball_headline(evidence: DataFrame, radii: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, r_px, counts, recall, precision, misses by bucket, error in metres) of ``ball_evidence`` at each radius, in one job."""
    e = sequential.swept(evidence, "r_px", radii)
    near = lambda c: F.coalesce(F.col(c) <= F.col("r_px"), F.lit(False))
    hit = F.col("visible") & F.col("has_xy") & near("d_px")
    why = F.lit(MISSES[5])
    for name, holds in reversed((
        (MISSES[0], ~F.col("match_view")), (MISSES[1], ~F.col("geometry") | (F.col("row").isNotNull() & ~F.col("has_xy") & near("d_px"))), (MISSES[2], near("cand_hi_px")), (MISSES[3], near("cand_px")), (MISSES[4], F.coalesce(F.col("row") == "extrap", F.lit(False))),
    )):
        why = F.when(holds, name).otherwise(why)
    e = e.withColumns({"hit": hit, "miss": F.when(F.col("visible") & ~hit, why), "usable": F.col("visible") & F.col("match_view") & F.col("geometry")})
    counts = [F.count("*").alias("n_labeled"), F.count_if("visible").alias("n_visible"), F.count_if("usable").alias("n_usable"), F.count_if("hit").alias("n_hit"), F.count_if(F.col("hit") & F.col("usable")).alias("n_hit_usable"), F.count_if("has_xy").alias("n_shown"), F.count_if(F.col("has_xy") & ~F.col("visible")).alias("false_on_none")]
    counts += [F.count_if(F.col("miss") == m).alias(f"miss_{m}") for m in MISSES]
    for kind in ("det", "extrap"):
        counts += [F.count_if(F.col("hit") & (F.col("row") == kind)).alias(f"hits_{kind}"), F.count_if(F.col("has_xy") & (F.col("row") == kind)).alias(f"rows_{kind}")]
    counts += [F.percentile(F.when(F.col("hit"), F.col("d_m")), p).alias(n) for n, p in (("median_m", 0.5), ("p90_m", 0.9))]
    out = e.groupBy(*by or [], "r_px").agg(*counts)
    return out.withColumns({"recall": F.try_divide("n_hit", "n_visible"), "recall_usable": F.try_divide("n_hit_usable", "n_usable"), "precision": F.try_divide("n_hit", "n_shown")})


def reference_evidence(truth: DataFrame, labels: DataFrame, evidence_rows: DataFrame, candidates: DataFrame, radius: float) -> DataFrame:
    """Per reference frame (clip, frame_id, kind, u, v): how far vision's ball, the nearest candidate and the label are from the reference's projection, and whether the ball hits the label.

    ``evidence_rows``: (clip, frame_id, row, has_xy, at_u, at_v) of each frame of the run, as ``ball_evidence`` places balls; a tracked ball without a place on the pitch has none.
    """
    on = ["clip", "frame_id"]
    c = candidates.select(*on, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    near = truth.where("u IS NOT NULL").join(c, on).groupBy(*on).agg(F.min(F.hypot(F.col("cx") - F.col("u"), F.col("cy") - F.col("v"))).alias("cand_px"))
    lab = labels.where("kind = 'ball'").select(*on, F.col("u").alias("lu"), F.col("v").alias("lv"))
    rows = truth.join(evidence_rows, on).join(near, on, "left").join(lab, on, "left")
    to = lambda x, y: F.hypot(F.col("at_u") - F.col(x), F.col("at_v") - F.col(y))
    judged = F.col("u").isNotNull() & F.col("lu").isNotNull()
    return rows.select(*on, "kind", "row", "has_xy", to("u", "v").alias("d_px"), "cand_px", F.hypot(F.col("lu") - F.col("u"), F.col("lv") - F.col("v")).alias("lab_px"), F.when(judged, F.coalesce(F.col("has_xy") & (to("lu", "lv") <= radius), F.lit(False))).alias("click_hit"))


def reference_headline(evidence: DataFrame, radius: float, agree_px: float = 25.0, least_agreement: float = 0.7, least_labels: int = 20) -> DataFrame:
    """(n, recall, ceiling, agreement, withheld, n_estimated): scores on frames of kind pff; withheld where good labels seldom agree with the projection."""
    pff, known = F.col("kind") == "pff", F.col("kind").isin("pff") & F.col("d_px").isNotNull()
    by = evidence.agg(F.count_if(pff).alias("n"), F.count_if(known & F.col("has_xy") & (F.col("d_px") <= radius)).alias("hits"), F.count_if(pff & (F.col("cand_px") <= radius)).alias("reachable"), F.count_if(pff & F.col("lab_px").isNotNull()).alias("n_labels"), F.count_if(pff & (F.col("lab_px") <= agree_px)).alias("agree"), F.count_if(F.col("has_xy") & (F.col("kind") == "estimated")).alias("n_estimated"))
    agreement = F.try_divide("agree", "n_labels")
    return by.select("n", F.try_divide("hits", "n").alias("recall"), F.try_divide("reachable", "n").alias("ceiling"), agreement.alias("agreement"), ((F.col("n_labels") >= least_labels) & (agreement < least_agreement)).alias("withheld"), "n_estimated")
