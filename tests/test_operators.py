"""Hand-computed values, causality, symmetry, and stream = batch."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark import schema
from gridmark.functions import geometry, scalars, timing
from gridmark.operators import asof, augment, features, labels, machines, market, metrics, models, possession, reviews, sequential, tables, validate, windows
from gridmark.sources import sinks, tracking
from gridmark.streaming import stateful

S = 1_000_000


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_geometry(spark):
    lit = F.lit
    assert one(spark, geometry.goal_distance(lit(52.5), lit(3.0))) == 3
    assert one(spark, geometry.goal_angle(lit(52.5), lit(0.0))) == pytest.approx(math.pi)
    assert one(spark, geometry.goal_angle(lit(52.5 - 3.66), lit(0.0))) == pytest.approx(math.pi / 2)
    assert one(spark, geometry.closing_speed(lit(42.5), lit(0.0), lit(2.0), lit(9.0))) == pytest.approx(2)
    assert one(spark, geometry.closing_speed(lit(52.5), lit(0.0), lit(2.0), lit(9.0))) is None
    assert one(spark, geometry.in_lane(lit(45.0), lit(0.0), lit(40.0), lit(0.0))) is True
    assert one(spark, geometry.in_lane(lit(30.0), lit(0.0), lit(40.0), lit(0.0))) is False
    assert one(spark, geometry.flipped(lit("away"), lit(True))) is True
    assert one(spark, geometry.attack_sign(lit(None).cast("string"), lit(True))) == 0
    assert one(spark, geometry.at_restart_spot(lit(52.0), lit(33.0))) is True
    eye = [F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]
    assert one(spark, geometry.projected(lit(3.0), lit(4.0), eye)[1]) == 4
    assert one(spark, geometry.expected_width(lit(3.0), lit(4.0), eye, eye)) == pytest.approx(0.22)


def test_scalars_and_times(spark):
    lit = F.lit
    assert one(spark, timing.match_clock(lit(2), lit(61.5))) == "46:01"
    assert one(spark, timing.clock_seconds(lit("00:01:02.5"))) == 62.5
    assert one(spark, timing.event_tick(lit(0.3))) == 3
    assert one(spark, timing.frame_of(lit(0.5), 1.0)) == 0
    assert one(spark, scalars.shot_outcome(lit("ON TARGET-SAVED"))) == "saved"
    assert one(spark, scalars.player_ref(lit("away"), lit("Player26"))) == "away_26"
    assert one(spark, scalars.bucket(lit(10), [10, 50], ["a", "b", "c"])) == "b"
    assert one(spark, scalars.trade_text(lit("0x12345678abcd"), lit("BUY"), lit(12.4), lit(0.0))) == "0x1234..abcd buy $12 @ 1c"
    assert 0 <= one(spark, scalars.uniform(lit(1))) < 1
    scalars.register_sql(spark)
    assert spark.sql("SELECT goal_distance(52.5D, 3D) AS v").first()["v"] == 3


def test_asof(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (1, None), (2, 10)], "g int, t long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 15, "b"), (1, 25, "c")], "g int, t long, v string")
    take = {"v": "v"}
    assert values(asof.asof_backward(left, right, ["g"], "t", "t", take), "g", "t", "v") == [(1, 10, "a"), (1, 20, "b"), (1, None, None), (2, 10, None)]
    assert values(asof.asof_backward(left, right, ["g"], "t", "t", take, inclusive=False), "t", "v")[:2] == [(10, None), (10, None)]
    assert values(asof.asof_backward(left, right, ["g"], "t", "t", take, most_age=4), "t", "v")[2] == (20, None)
    assert values(asof.asof_forward(left, right, ["g"], "t", "t", take), "g", "t", "v")[:2] == [(1, 10, "a"), (1, 20, "c")]
    assert values(asof.asof_forward(left, right, ["g"], "t", "t", take, strict=True), "g", "t", "v")[0] == (1, 10, "b")
    assert (20, "b") in values(asof.asof_nearest(left, right, ["g"], "t", "t", take, tolerance=5), "t", "v")  # a tie goes to the earlier row
    assert (20, None) in values(asof.asof_nearest(left, right, ["g"], "t", "t", take, tolerance=4), "t", "v")


def test_interpolation_and_intervals(spark):
    points = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0), (1, 100, 0.0)], "g int, t long, v double")
    at = spark.createDataFrame([(1, 5), (1, 10), (1, 50), (1, 200)], "g int, at long")
    assert values(asof.interpolated(points, at, ["g"], "t", "at", ["v"], most_gap=20), "at", "v") == [(10, 10.0), (200, None), (5, 5.0), (50, None)]
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 200)], "g int, a long, b long")
    assert values(asof.interval_join(at, spans, ["g"], "at", "a", "b", 7), "at", "a") == [(10, 0), (10, 5), (200, 5), (5, 0), (50, 5)]
    assert (5, 5) in values(asof.interval_join(at, spans, ["g"], "at", "a", "b", 7, closed="left"), "at", "a")


def test_windows(spark):
    df = spark.createDataFrame([("m", t, x) for t, x in ((0, 0.0), (S // 10, 1.0), (2 * S // 10, 2.0), (10 * S, 9.0), (10 * S + S // 10, 9.5))], "g string, t long, x double")
    rows = windows.causal_velocity(windows.gap_segments(df, ["g"], "t", S), ["g"], "t", ["x"], 2)
    assert [v if v is None else round(v, 6) for _, v in values(rows, "t", "vx")] == [None, 10.0, None, 5.0, 10.0]
    assert values(windows.changes("v", ["g"], ["t"], spark.createDataFrame([("m", 1, "a"), ("m", 2, None), ("m", 3, "a"), ("m", 4, "b")], "g string, t int, v string")), "changes") == [(1,)]


def test_labels_are_half_open_and_masked(spark):
    rows = spark.createDataFrame([("m", "home", 0), ("m", "home", S), ("m", "away", 0)], "g string, team string, t long")
    events = spark.createDataFrame([("m", "home", S, "shot"), ("m", "home", 3 * S, "set_play")], "g string, team string, e long, kind string")
    got = labels.grid_labels(rows, events, ["g", "team"], "t", "e", F.lit(True), {"h": S})
    assert values(got, "team", "t", "label_mask_h", "label_shot_h") == [("away", 0, True, False), ("home", 0, True, True), ("home", S, True, False)]
    got = labels.grid_labels(rows, events, ["g", "team"], "t", "e", F.lit(True), {"h": 3 * S})
    assert ("home", 0, False, None) in values(got, "team", "t", "label_mask_h", "label_shot_h")


def alarm_rows(ps):
    return [("m", i * S // 10, p, "home", False) for i, p in enumerate(ps)]


def _alarms(params):
    return possession.AlarmSteps(0.5)


ALARM = "team string, start_us long, end_us long, ended_by string"


def test_alarms(spark):
    df = spark.createDataFrame(alarm_rows([0.1, 0.6, 0.45, 0.7, 0.3, 0.1]), "g string, ts_us long, p double, team string, dead boolean")
    assert values(possession.alarms(df, ["g"], [], 0.5), "start_us", "end_us", "ended_by") == [(S // 10, 4 * S // 10, "p")]
    m = possession.AlarmSteps(0.5)
    assert m.step({"ts_us": 0, "p": 0.9, "team": "home", "dead": False}) == []
    assert m.step({"ts_us": 1, "p": 0.9, "team": "away", "dead": False})[0]["ended_by"] == "team"
    assert m.end()[0]["team"] == "away"  # the row that ended one alarm started another
    m = possession.AlarmSteps(0.5)
    m.step({"ts_us": 0, "p": 0.9, "team": "home", "dead": False})
    assert m.step({"ts_us": 2 * S, "p": None, "team": "home", "dead": False}) == []
    assert m.step({"ts_us": 2 * S + 1, "p": None, "team": "home", "dead": False})[0]["ended_by"] == "stale"


def test_stream_equals_batch(spark, tmp_path):
    ps = [0.1, 0.6, 0.45, 0.7, 0.3, 0.1, 0.9, 0.9, None, 0.2, 0.8]
    kind = "g string, ts_us long, p double, team string, dead boolean"
    for i in range(3):
        spark.createDataFrame(alarm_rows(ps)[4 * i : 4 * i + 4], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = possession.alarms(spark.createDataFrame(alarm_rows(ps), kind), ["g"], [], 0.5).where("ended_by != 'period'")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.stream(source, ["g"], "ts_us", _alarms, ALARM).writeStream.format("memory").queryName("alarm_stream").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = values(spark.table("alarm_stream"), "start_us", "end_us", "ended_by")
    assert got == values(batch, "start_us", "end_us", "ended_by") and len(got) > 0


def test_alarms_equal_their_steps(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(30):
        t = 0
        for _ in range(60):
            t += int(r.choice([1, 5, 12])) * S // 10
            rows.append((str(g), t, None if r.random() < 0.25 else float(r.choice([0.2, 0.38, 0.41, 0.45, 0.6, 0.9])), str(r.choice(["home", "away"])) if r.random() < 0.6 else None, bool(r.random() < 0.05)))
    df = spark.createDataFrame(rows, "g string, ts_us long, p double, team string, dead boolean")
    names = ("g", "team", "start_us", "end_us", "ended_by")
    got = values(possession.alarms(df, ["g"], [], 0.5), *names)
    assert got == values(sequential.batch(df, ["g"], ["ts_us"], _alarms, ALARM), *names) and len(got) > 100
    assert {x[4] for x in got} == {"dead", "team", "p", "stale", "period"}


def carried(spark, rows, **parameters):
    """Rows (tenths of a second, x, y, candidate); what ``possession.carried`` says for each."""
    df = spark.createDataFrame([("m", t * S // 10, x, y, c, c and ("home" if c.startswith("h") else "away")) for t, x, y, c in rows], "g string, ts_us long, x double, y double, candidate string, candidate_team string")
    return [(r["carrier"], r["possession"], r["ball_state"]) for r in possession.carried(df, ["g"], [], **parameters).orderBy("ts_us").collect()]


def test_carrier(spark):
    # moving at 10 m/s: carried after 0.3 s; a gap of 0.5 s holds, a longer one doesn't; possession stays
    got = carried(spark, [(t, float(t), 0.0, "h1") for t in range(5)] + [(t, None, None, None) for t in range(5, 12)])
    assert [g[0] for g in got] == [None, None, None, "h1", "h1", "h1", "h1", "h1", "h1", "h1", None, None]
    assert {g[1] for g in got[3:]} == {"home"} and {g[2] for g in got} == {"alive"}
    # another candidate ends the carrier at once, and becomes one after 0.3 s
    got = carried(spark, [(t, float(t), 0.0, "h1" if t < 5 else "a1") for t in range(10)])
    assert [g[:2] for g in got[3:]] == [("h1", "home"), ("h1", "home"), (None, "home"), (None, "home"), (None, "home"), ("a1", "away"), ("a1", "away")]
    # nobody carries a ball that is out, and it is dead until kicked
    got = carried(spark, [(t, 50.0 + t, 0.0, "h1") for t in range(6)] + [(6, 20.0, 0.0, None), (7, 20.0, 0.0, None), (8, 21.0, 0.0, None)])
    assert [g[2] for g in got] == ["alive"] * 3 + ["dead"] * 3 + ["alive"] * 3 and [g[0] for g in got[3:6]] == [None] * 3
    # at rest for a second in midfield dies, in a penalty area it doesn't, in a goal area it does
    for x, y, dies in ((20.0, 20.0, True), (40.0, 15.0, False), (48.0, 0.0, True)):
        got = carried(spark, [(t, x, y, None) for t in range(16)])
        assert [g[2] for g in got] == ["alive"] * 11 + ["dead" if dies else "alive"] * 5
    # unseen for two seconds: no state; the team rule gives possession without a carrier
    assert [g[2] for g in carried(spark, [(0, 0.0, 0.0, None), (20, None, None, None), (21, None, None, None)])] == ["alive", "alive", None]
    assert carried(spark, [(0, 0.0, 0.0, "h1"), (2, 2.0, 0.0, "h2"), (4, 4.0, 0.0, "h1")], team_us=4 * S // 10)[-1][:2] == (None, "home")


def test_candidates(spark):
    rows = [("m", 1, "ball", "ball", None, 0.0, 0.0, 0.2, True), ("m", 1, "p2", "player", "away", 1.0, 0.0, None, True), ("m", 1, "p1", "player", "home", -1.0, 0.0, None, True), ("m", 1, "p0", "player", "home", 0.1, 0.0, None, False)]
    rows += [("m", 2, "ball", "ball", None, 0.0, 0.0, 1.0, True), ("m", 2, "p1", "player", "home", 0.0, 0.0, None, True), ("m", 3, "p1", "player", "home", 0.0, 0.0, None, True)]
    o = spark.createDataFrame(rows, "g string, frame_id long, object_id string, object_type string, team string, x double, y double, z double, visible boolean")
    assert values(possession.candidates(o, ["g"], "frame_id"), "frame_id", "candidate", "candidate_team") == [(1, "p1", "home"), (2, None, None)]


def test_other_machines(spark):
    ticks = spark.createDataFrame([("m", k, p) for k, p in ((1, 0.6), (2, 0.5), (3, 0.2), (4, 0.6), (6, 0.6))], "g string, k long, p double")
    assert [v[1] for v in values(possession.team_hysteresis(ticks, ["g"], "k", "p"), "k", "smoothed")] == ["home", "home", "away", "away", "home"]
    gate = machines.ViewGate(0.5, 2, 3)
    assert [gate.step({"ts_us": t, "share": s})[0]["on"] for t, s in ((0, 1), (1, 1), (2, 1), (3, 0), (6, 0))] == [False, False, True, True, False]
    track = machines.BallTrack()
    seen = [track.step({"ts_us": t, "candidates": c})[0]["kind"] for t, c in ((0, [(0, 0, 0.3)]), (100_000, [(0, 0, 0.9)]), (200_000, [(1, 0, 0.5), (30, 0, 0.9)]), (300_000, []), (2_000_000, []))]
    assert seen == [None, "seen", "seen", "coasted", None]
    limit = machines.RateLimit(10)
    assert [len(limit.step({"ts_us": t, "mark": True, "event_id": t})) for t in (0, 5, 10, 12)] == [1, 0, 1, 0]


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, y int")
    got = metrics.threshold_free(df, "p", "y").first()
    assert got["pr_auc"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and got["roc_auc"] == pytest.approx(3.5 / 4)
    assert metrics.threshold_free(df.where("y = 0"), "p", "y").first()["pr_auc"] is None
    folds = metrics.stratified_folds(spark.range(23).select(F.col("id").alias("m"), F.lit("s").alias("s"), (F.col("id") % 7).alias("n")), "m", "s", "n", 5, "x")
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]
    frozen = folds.select("m", "s", "n", "fold")
    later = spark.range(30).select(F.col("id").alias("m"), F.lit("s").alias("s"), F.lit(1).cast("long").alias("n"))
    both = metrics.appended_folds(frozen, later, "m", "s", "n", 5, "x")
    assert both.count() == 30 and both.intersect(frozen).count() == 23 and sorted(r["count"] for r in both.groupBy("fold").count().collect()) == [6] * 5
    best = metrics.choose_tau(spark.createDataFrame([(0.1, 0.5, 9.0), (0.2, 0.6, 2.0), (0.3, 0.6, 1.0)], "tau double, miss_rate double, false_per_match double"), 3).first()
    assert best["tau"] == 0.3 and not best["over_budget"]


def match(spark):
    m = spark.createDataFrame([("a", "0.6", "pff", None, None, None, "H", "A", 25.0)], schema.struct("match"))
    f = spark.createDataFrame([("a", i, 1, i / 25, True, "alive", "home", None, None, None) for i in range(3)], schema.struct("frames"))
    o = spark.createDataFrame([("a", i, w, k, t, p, 1.0, 2.0, None, None, None, True, False, 1.0) for i in range(3) for w, k, t, p in (("ball", "ball", None, None), ("h1", "player", "home", "p1"), ("a1", "player", "away", "p2"))], schema.struct("objects"))
    e = spark.createDataFrame([("a", 1, "shot", "home", "p1", 1.0, 2.0, None, None, None)], schema.struct("events"))
    p = spark.createDataFrame([("a", "p1", "home", 1, None, None), ("a", "p2", "away", 2, None, None)], schema.struct("players"))
    return {"match": m, "frames": f, "objects": o, "events": e, "players": p}


BROKEN = [
    ("match", {"native_fps": "0D"}, "native_fps: not above 0"), ("frames", {"frame_id": "1L"}, "frame_id repeats"), ("frames", {"period": "IF(frame_id = 2, 1L, 2L)"}, "period decreases"), ("frames", {"timestamp_s": "-1D * frame_id"}, "timestamp decreases"),
    ("frames", {"ball_carrier_id": "'zz'"}, "carrier absent"), ("frames", {"ball_carrier_id": "'h1'", "possession_team": "CAST(NULL AS STRING)"}, "carrier without team"), ("frames", {"ball_state": "'odd'"}, "ball_state: outside its domain"),
    ("objects", {"x": "99D"}, "x out of bounds"), ("objects", {"x": "DOUBLE('NaN')"}, "x: NaN"), ("objects", {"team": "'home'"}, "team on ball or referee"), ("objects", {"frame_id": "frame_id + 9"}, "frame unknown"), ("objects", {"object_type": "'ball'"}, "more than one ball"),
    ("objects", {"confidence": "2D"}, "confidence outside 0 to 1"), ("objects", {"visible": "false"}, "hidden but not interpolated"), ("objects", {"player_id": "'zz'"}, "player unknown"), ("events", {"outcome": "'disallowed'", "event_type": "'goal'"}, "disallowed goal"), ("players", {"player_id": "'p1'"}, "player repeats"),
]


def test_validation_names_the_rule(spark):
    """Each case breaks one table of a match of its own; one plan validates them all."""
    good = match(spark)
    many = {n: None for n in good}
    for i, (table, change, _) in enumerate(BROKEN):
        for n, df in good.items():
            own = (df.withColumns({c: F.expr(e) for c, e in change.items()}) if n == table else df).withColumn("match_id", F.lit(str(i)))
            many[n] = own if many[n] is None else many[n].unionByName(own)
    found = {(r["match_id"], r["rule"]) for r in validate.validated({n: df.cache() for n, df in many.items()}).collect()}
    assert {(str(i), rule) for i, (_, _, rule) in enumerate(BROKEN)} <= found


def test_rules_across_tables_wait_for_columns_and_tables(spark):
    t = match(spark)
    lost = t | {"frames": t["frames"].limit(0), "players": t["players"].limit(0)}
    assert values(validate.validated(lost), "table", "rule") == [("frames", "no rows")]
    stray = t | {"objects": t["objects"].withColumn("match_id", F.lit("b"))}
    assert set(values(validate.validated(stray), "match_id", "table", "rule")) == {("a", "objects", "no rows"), ("b", "frames", "no rows"), ("b", "match", "no rows")}
    odd = t | {"match": t["match"].withColumns({"source": F.lit("x"), "native_fps": F.lit(0.0)}), "events": t["events"].withColumn("set_piece", F.lit("y"))}
    assert set(values(validate.validated(odd), "rule", "sample")) == {("source: outside its domain", "x"), ("set_piece: outside its domain", "y")}
    text = t | {"frames": t["frames"].withColumn("view_polygon", F.lit(None).cast("array<string>"))}
    assert values(validate.validated(text), "rule") == [("view_polygon: array<string> is not array<double>",)]


def test_valid_match_passes_and_round_trips(spark, tmp_path):
    t = match(spark)
    assert validate.validated(t).count() == 0
    assert sinks.write_matches(t, str(tmp_path)).count() == 0
    assert sinks.read_matches(spark, str(tmp_path), "objects").count() == 9
    assert [r["rule"] for r in validate.validated(t | {"events": t["events"].drop("x")}).collect()] == ["x: missing"]


def test_predictions(spark, tmp_path):
    good = spark.createDataFrame([("a", 1, 0.1, 0.5)], "match_id string, period int, t_s double, p_h5 double")
    sinks.save_run(good, str(tmp_path / "run"))
    with pytest.raises(ValueError, match="outside 0 to 1"):
        sinks.save_run(good.withColumn("p_h5", F.lit(2.0)), str(tmp_path / "bad"))
    sinks.save_run(good.withColumn("p_h9", F.lit(0.1)), str(tmp_path / "kept"), {"model": "floor", "horizons": ["h5"], "tau": {"h5": {"0": 0.25}}})
    meta, rows = sinks.load_run(spark, str(tmp_path / "kept"))
    assert meta["tau"] == {"h5": {"0": 0.25}} and meta["run_id"] == "kept" and meta["created"] and set(rows.columns) == {"match_id", "period", "t_s", "p_h5"} and rows.count() == 1
    for wrong, why in (({"model": "m"}, "meta needs"), ({"model": "m", "horizons": ["h7"]}, "lack p_ columns")):
        with pytest.raises(ValueError, match=why):
            sinks.save_run(good, str(tmp_path / "no"), wrong)
    assert sinks.prediction_errors(good.union(good)).first()["rule"] == "repeated key"


def scene(spark):
    frames = spark.createDataFrame([("m", 1, k, "home" if k < 40 else "away", k >= 40) for k in range(80)], "match_id string, period int, k long, possession_team string, flipped boolean")
    rows = [("m", 1, k, "ball", "ball", None, k * 0.5, 1.0, 0.1, k % 4 != 3) for k in range(80)]
    rows += [("m", 1, k, f"{t}{i}", "goalkeeper" if i == 0 else "player", t, k * 0.4 + 3 * i, 2.0 * i - 4, None, True) for k in range(80) for t in ("home", "away") for i in range(4)]
    return frames, spark.createDataFrame(rows, "match_id string, period int, k long, object_id string, object_type string, team string, x double, y double, z double, visible boolean")


def test_features_are_causal(spark):
    frames, objects = scene(spark)
    full = features.match_features(frames, objects)
    later = objects.withColumn("x", F.when(F.col("k") > 50, F.col("x") + 7).otherwise(F.col("x")))
    names = full.columns
    a = full.where("k <= 50").select(*names)
    b = features.match_features(frames, later).where("k <= 50").select(*names)
    assert a.exceptAll(b).count() == 0
    assert full.where("k > 55").exceptAll(features.match_features(frames, later).where("k > 55").select(*names)).count() > 0


def test_feature_values(spark):
    frames, objects = scene(spark)
    r = {x["k"]: x for x in features.match_features(frames, objects).collect()}
    assert r[0]["possession_s"] == 0 and r[39]["possession_s"] == pytest.approx(3.9) and r[40]["possession_s"] == 0
    assert r[3]["ball_x"] == 1.0 and r[3]["ball_age_s"] == pytest.approx(0.1)  # unseen at tick 3, held from tick 2
    assert r[50]["ball_x"] == -25.0  # the away team attacks to the left
    assert r[10]["ball_speed"] == pytest.approx(5.0)
    nodes = features.graph_nodes(features.held_ball(features.gridded(frames), objects), objects, most=3)
    assert {len(x["players"]) for x in nodes.collect()} == {3}
    assert [w is None for w in features.graph_windows(nodes).where("k = 7").first()["window"]] == [True] * 4 + [False] * 2


def test_lead_players_and_heading(spark):
    frames, objects = scene(spark)
    held = features.held_ball(features.gridded(frames), objects)
    rows = {r["k"]: r for r in features.lead_player_features(held, objects).collect()}
    assert rows[70]["def_line_dist"] == pytest.approx(52.5 - (-28.0 - 3)) and rows[30]["att_near_box"] == 0
    assert rows[35]["def_line_change_3s"] == pytest.approx(-12.0) and rows[10]["def_line_change_3s"] is None
    assert rows[35]["carrier_goal_dist_change_3s"] is not None and rows[35]["carrier_goal_dist_change_5s"] is None
    whole = features.match_features(frames, objects)
    assert {"att_beyond_line", "carrier_goal_dist_change_5s", "possession_min_dist", "carrier_speed"} <= set(whole.columns) and whole.count() == frames.count()
    assert "att_near_box" not in features.match_features(frames, objects, "1").columns
    aged = features.match_features(frames.withColumn("carrier_age_s", F.lit(0.5)), objects, "3")
    assert aged.first()["poss_carrier_age_s"] == 0.5
    gone = features.player_features(features.held_ball(features.gridded(frames.where("k <> 38")), objects), objects)
    speed = {r["k"]: r["carrier_speed"] for r in gone.collect()}
    assert speed[37] is not None and all(speed[k] is None for k in range(39, 44)) and speed[44] is not None  # no speed reaches over a gap
    ball = features.held_ball(features.gridded(frames), objects).withColumns({"bvx": F.lit(5.0), "bvy": F.lit(0.0)})
    r = features.heading(ball, objects).where("k = 0").first()
    assert r["home_ahead_3"] == pytest.approx(min(math.hypot(3 * i - 1.5, 2 * i - 5) for i in range(4))) and 0 <= r["angle_to_nearest"] <= math.pi


def test_reviews(spark):
    step = S // 10
    ball = spark.createDataFrame([("m", i * step, x, 0.0) for i, x in enumerate((0.0, 0.1, 0.2, 1.7, 3.2, 4.7))], "g string, t long, x double, y double")
    assert values(reviews.kicks(ball, ["g"], "t"), "t") == [(2 * step,)]
    rows = spark.createDataFrame([("m", i, f, "home", t) for i, (f, t) in enumerate((("home", "home"), ("away", "home"), ("away", "away"), ("away", "away")))], "g string, t long, fast string, slow string, truth string")
    assert values(reviews.triggers(rows, ["g"], "t", "fast", "slow", "truth", 2), "t", "right") == [(1, True)]
    labels = spark.createDataFrame([("c", 1, True), ("c", 2, True), ("c", 3, False), ("d", 1, True)], "clip string, f int, automatic boolean")
    checks = spark.createDataFrame([("c", 1, True), ("d", 1, False)], "clip string, f int, changed boolean")
    assert values(reviews.withdrawn(labels, checks, "clip", "f"), "clip", "f") == [("c", 1), ("c", 3), ("d", 1)]
    points = spark.createDataFrame([("m", i * step, float(i), 0.0) for i in (0, 3, 6)], "g string, t long, dx double, dy double")
    assert values(reviews.drift(points, ["g"], "t"), "t", "bias_x") == [(0, 4.5), (3 * step, 3.0), (6 * step, 1.5)]
    found = spark.createDataFrame([(1, 0.0, 0.0, 0.9), (1, 50.0, 0.0, 0.2), (2, 90.0, 0.0, 0.9)], "f int, x double, y double, confidence double")
    at = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "f int, x double, y double")
    assert values(reviews.decided(at, found, ["f"], 5, 40), "f", "decision") == [(1, "positive"), (2, "missed"), (3, "missed")]
    marks = spark.createDataFrame([("m", 0, 10, "a", 1), ("m", 5, 20, "b", 2)], "g string, start long, end long, label string, ordinal int")
    pts = spark.createDataFrame([("m", 1), ("m", 7), ("m", 20)], "g string, t long")
    assert values(reviews.marked_at(pts, marks, ["g"], "t", 10), "t", "label") == [(1, "a"), (20, None), (7, "b")]


def test_mirror_twice_is_identity(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, -3.0)], "x double, home_d double, away_d double, diff double")
    m = lambda d: features.mirrored(d, ["x"], [("home_d", "away_d")], {"diff": ("home_d", "away_d")})
    assert m(df).first().asDict() == {"x": -1.0, "home_d": 5.0, "away_d": 2.0, "diff": 3.0}
    assert m(m(df)).first() == df.first()


def test_faults_are_deterministic_and_sized(spark):
    ticks = spark.range(4000).select(F.lit("m").alias("match_id"), F.lit(1).alias("period"), F.col("id").alias("k"))
    on = augment.episodes(ticks, ["match_id", "period"], "k", 0.2, 20, "s", "on")
    share = on.agg(F.avg(F.col("on").cast("double"))).first()[0]
    assert 0.1 < share < 0.3
    frames, objects = scene(spark)
    worse = augment.applied(objects, frames.select("match_id", "period", "k"), {"player_noise": 1.0, "team_flip": 0.2, "no_ball_z": 1.0}, "s")
    again = augment.applied(objects, frames.select("match_id", "period", "k"), {"player_noise": 1.0, "team_flip": 0.2, "no_ball_z": 1.0}, "s")
    assert worse.exceptAll(again).count() == 0 and worse.where("object_type = 'ball' AND z IS NOT NULL").count() == 0
    s = augment.severity(objects, worse, ["match_id", "period", "k", "object_id"]).first()
    assert 0.5 < s["rms"] < 2.5 and s["hidden"] == 0


def test_noise_is_correlated_in_time(spark):
    ticks = spark.range(4000).select(F.lit("m").alias("match_id"), F.lit(1).alias("period"), F.col("id").alias("k"))
    d = augment.drifts(ticks, ["match_id", "period"], ["dx", "dy"], 5, "s").orderBy("k").toPandas()
    assert len(d) == 4000 and all(0.8 < d[c].std() < 1.2 for c in ("dx", "dy"))
    assert abs(d.dx.autocorr(1) - math.exp(-1 / 5)) < 0.06 and abs(d.dx.corr(d.dy)) < 0.2


def test_arms_go_by_the_clean_ball(spark):
    rows = [("m", 1, k, f"{t}_{i}", "player", t, x, 0.0, None, True) for k in range(1500) for i, (t, x) in enumerate((("home", 2.0), ("away", 40.0)))]
    rows += [("m", 1, k, "ball", "ball", None, 0.0, 0.0, None, True) for k in range(1500) if k != 7]
    objects = spark.createDataFrame(rows, "match_id string, period int, k long, object_id string, object_type string, team string, x double, y double, z double, visible boolean")
    ticks = objects.select("match_id", "period", "k").distinct()
    assert augment.ball_carried(objects).where("k = 7").first()[3:] == (0.0, 0.0)
    flipped = augment.applied(objects, ticks, {"team_flip": 0.1, "camera_drift": 1.0, "ball_false": 0.1}, "s")
    wrong = {r["object_id"]: r["n"] for r in flipped.where("substring_index(object_id, '_', 1) != team").groupBy("object_id").agg(F.count("*").alias("n")).collect()}
    assert wrong["home_0"] > wrong.get("away_1", 0) > 0 and flipped.count() == len(rows)
    moved = flipped.where("object_id = 'away_1'").agg(F.avg((F.col("x") - 40) ** 2 + F.col("y") ** 2)).first()[0]
    assert 0.3 < moved / 2 < 3
    far = flipped.where("object_type = 'ball' AND hypot(x, y) > 4").count()
    assert 20 < far < 500
    empty = augment.applied(objects.limit(0), ticks.limit(0), dict.fromkeys(augment.ARMS, 0.1), "s")
    assert empty.count() == 0 and empty.columns == objects.columns


def test_tables(spark):
    o = spark.createDataFrame([(1, "b", "home", 0.0, 1.0), (1, "a", "away", 0.0, -1.0), (1, "c", None, 5.0, 5.0)], "f int, object_id string, team string, x double, y double")
    t = spark.createDataFrame([(1, 0.0, 0.0)], "f int, bx double, by double")
    assert values(tables.nearest(o, t, ["f"]), "object_id") == [("a",)]
    d = o.withColumn("d", F.hypot("x", "y"))
    assert values(tables.tie_weights(d, ["f"], "d"), "team", "weight") == [("away", 0.5), ("home", 0.5)]
    sweep = spark.createDataFrame([(-1, 0.5), (0, 0.9), (1, 0.9), (2, 0.9)], "shift int, share double")
    assert tables.plateau_middle(sweep).first()["shift"] == 1
    assert values(validate.off_pitch_runs(spark.createDataFrame([("m", k, "p", "player", 60.0, 0.0) for k in (1, 2, 5)], "m string, k long, object_id string, object_type string, x double, y double"), ["m"], "k"), "first", "last") == [(1, 2), (5, 5)]


def test_market(spark):
    word = lambda n: f"{n:064x}"
    data = "0x" + word(0) + word(7) + word(2_500_000) + word(5_000_000)
    logs = spark.createDataFrame([(1, 0, 5, "t", ["x", "y", "0x" + "0" * 24 + "ab" * 20], data)], "block long, log_index int, ts long, tx string, topics array<string>, data string")
    r = market.matched_trades(logs, spark.createDataFrame([(word(7), "home")], "token string, outcome string")).first()
    assert (r["side"], r["usdc"], r["shares"], r["wallet"]) == ("BUY", 2.5, 5.0, "0x" + "ab" * 20)
    e = spark.createDataFrame([(1, 0), (2, 0), (3, 10)], "id long, t long").withColumn("m", F.lit(1))
    assert values(market.spread(e, ["m"], "t", "id", 4), "id", "at_us") == [(1, 0), (2, 2), (3, 10)]


def test_sources(spark, tmp_path):
    def person(n, x=1.0):
        return {"jerseyNum": n, "confidence": "HIGH", "visibility": "VISIBLE", "x": x, "y": 2.0}

    def line(n, **more):
        return {"frameNum": n, "period": 1, "periodElapsedTime": n / 30, "videoTimeMs": n * 33.0, "homePlayers": [person("9"), person("9", 5.0)], "awayPlayers": [], "balls": [{"visibility": "VISIBLE", "x": 0.0, "y": 0.0, "z": 0.2}]} | more

    rows = [line(1, game_event={"game_event_type": "OTB", "home_ball": True}), line(2, balls=[]), line(2), line(3, period=None, game_event={"game_event_type": "OUT"}), line(4)]
    (tmp_path / "g1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    kept = tracking.with_drop_reason(tracking.carried_state(tracking.tracking_lines(spark, str(tmp_path / "g1.jsonl"))))
    f = tracking.frames(kept)
    assert values(f, "match_id", "frame_id", "ball_state", "possession_team") == [("g1", 1, "alive", "home"), ("g1", 2, "alive", "home"), ("g1", 4, "dead", "home")]
    assert values(tables.drop_report(kept, "drop_reason", ["match_id"]), "drop_reason", "n") == [("no period", 1), ("repeated frame", 1)]
    o = tracking.objects(kept)
    assert o.where("object_id = 'home_9'").count() == 3 and o.where("object_id = 'home_9' AND x = 5").count() == 0
    wide = spark.createDataFrame([(1, 1.0, 2.0, None, None)], "k int, a_x double, a_y double, b_x double, b_y double")
    assert values(tracking.long_objects(wide, ["k"], ["a", "b"]), "object_id", "x") == [("a", 1.0)]
    ev = lambda n, kind, sp, home, shot=None: {"gameEventId": n, "eventTime": float(n), "gameEvents": {"gameEventType": kind, "setpieceType": sp, "period": 1, "homeTeam": home, "startGameClock": float(n)}, "possessionEvents": {"possessionEventType": "SH" if shot else "PA", "shotOutcomeType": shot}, "ball": [{"x": 1.0, "y": 2.0}]}
    (tmp_path / "e1.json").write_text(json.dumps([ev(1, "OTB", "O", True, "G"), ev(2, "SECONDKICKOFF", "K", False), ev(3, "OTB", "O", True, "G"), ev(4, "OTB", "F", True), ev(5, "OTB", "O", False, "S")]))
    r = tracking.event_rows(spark, str(tmp_path / "e1.json"))
    assert values(tracking.parsed_events(r), "gameEventId", "outcome", "team") == [(1, "goal", "home"), (3, "disallowed", "home"), (5, "s", "away")]
    assert values(tracking.restarts(r), "code") == [("F",)]
    (tmp_path / "p.json").write_text(json.dumps({"home": [{"t": 1.0, "p": 0.5}], "away": []}))
    assert values(tracking.price_history(spark, str(tmp_path / "p.json")), "side", "p") == [("home", 0.5)]


def test_models(spark):
    rows = spark.range(200).select("id", (F.col("id") / 100).alias("x"), (F.col("id") > 90).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    out = models.out_of_fold(rows, ["x"], "y", "fold", [0, 1, 2])
    assert out.count() == 200 and metrics.threshold_free(out, "p", "y").first()["roc_auc"] > 0.99
    a, b = models.recalibration(out, "p", "y")
    assert b > 0
    some = rows.withColumn("x", F.when(F.col("id") % 10 != 0, F.col("x")))
    scored = models.boosted_scores(models.boosted(some, ["x"], "y", rounds=5), some, ["x"])
    assert scored.count() == 200 and scored.where("p IS NULL").count() == 0
    floor = models.floor_scores(some, some, ["x"], "y", F.col("id") != 5)
    assert floor.count() == 200 and floor.where("p IS NULL").count() == 1
    assert len(models.plan([0, 1, 2, 3, 4])) == 15


def test_only_labels_look_ahead():
    from pathlib import Path

    import gridmark

    root = Path(gridmark.__file__).parent / "operators"
    assert not [p.name for p in (root / "features.py",) if "Following" in p.read_text()]
