"""Event arrays read by several tasks, metadata, sanity reports, frozen folds and small joins."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridmark.operators import checks
from gridmark.sources import tracking


def element(r, i):
    words = ["plain", "quote \" in", "brace } in", "{ open", "back\\slash", "\\\"}", "ünïcode }{", "[list]", "end\\", ""]
    return {"id": i, "text": r.choice(words), "more": {"a": [{"b": r.choice(words)} for _ in range(r.randint(0, 3))], "c": None}, "n": r.randint(0, 99)}


@pytest.mark.parametrize("size", [40, 137, 1_000_000])
def test_large_arrays_keep_their_order(spark, tmp_path, size):
    r = random.Random(size)
    want = {}
    for name, n, indent in (("g1", 120, None), ("g2", 60, 2), ("g3", 0, None), ("g4", 1, 4)):
        rows = [element(r, i) for i in range(n)]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
        want[name] = rows
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = tracking.json_elements(spark, f"{tmp_path}/*.json")
        got = {}
        for x in found.orderBy("file", "row").collect():
            got.setdefault(x["file"].split("/")[-1][:2], []).append((x["row"], json.loads(x["element"])))
        if size < 1000:
            assert spark.read.option("lineSep", "}").text(f"{tmp_path}/*.json").rdd.getNumPartitions() > 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {k: list(enumerate(v)) for k, v in want.items() if v}


def test_metadata_turns_matches(spark, tmp_path):
    for name, left in (("m1", True), ("m2", False)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"homeTeamStartLeft": left, "fps": 29.97, "homeTeam": {"id": "7"}}, {"homeTeamStartLeft": None}]))
    meta = tracking.metadata(spark, f"{tmp_path}/*.json", "homeTeamStartLeft boolean, fps double, homeTeam struct<id:string>")
    assert {(r["match_id"], r["homeTeamStartLeft"], r["homeTeam"]["id"]) for r in meta.collect()} == {("m1", True, "7"), ("m2", False, "7")}
    objects = spark.createDataFrame([(m, 1.0, 2.0, "o") for m in ("m1", "m2", "m3")], "match_id string, x double, y double, object_id string")
    assert {r["match_id"]: (r["x"], r["y"]) for r in tracking.facing_right(objects, meta, "homeTeamStartLeft").collect()} == {"m1": (1, 2), "m2": (-1, -2), "m3": (1, 2)}


def test_small_joins(spark):
    frozen = spark.createDataFrame([("a", 0), ("b", 1)], "match_id string, fold int")
    assert checks.frozen_folds(frozen.orderBy("fold"), frozen, "match_id").count() == 2
    for other in ([("a", 0)], [("a", 0), ("b", 2)], [("a", 0), ("b", 1), ("c", 1)]):
        with pytest.raises(ValueError, match="differ from the frozen folds"):
            checks.frozen_folds(spark.createDataFrame(other, "match_id string, fold int"), frozen, "match_id")
    states = spark.createDataFrame([(1, "p"), (2, None), (3, "q"), (4, "r")], "frame_id long, carrier string").withColumn("match_id", F.lit("a"))
    objects = spark.createDataFrame([("a", "p", "home"), ("a", "p", "home"), ("a", "q", None), ("b", "r", "away")], "match_id string, object_id string, team string")
    assert {r["frame_id"]: r["carrier_team"] for r in checks.carrier_teams(states, objects, ["match_id"]).collect()} == {1: "home", 2: None, 3: None, 4: None}
    frames = spark.createDataFrame([("a", 10, 1, 5.0), ("a", 11, 2, 6.0), ("a", 12, 1, 1.0)], "match_id string, frame_id long, period long, timestamp_s double")
    events = spark.createDataFrame([("a", 10, "shot", "home", None), ("a", 10, "pass", "home", None), ("a", 11, "goal", "away", "corner"), ("a", 12, "goal", "home", None)], "match_id string, frame_id long, event_type string, team string, set_piece string")
    clips = spark.createDataFrame([("c", "a", 1, 2.0, 0.5), ("d", "a", 2, 0.0, 0.0)], "clip string, match_id string, period long, offset_s double, start_s double")
    assert {(r["clip"], r["run_frame"], r["event_type"]) for r in checks.on_video(events, frames, clips, ["shot", "goal"], 10.0).collect()} == {("c", 25, "shot"), ("d", 60, "goal")}
    starts = spark.createDataFrame([("a", 2, 1_000_000_000)], "match_id string, period long, start_us long")
    synced = spark.createDataFrame([("z", 5, "home")], "match_id string, utc_us long, team string")
    assert {tuple(r) for r in checks.goal_times(events, frames, starts, synced).collect()} == {("a", 1_006_000_000, "away", "corner"), ("z", 5, "home", None)}
    results = spark.createDataFrame([("v1", None, 0.3), ("v2", "v1", 0.4), ("v3", "v2", 0.5)], "version string, source string, score double")
    assert {(r["root"], r["depth"], r["version"]) for r in checks.earlier_attempts(results, "version", "source").collect()} == {("v1", 0, "v1"), ("v2", 0, "v2"), ("v2", 1, "v1"), ("v3", 0, "v3"), ("v3", 1, "v2"), ("v3", 2, "v1")}
    with pytest.raises(ValueError, match="run it first"):
        checks.earlier_attempts(results.where("version <> 'v1'"), "version", "source")
    loop = spark.createDataFrame([("x", "y", 1.0), ("y", "x", 1.0)], "version string, source string, score double")
    assert checks.earlier_attempts(loop, "version", "source").count() == 6
