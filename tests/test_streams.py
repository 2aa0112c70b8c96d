"""Streams against batch: ties over micro-batches, causal lookups, and fills that are validated and repeatable."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridmark import schema
from gridmark.operators import asof, sequential
from gridmark.sources import sinks
from gridmark.streaming import fill, stateful


class Count:
    def __init__(self, params):
        self.n, self.last = 0, None

    def step(self, row):
        self.n += 1
        self.last = row["v"]
        return [{"ts_us": row["ts_us"], "v": row["v"], "n": self.n}]

    def end(self):
        return []


def files(spark, kind, parts, path):
    for p in parts:
        spark.createDataFrame(p, kind).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(path))


def ran(df, name, path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_equal_times_all_count(spark, tmp_path):
    kind = "g string, ts_us long, v long"
    parts = [[("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", None, 9)], [("a", 2, 4), ("a", 2, 2), ("a", 1, 7), ("b", 5, 1)], [("a", 3, 5), ("a", 3, 5), ("b", 5, 2)]]
    source = files(spark, kind, parts, tmp_path / "in")
    got = ran(stateful.stream(source, ["g"], "ts_us", Count, "ts_us long, v long, n long"), "ties", tmp_path / "ck").collect()
    assert sorted(((r["ts_us"], r["v"]) for r in got if r["g"] == "a"), key=str) == [(1, 1), (1, 2), (2, 2), (2, 3), (2, 4), (3, 5), (3, 5)]  # the row of time 1 came late
    assert [r["v"] for r in sorted((r for r in got if r["g"] == "b"), key=lambda r: r["n"])] == [9, 1, 2]
    source = files(spark, kind, parts, tmp_path / "in2")
    got = ran(stateful.stream(source, ["g"], "ts_us", Count, "ts_us long, v long, n long", tie=("v",)), "ties2", tmp_path / "ck2").collect()
    rows = [r for p in parts for r in p if r not in (("a", 1, 7), ("a", 2, 2))]  # with a tie, (2, 2) is before (2, 3)
    batch = sequential.batch(spark.createDataFrame(rows, kind), ["g"], ["ts_us", "v"], Count, "ts_us long, v long, n long").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch), key=str)


def test_causal_lookup_equals_batch(spark, tmp_path):
    base = dt.datetime(2026, 1, 1, 12)
    at = lambda s: base + dt.timedelta(seconds=s)
    left_kind, right_kind = "g string, at timestamp, id long", "g string, at timestamp, seq long, p double, since timestamp"
    left = [[("a", at(1), 1), ("a", at(5), 2), ("b", at(2), 3), ("a", at(5), 4)], [("a", at(3.000001), 5), ("a", at(20), 6), ("b", at(2.5), 7)], [("a", at(400), 99), ("a", at(30), 8)], [("z", at(900), 98)]]
    right = [[("a", at(0.5), 1, 0.1, at(0)), ("a", at(3), 2, 0.2, at(3.25))], [("a", at(5), 3, 0.3, None), ("a", at(5), 4, 0.4, at(5)), ("b", at(2.5), 5, None, at(1))], [("a", at(3.000001), 6, 1 / 3, at(3))], [("z", at(901), 7, 0.9, at(1))]]
    columns = {"p": "p", "since": "since"}
    streams = files(spark, left_kind, left, tmp_path / "l"), files(spark, right_kind, right, tmp_path / "r")
    got = ran(stateful.asof_stream(*streams, ["g"], "at", columns, delay="60 seconds", most_age_us=10_000_000, order=("seq",)), "lookups", tmp_path / "ck")
    flat = lambda v, kind: spark.createDataFrame([x for p in v for x in p], kind).withColumn("us", F.unix_micros("at"))
    batch = asof.asof_backward(flat(left, left_kind), flat(right, right_kind), ["g"], "us", "us", columns, most_age=10_000_000, right_order=["seq"])
    want = {tuple(r) for r in batch.where("id < 98").select("g", "at", "id", "p", "since").collect()}
    assert {tuple(r) for r in got.where("id < 98").collect()} == want and len(want) == 8
    by = {r["id"]: r for r in got.collect()}
    assert by[4]["p"] == by[2]["p"] == 0.4 and by[5]["p"] == 1 / 3 and by[6]["p"] is None and by[3]["p"] is None


def tables(spark, team="home"):
    """Two matches of two seconds: a player dribbles the ball."""
    t = {n: [] for n in schema.DDL}
    for m in ("a", "b"):
        t["match"].append((m, "0.6", "vision", None, None, None, "H", "A", 10.0))
        t["players"].append((m, "P", "home", 9, None, None))
        for i in range(20):
            t["frames"].append((m, i, 1, i / 10, True, None, None, None, None, None))
            t["objects"] += [(m, i, "h1", "player", team, None, 0.5 * i - 5, 1.0, None, None, None, True, False, 0.9), (m, i, "ball", "ball", None, None, 0.5 * i - 5, 1.4, None, None, None, True, False, 0.9)]
    return {n: spark.createDataFrame(v, schema.struct(n)) for n, v in t.items()}


def test_fills_are_validated_and_repeatable(spark, tmp_path):
    root, reports = f"{tmp_path}/gs", f"{tmp_path}/reports"
    assert sinks.write_matches(tables(spark), root).isEmpty()
    read = lambda: sorted(map(str, sinks.read_matches(spark, root, "frames").collect()))
    before = read()
    arrived = files(spark, "match_id string", [[("a",)], [("b",), ("b",)]], tmp_path / "arrived")
    q = arrived.writeStream.foreachBatch(fill.fill_batches(root, reports)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    once = read()
    assert once != before and len(once) == 40
    late = sinks.read_matches(spark, root, "frames").where("timestamp_s >= 1")
    assert late.where("possession_team = 'home' AND ball_carrier_id = 'h1'").count() == late.count() == 20
    got = {r["match_id"]: r for r in spark.read.parquet(reports).collect()}
    assert got["a"]["batch"] == 0 and got["b"]["batch"] == 1 and got["b"]["possession_set_share"] > 0.8 and got["a"]["frames"] == 20
    fill.fill_batches(root, reports)(spark.createDataFrame([("a",)], "match_id string"), 0)  # a replayed batch
    assert read() == once and fill.latest_reports(spark.read.parquet(reports)).count() == 2
    bad = tables(spark)
    bad["objects"] = bad["objects"].withColumn("confidence", F.when((F.col("match_id") == "b") & (F.col("frame_id") == 3), 7.0).otherwise(F.col("confidence")))
    assert not sinks.write_matches(bad, f"{tmp_path}/bad").isEmpty()
    with pytest.raises(ValueError, match="nothing was replaced"):
        fill.fill_matches(spark.createDataFrame([("a",), ("b",)], "match_id string"), f"{tmp_path}/bad")
    assert sinks.read_matches(spark, f"{tmp_path}/bad", "frames").where("possession_team IS NOT NULL").isEmpty()
    sinks.write_matches(tables(spark, None), f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no player has a team"):
        fill.fill_matches(spark.createDataFrame([("a",)], "match_id string"), f"{tmp_path}/none")


def test_carriers_that_a_table_must_not_name(spark):
    """A carrier before any team, and one whose track is gone while he still carries."""
    t = tables(spark)
    objects = t["objects"].where("match_id = 'a'")
    teamless = objects.withColumn("team", F.when(F.col("object_id") == "h1", None).otherwise(F.col("team")))
    frames, report = fill.filled_frames(t["frames"].where("match_id = 'a'"), teamless)
    assert frames.where("ball_carrier_id IS NOT NULL").isEmpty() and report.first()["carrier_without_team_dropped"] > 0
    frames, report = fill.filled_frames(t["frames"].where("match_id = 'a'"), objects.where("frame_id NOT IN (10, 11)"))
    assert report.first()["carrier_not_in_frame_dropped"] == 2 and frames.where("frame_id IN (10, 11) AND ball_carrier_id IS NOT NULL").isEmpty()
    assert frames.columns == schema.struct("frames").fieldNames()
