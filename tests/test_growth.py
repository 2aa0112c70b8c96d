"""Steps whose work must grow no faster than their rows, and results on rows that small tables lack."""

import math
import random
import statistics

from pyspark.sql import functions as F

from gridmark import session
from gridmark.operators import asof, clips, crowds, machines, market, metrics, reviews, tables, validate
from gridmark.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_forward_lookups_run_backwards(spark, small):
    for name in ("asof_forward_by_team", "asof_forward_strict", "asof_nearest_tolerance", "next_restart"):
        assert "unboundedfollowing" not in plan(catalog.QUERIES[name](spark, small)), name


def test_forward_lookup_without_a_time(spark):
    left = spark.createDataFrame([(1, 10), (1, None), (1, 25), (1, 26)], "g int, t long")
    right = spark.createDataFrame([(1, 25, 1, "b"), (1, 25, 2, "c"), (1, None, 3, "d")], "g int, t long, n int, v string")
    got = lambda strict: values(asof.asof_forward(left, right, ["g"], "t", "t", {"v": "v"}, strict=strict, right_order=["n"]), "t", "v")
    assert got(False) == [(10, "b"), (25, "b"), (26, None), (None, None)]
    assert got(True) == [(10, "b"), (25, None), (26, None), (None, None)]


def test_medians_move_with_their_window(spark, small):
    draw = random.Random(3)
    rows = sorted(((draw.randrange(400), draw.choice([None, *range(30)])) for _ in range(1500)), key=lambda r: r[0])
    m = machines.TrailingMedian(40)
    for t, v in rows:
        before = [p for at, p in rows if p is not None and t - 40 <= at < t]
        assert m.step(t, v) == ((statistics.median(before), len(before)) if before else (None, 0))
    assert m.step(None, 1.0) == (None, 0)
    trades = spark.createDataFrame([(2**60 + i, "a", t, None if v is None else float(v)) for i, (t, v) in enumerate(rows)], "id long, k string, t long, v double")
    got = market.jumps(trades, ["k"], "t", "v", 40, 10.0, 5)
    medians = {2**60 + i: statistics.median(b) for i, (t, v) in enumerate(rows) if v is not None and len(b := [p for at, p in rows if p is not None and t - 40 <= at < t]) >= 5}
    assert values(got, "id", "jump") == sorted((i, float(rows[i - 2**60][1] - m)) for i, m in medians.items() if rows[i - 2**60][1] >= m + 10)
    assert "percentile" not in plan(catalog.QUERIES["trailing_median_jump"](spark, small))


def test_equal_distances_are_equal(spark):
    """Of places equally far the lesser id counts, and a distance is the root of a sum of squares to its last digit."""
    near = spark.createDataFrame([(1, i, "home", float(x), str(y)) for i, (x, y) in enumerate([(0.68, "1.36"), (1.36, "0.68")])], "f int, object_id int, team string, x double, y string").withColumn("y", F.col("y").cast("decimal(10,2)"))
    ball = spark.createDataFrame([(1, 0.0, "0")], "f int, bx double, by string").withColumn("by", F.col("by").cast("decimal(10,2)"))
    assert values(tables.nearest(near, ball, ["f"]), "object_id") == [(0,)]
    draw = random.Random(1)
    pairs = [(draw.randrange(-5000, 5000) / 100, draw.randrange(-5000, 5000) / 100) for _ in range(2000)]
    d = spark.createDataFrame(pairs, "x double, y double").select("x", "y", tables.apart(F.col("x"), F.col("y")).alias("d"))
    assert all(r["d"] == math.sqrt(r["x"] * r["x"] + r["y"] * r["y"]) for r in d.collect())
    assert any(math.hypot(x, y) != math.sqrt(x * x + y * y) for x, y in pairs)


def test_kicks_after_a_repeated_place(spark):
    step = 100_000
    ball = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, step, 5.0, 0.0), (1, 2 * step, 5.0, 0.0), (1, 3 * step, 8.0, 0.0), (1, 4 * step, 11.0, 0.0)], "g int, t long, x double, y double")
    assert values(reviews.kicks(ball, ["g"], "t", repeats=True), "t", "before", "after") == [(2 * step, 0.0, 30.0)]
    assert values(reviews.kicks(ball, ["g"], "t"), "t") == []


def test_triggers_look_up_the_next_time(spark, small):
    rows = spark.createDataFrame([(1, 0, "a", "a", None), (1, 1, "b", "a", "a"), (1, 2, "b", "a", "b"), (1, 4, "a", "a", "a"), (1, 5, "b", "a", None), (1, 9, "b", "a", "b")], "g int, t long, fast string, slow string, truth string")
    assert values(reviews.triggers(rows, ["g"], "t", "fast", "slow", "truth", 4), "t", "right", "seen") == [(1, False, ["b", "a"]), (5, True, ["b"])]
    assert values(reviews.triggers(rows, ["g"], "t", "fast", "slow", "truth", 2), "t", "right", "seen") == [(1, True, ["b"]), (5, False, [])]
    assert "rangeframe" not in plan(catalog.QUERIES["trigger_rows"](spark, small))


def test_marks_are_not_paired_with_points(spark, small):
    draw = random.Random(5)
    marks = [(draw.choice([1, 2]), a, a + draw.randrange(60), n, f"m{n}") for n, a in enumerate(draw.randrange(300) for _ in range(200))]
    points = [(draw.choice([1, 2, 3]), t, 2**60 + t) for t in range(300)] + [(1, 7, None), (None, 7, 1), (1, None, 2)]
    got = reviews.marked_at(spark.createDataFrame(points, "g int, t long, id long"), spark.createDataFrame([*marks, (None, 0, 300, 999, "x"), (1, 0, 300, None, "y")], "g int, start long, end long, ordinal long, label string"), ["g"], "t", 25)
    held = lambda g, t: max(((m[3], m[4]) for m in marks if t is not None and m[0] == g and m[1] <= t < m[2]), default=(0, None))[1]
    assert values(got, "g", "t", "id", "label") == sorted(((g, t, i, held(g, t)) for g, t, i in points), key=str)
    assert " join " not in plan(catalog.QUERIES["views_marked"](spark, small))


def test_summary_of_no_frames(spark):
    frames = spark.createDataFrame([], "clip long, has_truth boolean, view string, geometry boolean, n_truth long, n_vis long")
    pairs = spark.createDataFrame([], "clip long, near boolean, geometry boolean, d double")
    assert values(clips.summary(frames, pairs), "clip", "n_scored", "n_truth", "n_pairs", "median_m") == [(None, 0, None, 0, None)]


def test_carried_state_reads_no_sliding_frames(spark, small):
    assert "rangeframe" not in plan(catalog.QUERIES["carrier_state"](spark, small))


def test_amounts_on_both_sides_of_2_52(spark):
    numbers = [0, 1, 10**6 + 1, 2**52 - 1, 2**52, 2**53 + 1, 2**60 + 7, 2**96 - 1, 2**96]
    words = spark.createDataFrame([(i, f"{n:064x}") for i, n in enumerate(numbers)], "i int, w string").select("i", market._amount(F.col("w")).alias("v"), market._fits(F.col("w")).alias("fits"))
    assert values(words, "i", "v", "fits") == [(i, n / 10**6 if n < 2**96 else None, n < 2**96) for i, n in enumerate(numbers)]
    assert "rlike" not in plan(catalog.QUERIES["trades_from_logs"](spark, "/root/testdata/sf0.001"))


def test_shots_are_not_paired_with_alarms(spark, monkeypatch):
    """Alarms that follow each other are looked up; where some outlast later ones, or start together, the result is that of all pairs."""
    draw = random.Random(7)

    def taken(alarms, shots, grace):
        got = {}
        for g, n, t in shots:
            held = [(t > b, -a, i, t - a) for h, i, a, b in alarms if g is not None and h == g and a < t <= b + grace]
            got[n] = min(held)[2:] if held else (None, None)
        return sorted(((n, *v) for n, v in got.items()), key=str)

    def scored(alarms, shots, grace):
        a = spark.createDataFrame(alarms, "g string, alarm_id string, start_us long, end_us long").withColumn("tau", F.lit(0.5))
        s = spark.createDataFrame(shots, "g string, shot_id long, ts_us long").withColumn("tau", F.lit(0.5))
        return values(metrics.score_alarms(s, a, ["g"], grace, 50, ["tau"]), "shot_id", "alarm_id", "lead_us")

    shots = [(draw.choice(["a", "b", "c", None]), n, draw.choice([None, *range(400)])) for n in range(300)]
    shots = [(g, n, -1 if t is None else t) for g, n, t in shots]
    mixed = [(draw.choice("ab"), f"{n:02}", t, t + draw.choice([0, 3, 20, 90])) for n, t in enumerate(draw.randrange(0, 400, 5) for _ in range(60))]
    assert scored(mixed, shots, 15) == taken(mixed, shots, 15)
    edges = sorted(draw.sample(range(400), 60))
    series = [("a", f"{n:02}", a, b) for n, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True))] + [("a", "99", edges[1], edges[2])]
    monkeypatch.setattr(asof, "interval_join", None)  # alarms of a series need no pairs
    assert scored(series, shots, 15) == taken(series, shots, 15)


def test_validation_is_dealt_out_by_rows(spark, monkeypatch):
    """Twice the rows are twice the tasks: merged ones would sort all rows of a table, however small their bytes."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    frames = lambda n: spark.range(n).selectExpr("CAST(id % 7 AS STRING) AS match_id", "id AS frame_id", "1L AS period", "DOUBLE(id) AS timestamp_s", "'alive' AS ball_state", "'p' AS ball_carrier_id", "IF(id = 9, NULL, 'home') AS possession_team", "false AS set_play_phase")
    for n in (400, 800):
        rows = frames(n)
        once, gone = validate.repeats(rows.union(rows.limit(1)), "frames", ["frame_id"], "repeats"), validate.strays(rows, "frames", rows.where("frame_id <> 11"), ["match_id", "frame_id"], "unknown")
        assert [df.rdd.getNumPartitions() for df in (validate.frame_faults(rows), once, gone)] == [n // 100, n // 100 + 1, n // 50]
        assert [values(df, "match_id", "sample") for df in (validate.frame_faults(rows), once, gone)] == [[("2", "9")], [("0", "0")], [("4", "11")]]


def most_rows(spark, df):
    """The rows of ``df``, and the most that any step of its plan put out."""
    rows = df.collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    made, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
    metrics = [m.apply(i) for m in (nodes.apply(n).metrics() for n in range(nodes.size())) for i in range(m.size())]
    counts = [made.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
    return rows, max(int(c.get().replace(",", "")) for c in counts if c.isDefined())


def nearest_of_all_pairs(a, b, gate, unit=1):
    """The pairs that come first for both of those within the gate, by d, a's id and b's id; y in parts of a unit."""
    d = sorted((d, i, j) for i, x, y in a for j, u, v in b if (d := math.sqrt((x - u) * (x - u) + (y - v) / unit * ((y - v) / unit))) <= gate)
    of_a, of_b = {}, {}
    for p in d:
        of_a.setdefault(p[1], p)
        of_b.setdefault(p[2], p)
    return sorted((i, j, d) for d, i, j in of_a.values() if of_b[j] == (d, i, j))


def test_mutual_nearest_makes_no_pairs(spark, tmp_path):
    """One match and day of 600 views and 600 clicks, that is 360,000 pairs: no step puts out more than a few times the rows."""
    n, draw = 1200, random.Random(8)
    places = [(i, draw.randrange(10500), draw.randrange(100)) for i in range(n)]
    events = spark.createDataFrame([(i, 64, "view" if i % 2 else "click", v / 100, f'{{"k": {k}}}') for i, v, k in places], "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.expr("timestamp_ntz'2024-01-03 04:05:06'")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows, most = most_rows(spark, catalog.QUERIES["mutual_nearest"](spark, str(tmp_path)))
    assert most <= 3 * n
    sides = [[(i, v / 100 % 105 - 52.5, (k - 50) * 68) for i, v, k in places if i % 2 == s] for s in (1, 0)]
    assert sorted((r["a_id"], r["b_id"]) for r in rows) == [p[:2] for p in nearest_of_all_pairs(*sides, 20, 100)]


def test_crowds_by_trees_and_blocks(spark, monkeypatch):
    """Lattices with many ties and equal places, whole and in blocks, with trees and without: the pairs of ``tables.mutual_nearest``."""
    draw = random.Random(9)
    side = lambda s, sizes: [(g, f"{s}{i:03}", float(draw.randrange(30)), draw.randrange(30) * 0.68) for g, n in sizes.items() for i in draw.sample(range(900), n)]
    made = lambda rows: spark.createDataFrame([*rows, (None, "z", 0.0, 0.0), ("a", "y", None, 0.0), ("a", "x", math.nan, 0.0), ("a", "w", math.inf, 0.0)], "g string, id string, x double, y double").withColumn("y", F.round("y", 2).cast("decimal(10,2)"))
    a, b = made(side("p", {"a": 200, "b": 3, "c": 40, "e": 90})), made(side("q", {"a": 170, "b": 4, "d": 60, "e": 2}))
    want = values(tables.mutual_nearest(a, b, ["g"], 8.0), "g", "a_id", "b_id", "d")
    assert {g for g, *_ in want} == {"a", "b", "e"}
    for few, block in ((crowds.FEW, 1000), (0, 1000), (0, 30), (crowds.FEW, 1)):
        monkeypatch.setattr(crowds, "FEW", few)
        assert values(crowds.mutual_nearest(a, b, ["g"], 8.0, block), "g", "a_id", "b_id", "d") == want, (few, block)
    spots = lambda n: [(draw.randrange(n), draw.random(), draw.random()) for _ in range(300)]
    p, q = spots(120), spots(90)  # ids that stand at several places
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "g int, id long, x double, y double")
    for block in (1000, 70):
        assert values(crowds.mutual_nearest(frame(p), frame(q), ["g"], 0.05, block), "a_id", "b_id", "d") == sorted(nearest_of_all_pairs(p, q, 0.05), key=str)
