"""Nested folds: nothing is scored by a model that saw it; states by context; kept fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark.operators import crossval, metrics, models
from gridmark.operators.crossval import FINAL


@pytest.fixture(scope="module")
def world(spark):
    """15 matches of 60 rows: the label follows the distance, with some noise; 5 folds."""
    r = np.random.default_rng(3)
    rows = []
    for m in range(15):
        for i in range(60):
            d = float(r.uniform(1, 60))
            rows.append((m, 1, i, i * 1_000_000, "home", False, d, None if i % 20 == 7 else float(r.normal()), int(d / 10), int(r.random() < 1 / (1 + np.exp((d - 25) / 6)))))
    data = spark.createDataFrame(rows, "match_id long, period int, k long, ts_us long, team string, dead boolean, dist double, other double, band int, y int")
    matches = spark.createDataFrame([(m, "a", 10 + m, m % 5) for m in range(15)], "match_id long, source string, size long, fold int")
    return data, matches


class Spy:
    """Scores a row 1 if any training row of its context is of its match, else 0, and keeps who trained."""

    def fit(self, train, keys):
        return train.groupBy(*keys).agg(F.collect_set("match_id").alias("saw"))

    def score(self, model, rows, keys, into="p"):
        return rows.join(model, keys).withColumn(into, F.array_contains("saw", F.col("match_id")).cast("double")).withColumn("n_saw", F.size("saw")).drop("saw")


def test_every_score_is_out_of_fold(spark, world):
    data, matches = world
    n = crossval.nested_scores(data, matches, Spy(), "match_id", every=4)
    fold = {r["match_id"]: r["fold"] for r in matches.collect()}
    outer, inner = n.outer.collect(), n.inner.collect()
    assert len(outer) == 900 and {r["p"] for r in outer + inner} == {0.0}
    assert all(fold[r["match_id"]] == r["outer"] for r in outer) and all(fold[r["match_id"]] != r["outer"] for r in inner)
    assert {r["outer"] for r in inner} == {0, 1, 2, 3, 4, FINAL} and {r["outer"] for r in outer} == {0, 1, 2, 3, 4}
    assert {r["n_saw"] for r in outer} == {12} and {r["n_saw"] for r in inner if r["outer"] != FINAL} == {9} and {r["n_saw"] for r in inner if r["outer"] == FINAL} == {11}
    assert n.plan.groupBy("outer", "part").count().count() == 11  # five inner and outer fits, and the final inner one
    assert crossval.leaks(n.plan, matches, "match_id").isEmpty()
    bad = n.plan.unionByName(spark.createDataFrame([(0, "outer", 0, "train")], n.plan.schema)).unionByName(spark.createDataFrame([(1, "outer", 0, "score")], n.plan.schema))
    assert {r["why"] for r in crossval.leaks(bad, matches, "match_id").collect()} == {"trains and is scored", "trains in its own fold", "scored outside its fold"}
    again = crossval.refit_scores(data, matches, Spy(), "match_id")
    assert again.count() == 900 and again.agg(F.max("p")).first()[0] == 0 and again.agg(F.min("n_saw")).first()[0] == 12


def test_worse_test_rows_reach_only_tested_matches(spark, world):
    data, matches = world
    learner = crossval.Rates(("band",), "y")
    worse = data.withColumn("band", F.lit(0))
    clean, arm = crossval.nested_scores(data, matches, learner, "match_id"), crossval.nested_scores(data, matches, learner, "match_id", test_rows=worse, test_keys=["match_id", "period", "k"])
    on = ["outer", "match_id", "k"]
    assert crossval.reproduction(arm.inner, clean.inner, on).first()["n_differ"] == 0
    assert arm.outer.groupBy("outer").agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0] == 1
    assert tuple(crossval.reproduction(clean.outer.where("k > 0"), clean.outer.where("k < 59"), on).first())[:4] == (58 * 15, 15, 15, 0)
    with pytest.raises(ValueError, match="test rows differ"):
        crossval.nested_scores(data, matches, learner, "match_id", test_rows=worse.where("k < 50"), test_keys=["match_id", "period", "k"])


def newton(x, y, l2):
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    t, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [l2 * len(x)] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ t))
        t = t + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ t)
    return t, x.mean(0), x.std(0)


def test_logistic_of_all_contexts_at_once(spark, world):
    data, matches = world
    learner = crossval.Logistic(("dist", "other"), "y")
    n = crossval.nested_scores(data, matches, learner, "match_id")
    got, pdf, plan = n.outer.toPandas(), data.toPandas(), n.plan.where("part = 'outer' AND use = 'train'").toPandas()
    for outer in range(5):
        train = pdf[pdf["match_id"].isin(plan[plan["outer"] == outer]["match_id"])]
        known = train.dropna()
        t, mean, std = newton(known[["dist", "other"]].to_numpy(), known["y"].to_numpy(float), 1e-6)
        mine = got[got["outer"] == outer]
        want = 1 / (1 + np.exp(-(t[0] + ((mine[["dist", "other"]].to_numpy(float) - mean) / std) @ t[1:])))
        want = np.where(np.isnan(want), train["y"].mean(), want)
        assert np.abs(mine["p"].to_numpy() - want).max() < 1e-7
        assert t[1] < 0 and mine[mine["y"] == 1]["p"].mean() > mine[mine["y"] == 0]["p"].mean()
    one = data.where("match_id = 0").select(F.lit(1).alias("c"), "dist", F.lit(0).alias("y"))  # one class only, and a feature without spread
    assert crossval.Logistic(("dist",), "y").fit(one.withColumn("dist", F.lit(2.0)), ["c"]).first()["_base"] == 0


def test_taus_come_from_inner_matches(spark, world):
    data, matches = world
    shots = data.where("k % 15 = 14").select("match_id", "period", "team", F.col("k").alias("shot_id"), (F.col("ts_us") + 500_000).alias("ts_us"))
    n = crossval.nested_scores(data, matches, crossval.Rates(("band",), "y"), "match_id", every=4)
    keys = ["match_id", "period"]
    args = (n, shots, "match_id", keys, ["k"], 1_000_000, 10_000_000)
    sweep = crossval.tau_sweep(*args, taus=[0.2, 0.5, 0.8]).toPandas()
    assert len(sweep) == 18 and set(sweep["outer"]) == {0, 1, 2, 3, 4, FINAL}
    chosen = crossval.fold_taus(n, shots, 4, *args[2:], taus=[0.2, 0.5, 0.8]).toPandas()
    for r in chosen.itertuples():
        own = sweep[sweep["outer"] == r.outer]
        inside = own[own["false_per_match"] <= 4]
        best = inside.sort_values(["miss_rate", "tau"], ascending=[True, False]) if len(inside) else own.sort_values(["false_per_match", "tau"], ascending=[True, False])
        assert r.tau == best.iloc[0]["tau"] and r.over_budget == (not len(inside))
    alarms = crossval.outer_alarms(n, spark.createDataFrame(chosen), keys, ["k"]).toPandas()
    fold, tau = dict(matches.select("match_id", "fold").collect()), dict(zip(chosen["outer"], chosen["tau"], strict=True))
    assert len(alarms) and all(fold[a.match_id] == a.outer and a.tau == tau[a.outer] for a in alarms.itertuples())
    found = crossval.tau_candidates(n.inner).toPandas()
    p = n.inner.where("outer = 2").select("p").toPandas()["p"]
    want = np.unique(np.quantile(p, 1 - np.geomspace(0.3, 1e-4, 60)))
    assert np.allclose(sorted(found[found["outer"] == 2]["tau"]), want)


def test_context_states(spark, world, tmp_path):
    data, matches = world
    plan = crossval.pair_plan(matches)
    assert plan.count() == 25 and plan.select("training").distinct().count() == 15
    scored = crossval.context_scores(data, matches, Spy(), "match_id").collect()
    fold = dict(matches.select("match_id", "fold").collect())
    assert len(scored) == 5 * 900 and {r["p"] for r in scored} == {0.0}
    assert all(r["n_saw"] == (12 if r["outer"] == fold[r["match_id"]] else 9) for r in scored)
    learner, path, keys = crossval.Rates(("band",), "y"), f"{tmp_path}/states", ["match_id", "period"]
    args = (learner, "match_id", keys, "k", path)
    first = crossval.learned_states(data, matches, *args)
    assert first.count() == 4500 and crossval.learned_states(data, matches, *args).exceptAll(first).isEmpty()
    with pytest.raises(ValueError, match="made of other rows"):
        crossval.learned_states(data.withColumn("y", F.when((F.col("match_id") == 3) & (F.col("k") == 5), 1 - F.col("y")).otherwise(F.col("y"))), matches, *args)
    grid = data.select("match_id", "period", "k", F.lit("away").alias("possession_team"), "y", "band")
    rows = crossval.context_rows(grid, first, keys, "k", lambda team: team == "away")
    assert rows.count() == 4500 and rows.where("flipped <> (possession_team = 'away')").isEmpty()
    nested = crossval.nested_scores(rows, matches, Spy(), "match_id")  # each context reads its own rows alone
    assert nested.outer.count() == 900 and nested.outer.agg(F.max("p")).first()[0] == 0
    with pytest.raises(ValueError, match="states and grid differ"):
        crossval.context_rows(grid.where("k < 59"), first, keys, "k", lambda team: team == "away")


def test_fits_are_kept(spark, world, tmp_path):
    data, _ = world
    fit = lambda df, **more: crossval.fitted(df, f"{tmp_path}/fits", "outer_0", ["dist", "other"], "y", "match_id", rounds=6, depth=2, rate=0.3, **more)
    first = fit(data)
    assert not first.reused and 1 <= first.best_round <= 6 and first.model.stages[-1].getNumTrees == first.best_round and first.n_rows == 900
    again = fit(data.repartition(5))
    assert again.reused and again.digest == first.digest and again.best_round == first.best_round
    p = [models.boosted_scores(m.model, data, ["dist", "other"]).select("match_id", "k", "p") for m in (first, again)]
    assert p[0].exceptAll(p[1]).isEmpty()
    changed = fit(data.withColumn("y", F.when((F.col("match_id") == 3) & (F.col("k") == 5), 1 - F.col("y")).otherwise(F.col("y"))))
    assert not changed.reused and changed.digest != first.digest
    alone = fit(data.where("match_id = 1"))
    assert not alone.reused and alone.best_round == 6


def test_choose_tau_without_groups(spark):
    s = spark.createDataFrame([(0.1, 0.2, 5.0), (0.2, 0.3, 2.0), (0.3, 0.3, 1.0)], "tau double, miss_rate double, false_per_match double")
    assert tuple(metrics.choose_tau(s, 3).first()) == (0.3, 0.3, 1.0, False)
    assert tuple(metrics.choose_tau(s, 0.5).first()) == (0.3, 0.3, 1.0, True)
