"""Nested cross-validation by match, states scored per context, and a fit driver that refits only what changed.

A *context* is what a model may not have seen: an outer fold, or none (``FINAL``).  Learners (``Rates``, ``Logistic``, ``Boosted``) fit all contexts at once where they
can: training rows carry the context as a further key, so a fit is one aggregation by context, or one for each Newton step, instead of a job series for each fold.
Tau is chosen on inner matches only, for all contexts in one sweep, and joined back to the outer predictions by fold.

Rows are copied to each context that may train on them (about 8 copies for 5 folds), narrow and map-side: the plan table that copies them has one row for each match and
context, and is broadcast if its counted rows allow it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any, NamedTuple, Protocol

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.functions.scalars import sigmoid
from gridmark.operators import metrics, models, possession, sequential, validate
from gridmark.session import hinted, staged

#: The context without an outer fold, whose inner matches set the final tau.
FINAL = -1
MOST_PLAN_ROWS = 1_000_000


class Learner(Protocol):
    def fit(self, train: DataFrame, keys: list[str]) -> Any:
        """A model for each value of ``keys``."""

    def score(self, model: Any, rows: DataFrame, keys: list[str], into: str = "p") -> DataFrame:
        """``rows`` with the score of the model of their ``keys``."""


@dataclass(frozen=True)
class Rates:
    """The share of positives in each cell of ``by``, drawn to the context's base rate by ``weight`` rows; a cell that training lacks has the base rate."""

    by: tuple[str, ...]
    label: str
    weight: float = 20.0

    def fit(self, train: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        y = F.col(self.label).cast("double")
        known = train.where(F.col(self.label).isNotNull())
        cells = known.groupBy(*keys, *self.by).agg(F.sum(y).alias("_pos"), F.count("*").alias("_n"))
        cells = staged(cells, "cells")
        base = cells.groupBy(*keys).agg((F.sum("_pos") / F.sum("_n")).alias("_base"))
        rate = (F.col("_pos") + self.weight * F.col("_base")) / (F.col("_n") + self.weight)
        return cells.join(base, keys).select(*keys, *self.by, rate.alias("_rate")), base

    def score(self, model: tuple[DataFrame, DataFrame], rows: DataFrame, keys: list[str], into: str = "p") -> DataFrame:
        cells, base = (hinted(t, MOST_PLAN_ROWS) for t in model)
        return rows.join(cells, [*keys, *self.by], "left").join(base, keys, "left").withColumn(into, F.coalesce("_rate", "_base")).drop("_rate", "_base")


@dataclass(frozen=True)
class Logistic:
    """Standardised logistic regression of a few features, the Newton steps of all contexts in one aggregation each; a row that lacks a feature has the base rate."""

    features: tuple[str, ...]
    label: str
    l2: float = 1e-6
    most_steps: int = 30

    def _known(self, rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=[*self.features, self.label])

    def fit(self, train: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, _mean, _scale, _theta, _base): intercept first; ``_base`` counts rows that lack a feature as well."""
        d = len(self.features)
        rows = staged(train.where(F.col(self.label).isNotNull()).select(*keys, *[F.col(f).cast("double").alias(f) for f in self.features], F.col(self.label).cast("double").alias(self.label)), "training")
        known = self._known(rows)
        moments = known.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(self.features)], *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(self.features)])
        bases = {tuple(r[k] for k in keys): r["b"] for r in rows.groupBy(*keys).agg(F.avg(self.label).alias("b")).collect()}  # a row for each context, as are all collects here
        at = {tuple(r[k] for k in keys): ([r[f"m_{i}"] for i in range(d)], [r[f"s_{i}"] or 1.0 for i in range(d)], r["n"]) for r in moments.collect()}
        theta = {k: np.zeros(d + 1) for k in at}
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.select(*keys).schema) + ", _mean array<double>, _scale array<double>, _theta array<double>, _base double"

        def table() -> DataFrame:
            found = [(*k, *(list(v) for v in at[k][:2]), theta[k].tolist(), bases[k]) for k in at] + [(*k, None, None, None, b) for k, b in bases.items() if k not in at]
            return train.sparkSession.createDataFrame(found, schema)

        z = [F.lit(1.0), *[(F.col(f) - F.get("_mean", F.lit(i))) / F.get("_scale", F.lit(i)) for i, f in enumerate(self.features)]]
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        for _ in range(self.most_steps):
            now = known.join(F.broadcast(table()), keys)  # as many rows as contexts
            p = sigmoid(sum((F.get("_theta", F.lit(i)) * z[i] for i in range(1, d + 1)), F.get("_theta", F.lit(0))))
            now = now.select(*keys, F.col(self.label).alias("y"), p.alias("p"), *[c.alias(f"z_{i}") for i, c in enumerate(z)])
            g = [F.sum((F.col("y") - F.col("p")) * F.col(f"z_{i}")).alias(f"g_{i}") for i in range(d + 1)]
            h = [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"h_{i}_{j}") for i, j in pairs]
            moved = 0.0
            for r in now.groupBy(*keys).agg(*g, *h).collect():
                k = tuple(r[c] for c in keys)
                ridge = np.diag([0.0] + [self.l2 * at[k][2]] * d)
                hessian = ridge + 1e-12 * np.eye(d + 1)
                for i, j in pairs:
                    hessian[i, j] += r[f"h_{i}_{j}"]
                    hessian[j, i] = hessian[i, j]
                step = np.linalg.solve(hessian, np.array([r[f"g_{i}"] for i in range(d + 1)]) - ridge @ theta[k])
                step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # far from the optimum a full step may overshoot
                theta[k] = theta[k] + step
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-9:
                break
        return table()

    def score(self, model: DataFrame, rows: DataFrame, keys: list[str], into: str = "p") -> DataFrame:
        z = sum((F.get("_theta", F.lit(i + 1)) * (F.col(f) - F.get("_mean", F.lit(i))) / F.get("_scale", F.lit(i)) for i, f in enumerate(self.features)), F.get("_theta", F.lit(0)))
        return rows.join(F.broadcast(model), keys, "left").withColumn(into, F.coalesce(sigmoid(z), F.col("_base"))).drop("_mean", "_scale", "_theta", "_base")


@dataclass(frozen=True)
class Boosted:
    """Boosted trees by ``fitted``, one fit for each context; ``store`` keeps them, so a context whose rows are unchanged isn't fitted again."""

    features: tuple[str, ...]
    label: str
    match: str
    store: str
    rounds: int = 50
    depth: int = 5
    rate: float = 0.05

    def fit(self, train: DataFrame, keys: list[str]) -> list[tuple[Column, Fitted]]:
        out = []
        for r in train.select(*keys).distinct().orderBy(*keys).collect():
            here = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys])
            name = "-".join(str(r[k]) for k in keys)
            out.append((here, fitted(train.where(here), self.store, name, list(self.features), self.label, self.match, rounds=self.rounds, depth=self.depth, rate=self.rate)))
        return out

    def score(self, model: list[tuple[Column, Fitted]], rows: DataFrame, keys: list[str], into: str = "p") -> DataFrame:
        return reduce(DataFrame.unionByName, [models.boosted_scores(m.model, rows.where(here), list(self.features), into) for here, m in model])


# Plans: which match does what in which context.


def roles(matches: DataFrame, match: str, *, every: int = 7, seed: str = "inner") -> DataFrame:
    """(outer, match, role) of ``matches`` (match, source, size, fold): a match is ``test`` in the context of its own fold; of each block of ``every`` other matches
    of a source that are alike in size, a hash picks one as ``inner``; the rest is ``fit``.  In ``FINAL`` nothing is tested."""
    folds = sorted(r["fold"] for r in matches.select("fold").distinct().collect())
    each = matches.withColumn("outer", F.explode(F.array(*[F.lit(f) for f in [*folds, FINAL]])))
    train = each.where("fold <> outer")
    by_size = Window.partitionBy("outer", "source").orderBy(F.col("size").desc(), match)
    block = train.withColumn("_block", F.floor((F.row_number().over(by_size) - 1) / every))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col("outer").cast("string"), F.col(match).cast("string")))
    first = F.row_number().over(Window.partitionBy("outer", "source", "_block").orderBy(mixed, match)) == 1
    inner = block.select("outer", match, F.when(first, "inner").otherwise("fit").alias("role"))
    return inner.unionByName(each.where("fold = outer").select("outer", match, F.lit("test").alias("role")))


def fit_plan(role: DataFrame, match: str) -> DataFrame:
    """(outer, part, match, use) of ``roles``: part ``inner`` trains on fit and scores inner matches, part ``outer`` trains on both and scores the tested ones."""
    inner = role.where("role <> 'test'").select("outer", F.lit("inner").alias("part"), match, F.when(F.col("role") == "fit", "train").otherwise("score").alias("use"))
    outer = role.where(F.col("outer") != FINAL).select("outer", F.lit("outer").alias("part"), match, F.when(F.col("role") == "test", "score").otherwise("train").alias("use"))
    return inner.unionByName(outer)


def leaks(plan: DataFrame, matches: DataFrame, match: str) -> DataFrame:
    """(outer, part, match, why): matches that train and are scored in one part, matches of the outer fold that train in it, and ones scored outside their fold.  Must be empty."""
    both = plan.groupBy("outer", "part", match).agg(F.countDistinct("use").alias("n")).where("n > 1").select("outer", "part", match, F.lit("trains and is scored").alias("why"))
    of = plan.join(matches.select(match, "fold"), match)
    own = of.where("use = 'train' AND fold = outer").select("outer", "part", match, F.lit("trains in its own fold").alias("why"))
    other = of.where("part = 'outer' AND use = 'score' AND fold <> outer").select("outer", "part", match, F.lit("scored outside its fold").alias("why"))
    return both.unionByName(own).unionByName(other)


def _copied(rows: DataFrame, plan: DataFrame, match: str, use: str) -> DataFrame:
    """The rows once for each (outer, part) in which their match has this use; rows that carry a context go to that one only."""
    on = [match, "outer"] if "outer" in rows.columns else [match]
    return rows.join(hinted(plan.where(F.col("use") == use).drop("use"), MOST_PLAN_ROWS), on)


class Nested(NamedTuple):
    plan: DataFrame
    inner: DataFrame
    outer: DataFrame
    model: Any


def nested_scores(rows: DataFrame, matches: DataFrame, learner: Learner, match: str, *, test_rows: DataFrame | None = None, test_keys: list[str] | None = None, every: int = 7, seed: str = "inner") -> Nested:
    """Scores of inner matches (for tau) and of tested ones, each by a model that never saw them: ``rows`` with outer, part and p.

    ``test_rows``: a copy of ``rows``, worse for instance, that only the tested matches read; its ``test_keys`` must be those of ``rows``.  ``rows`` with a column
    ``outer`` are a table for each context (``context_rows``), and each context reads its own rows alone.
    """
    plan = staged(fit_plan(roles(matches, match, every=every, seed=seed), match), "plan")
    if bad := leaks(plan, matches, match).head(3):
        raise ValueError(f"folds don't nest: {bad}")
    if test_rows is not None and (odd := validate.equal_keys(rows, test_rows, test_keys or [match]).head(3)):
        raise ValueError(f"test rows differ from the rows: {odd}")
    keys = ["outer", "part"]
    model = learner.fit(_copied(rows, plan, match, "train"), keys)
    inner = learner.score(model, _copied(rows, plan.where("part = 'inner'"), match, "score"), keys)
    outer = learner.score(model, _copied(rows if test_rows is None else test_rows, plan.where("part = 'outer'"), match, "score"), keys)
    return Nested(plan, inner, outer, model)


def refit_scores(rows: DataFrame, matches: DataFrame, learner: Learner, match: str) -> DataFrame:
    """Each match scored by a model fitted on all folds but its own, without inner matches."""
    folds = matches.select(F.col(match), "fold")
    out = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    each = folds.withColumn("outer", F.explode(F.array(*map(F.lit, out))))
    plan = each.select("outer", match, F.when(F.col("fold") == F.col("outer"), "score").otherwise("train").alias("use"))
    model = learner.fit(_copied(rows, plan, match, "train"), ["outer"])
    return learner.score(model, _copied(rows, plan, match, "score"), ["outer"])


def reproduction(again: DataFrame, base: DataFrame, on: list[str], p: str = "p") -> DataFrame:
    """(n, n_only_again, n_only_base, n_differ, max_diff) of two runs' scores over all their keys; ``n_differ`` counts nulls on one side only as well."""
    a, b = again.select(*on, F.col(p).alias("_a"), F.lit(True).alias("_in_a")), base.select(*on, F.col(p).alias("_b"), F.lit(True).alias("_in_b"))
    both = F.col("_in_a") & F.col("_in_b")
    return a.join(b, on, "full").agg(
        F.count_if(both).alias("n"), F.count_if(F.col("_in_b").isNull()).alias("n_only_again"), F.count_if(F.col("_in_a").isNull()).alias("n_only_base"),
        F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_differ"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"),
    )


# Tau: chosen on inner scores, used on outer ones.


def tau_candidates(inner: DataFrame, n: int = 60, top: float = 0.3, last: float = 1e-4) -> DataFrame:
    """(outer, tau): high quantiles of each context's inner scores, from its ``top`` share down to its ``last`` one in a geometric row."""
    shares = [1 - top * (last / top) ** (i / (n - 1)) for i in range(n)]
    return inner.where("p IS NOT NULL").groupBy("outer").agg(F.percentile("p", shares).alias("q")).select("outer", F.explode(F.array_distinct("q")).alias("tau"))


def tau_sweep(nested: Nested, shots: DataFrame, match: str, keys: list[str], tie: list[str], grace: int, width: int, taus: list[float] | None = None, **hysteresis: Any) -> DataFrame:
    """(outer, tau, shots, missed, ..., false_per_match) of the inner matches of all contexts in one job.

    The inner scores are series (ts_us, p, team, dead); ``shots``: (keys, team, shot_id, ts_us).  ``taus``: None for ``tau_candidates``.
    """
    inner = nested.inner
    cands = staged(tau_candidates(inner), "taus") if taus is None else sequential.swept(inner.select("outer").distinct(), "tau", taus)
    cands = hinted(cands, MOST_PLAN_ROWS)
    alarms = possession.alarms(inner.join(cands, "outer"), ["outer", "tau", *keys], tie, F.col("tau"), **hysteresis)
    alarms = alarms.withColumn("alarm_id", F.concat_ws("-", *keys, "start_us"))
    held = nested.plan.where("part = 'inner' AND use = 'score'").select("outer", match)
    taken = metrics.score_alarms(shots.join(hinted(held, MOST_PLAN_ROWS), match).join(cands, "outer"), alarms, [*keys, "team"], grace, width, ["outer", "tau"])
    summary = metrics.alarm_summary(taken, alarms, F.lit(1), ["outer", "tau"])
    n = held.groupBy("outer").agg(F.count("*").alias("n_matches"))
    return summary.join(F.broadcast(n), "outer").withColumn("false_per_match", F.col("false_alarms") / F.col("n_matches"))  # a row for each context


def fold_taus(nested: Nested, shots: DataFrame, most_false: float, match: str, keys: list[str], tie: list[str], grace: int, width: int, taus: list[float] | None = None, **hysteresis: Any) -> DataFrame:
    """The chosen row of each context's ``tau_sweep``, with ``over_budget``.  A context whose inner matches have no shots has none."""
    return metrics.choose_tau(tau_sweep(nested, shots, match, keys, tie, grace, width, taus, **hysteresis), most_false, ["outer"])


def outer_alarms(nested: Nested, taus: DataFrame, keys: list[str], tie: list[str], **hysteresis: Any) -> DataFrame:
    """The alarms of the tested matches, each at the tau of its own fold, which its matches had no part in choosing."""
    at = nested.outer.join(F.broadcast(taus.select("outer", "tau")), "outer")  # a row for each context
    return possession.alarms(at, ["outer", "tau", *keys], tie, F.col("tau"), **hysteresis)


# States that a learner scores for each outer context.


def pair_plan(matches: DataFrame) -> DataFrame:
    """(outer, fold, role, training, leaves_a, leaves_b): which training scores the matches of ``fold`` in the context ``outer``.

    In its own context a fold is tested by the training without it; elsewhere by the one without it and the outer fold, which the two contexts of a pair share: of
    n * n such fits n * (n + 1) / 2 are different.
    """
    folds = matches.select("fold").distinct()
    both = folds.select(F.col("fold").alias("outer")).crossJoin(folds)  # a row for each pair of folds
    a, b = F.least("outer", "fold"), F.greatest("outer", "fold")
    test = F.col("outer") == F.col("fold")
    return both.select("outer", "fold", F.when(test, "test").otherwise("inner-oof").alias("role"), F.when(test, F.concat(F.lit("outer_"), a)).otherwise(F.concat(F.lit("pair_"), a, F.lit("_"), b)).alias("training"), a.alias("leaves_a"), b.alias("leaves_b"))


def pair_trainings(rows: DataFrame, matches: DataFrame, match: str) -> DataFrame:
    """``rows`` once for each training of ``pair_plan`` that may see their match."""
    trained = pair_plan(matches).select("training", "leaves_a", "leaves_b").distinct()
    use = matches.select(match, "fold").crossJoin(F.broadcast(trained)).where("fold <> leaves_a AND fold <> leaves_b").select(match, "training")  # few trainings
    return rows.join(hinted(use, MOST_PLAN_ROWS), match)


def context_scores(rows: DataFrame, matches: DataFrame, learner: Learner, match: str) -> DataFrame:
    """``rows`` once for each outer context, with outer, role, training and p: in no context has a match's model seen it or the context's fold."""
    model = learner.fit(pair_trainings(rows, matches, match), ["training"])
    use = matches.select(match, "fold").join(pair_plan(matches).select("outer", "fold", "role", "training"), "fold").drop("fold")
    return learner.score(model, rows.join(hinted(use, MOST_PLAN_ROWS), match), ["training"])


def learned_states(rows: DataFrame, matches: DataFrame, learner: Learner, match: str, keys: list[str], tick: str, path: str, *, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """(outer, keys, tick, possession_team): ``context_scores`` as smoothed teams, one table for all contexts, kept at ``path``.

    The table is written first, the fingerprints of what each training saw and of the rows scored last; a table without them was cut short and is
    built anew.  A table whose fingerprints differ from those of ``rows`` is refused, never rebuilt silently.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != match]
    now = validate.fingerprint(pair_trainings(rows, matches, match), ["training"], [match, *columns])
    now = now.unionByName(validate.fingerprint(rows.withColumn("training", F.lit("scored")), ["training"], [match, *columns]))
    try:
        sealed = spark.read.parquet(f"{path}/sealed")
    except AnalysisException:
        scored = context_scores(rows, matches, learner, match)
        state = possession.team_hysteresis(scored, ["outer", *keys], tick, "p", high=high, low=low).withColumnRenamed("smoothed", "possession_team")
        state.write.mode("overwrite").partitionBy("outer").parquet(f"{path}/state")
        now.write.mode("overwrite").parquet(f"{path}/sealed")
    else:
        if odd := validate.stale(sealed, now, ["training"]).head(3):
            raise ValueError(f"{path}: made of other rows: {[r['training'] for r in odd]}")
    return spark.read.parquet(f"{path}/state").select("outer", *keys, tick, "possession_team")


def context_rows(grid: DataFrame, states: DataFrame, keys: list[str], tick: str, flipped: Callable[[Column], Column]) -> DataFrame:
    """``grid`` once for each context, with the context's ``possession_team`` and ``flipped`` derived from it; a context that lacks grid rows, or has others, is an error."""
    contexts = states.select("outer").distinct()
    wanted = grid.select(*keys, tick).crossJoin(F.broadcast(contexts))  # a row for each context
    if odd := validate.equal_keys(wanted, states, ["outer", *keys, tick]).head(3):
        raise ValueError(f"states and grid differ: {odd}")
    return grid.drop("possession_team").join(states, [*keys, tick]).withColumn("flipped", flipped(F.col("possession_team")))


# Fits that are kept.


class Fitted(NamedTuple):
    model: PipelineModel
    best_round: int
    n_rows: int
    digest: str
    reused: bool


def fitted(train: DataFrame, store: str, name: str, features: list[str], label: str, match: str, *, rounds: int = 50, depth: int = 5, rate: float = 0.05, every: int = 7, seed: str = "stop") -> Fitted:
    """Boosted trees probed, then refitted on all of ``train`` for as many rounds as the probe found best, and kept below ``store``.

    The probe trains on most matches and stops on held-out ones: of each ``every`` matches by hash order one.  A model is kept under the fingerprint of its rows and
    parameters, and its record is written last; a further call on the same rows loads it and fits nothing, and any changed row, match or parameter is another fit.
    With fewer than two matches there is no probe, and all ``rounds`` are kept.
    """
    spark, used = train.sparkSession, [match, *features, label]
    rows = staged(train.where(F.col(label).isNotNull()).select(*used), "fit")
    seen = validate.fingerprint(rows, [], used).first()
    digest = f"{seen['n']}-{seen['digest']}-{spark.range(1).select(F.md5(F.lit(repr((features, label, rounds, depth, rate, every, seed)))).alias('h')).first()['h']}"
    path = f"{store}/{name}/{digest}"
    try:
        record = spark.read.parquet(f"{path}/record").first()
    except AnalysisException:
        pass
    else:
        return Fitted(PipelineModel.load(f"{path}/model"), record["best_round"], record["n_rows"], digest, True)
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col(match).cast("string")))
    each = rows.select(match).distinct().withColumn("_held", F.row_number().over(Window.orderBy(mixed, match)) % every == 0)  # a row for each match
    n = each.count()
    if n >= 2:
        if n < every:
            each = each.withColumn("_held", F.row_number().over(Window.orderBy(mixed, match)) == 1)
        probe = models.boosted(rows.join(hinted(each, MOST_PLAN_ROWS), match), features, label, "_held", rounds, depth, rate)
        rounds = max(1, probe.stages[-1].getNumTrees)
    model = models.boosted(rows, features, label, None, rounds, depth, rate)
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(name, digest, rounds, seen["n"], n)], "name string, digest string, best_round int, n_rows long, n_matches long").write.mode("overwrite").parquet(f"{path}/record")
    return Fitted(model, rounds, seen["n"], digest, False)
