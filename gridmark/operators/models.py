"""Models on feature tables, cross-validated by match: Spark ML fits, every fold a filter on the fold column."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions.scalars import logit, sigmoid


def _probability(model: PipelineModel, df: DataFrame, into: str) -> DataFrame:
    out = model.transform(df).withColumn(into, vector_to_array("probability")[1])
    return out.select(*df.columns, into)


def logistic(df: DataFrame, features: list[str], label: str, l2: float = 1e-6) -> PipelineModel:
    """Standardised logistic regression."""
    steps = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", labelCol="_y", regParam=l2)]
    return Pipeline(stages=steps).fit(df.withColumn("_y", F.col(label).cast("double")))


def floor_scores(train: DataFrame, rows: DataFrame, features: list[str], label: str, predictable: Column, into: str = "p") -> DataFrame:
    """The floor model: logistic on a few features, the base rate where one is missing, null where a row isn't predictable."""
    model = logistic(train.dropna(subset=features), features, label)
    base = train.agg(F.avg(F.col(label).cast("double")).alias("_base"))
    known = rows.dropna(subset=features)
    scored = _probability(model, known, into)
    bare = rows.where(" OR ".join(f"`{f}` IS NULL" for f in features)).crossJoin(F.broadcast(base)).withColumn(into, F.col("_base")).drop("_base")
    return scored.unionByName(bare).withColumn(into, F.when(F.coalesce(predictable, F.lit(False)), F.col(into)))


def boosted(df: DataFrame, features: list[str], label: str, validation: str | None = None, rounds: int = 50, depth: int = 5, rate: float = 0.05) -> PipelineModel:
    """Boosted trees; a missing feature is its median and an indicator.  ``validation``: the column of rows held out for early stopping."""
    flagged = [f"_{f}_missing" for f in features]
    steps = [Imputer(inputCols=features, outputCols=[f"_{f}" for f in features], strategy="median"), VectorAssembler(inputCols=[f"_{f}" for f in features] + flagged, outputCol="_vector"), GBTClassifier(featuresCol="_vector", labelCol="_y", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=1)]
    if validation:
        steps[-1].setValidationIndicatorCol(validation)
    return Pipeline(stages=steps).fit(with_missing_flags(df, features).withColumn("_y", F.col(label).cast("double")))


def with_missing_flags(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features}).withColumns({f"_{f}_missing": F.col(f).isNull().cast("double") for f in features})


def boosted_scores(model: PipelineModel, df: DataFrame, features: list[str], into: str = "p") -> DataFrame:
    return _probability(model, with_missing_flags(df, features), into).drop(*[f"_{f}_missing" for f in features])


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], into: str = "p", l2: float = 1e-6) -> DataFrame:
    """Every row scored by a model that never saw its fold."""
    parts = None
    for f in folds:
        model = logistic(df.where(F.col(fold) != f).dropna(subset=features), features, label, l2)
        own = _probability(model, df.where(F.col(fold) == f).dropna(subset=features), into)
        parts = own if parts is None else parts.unionByName(own)
    return parts


def plan(folds: list[int]) -> list[tuple[int, int | None]]:
    """The distinct trainings (outer, inner) of nested folds: leaving out a pair is one training whichever is outer."""
    return [(f, None) for f in folds] + [(a, b) for a in folds for b in folds if a < b]


def leaks(train: DataFrame, validation: DataFrame, match: str) -> DataFrame:
    """Matches in both sets; must be empty."""
    return train.select(match).intersect(validation.select(match))


def recalibration(df: DataFrame, p: str, label: str) -> tuple[float, float]:
    """(a, b) of sigmoid(a + b logit p), fitted on all rows; a map that turns scores around is an error."""
    rows = df.select(logit(F.col(p)).alias("z"), F.col(label).cast("double").alias("y")).where("z IS NOT NULL AND y IS NOT NULL")
    model = LogisticRegression(featuresCol="_v", labelCol="y", regParam=0.0).fit(VectorAssembler(inputCols=["z"], outputCol="_v").transform(rows))
    if model.coefficients[0] <= 0:
        raise ValueError("the map would turn the order of scores around")
    return float(model.intercept), float(model.coefficients[0])


def recalibrated(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) + F.lit(b) * logit(p))


def symmetrised(scored: DataFrame, mirrored: DataFrame, on: list[str], p: str) -> DataFrame:
    """(q(x) + 1 - q(mirror x)) / 2 on joined keys."""
    m = mirrored.select(*on, F.col(p).alias("_m"))
    return scored.join(m, on).withColumn(p, (F.col(p) + 1 - F.col("_m")) / 2).drop("_m")


def gain_by_group(importances: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, share): feature importances (feature, gain) summed by group, as shares."""
    by = importances.join(groups, "feature").groupBy("group").agg(F.sum("gain").alias("gain"))
    total = by.agg(F.sum("gain").alias("_all"))
    return by.crossJoin(F.broadcast(total)).select("group", (F.col("gain") / F.col("_all")).alias("share"))  # one row of the total


def two_clusters(df: DataFrame, features: list[str], seeds: int = 10) -> DataFrame:
    """``df`` with ``cluster`` of the best of several two-means runs."""
    ready = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(df)
    fits = [KMeans(featuresCol="_v", predictionCol="cluster", k=2, seed=s).fit(ready) for s in range(seeds)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(ready).drop("_v")
