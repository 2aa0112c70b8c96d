"""Writes and reads of derived tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark import schema
from gridmark.operators import validate

PREDICTION_KEYS = ["match_id", "period", "t_s"]


def write_matches(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Writes the tables of matches, one folder for each match inside a table (matches written again are replaced), and returns their violated rules."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(f"{root}/{name}")
    return validate.validated({n: read_matches(df.sparkSession, root, n) for n, df in tables.items()})


def read_matches(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table with its declared schema; filters on match_id prune folders, others reach the Parquet scan."""
    s = schema.struct(table)
    return spark.read.schema(s).parquet(f"{root}/{table}").select(*s.fieldNames())


def write_derived(df: DataFrame, root: str, kind: str, version: str, config_key: str) -> str:
    """A derived table under its kind and version; a configuration's rows replace its earlier ones only."""
    path = f"{root}/{kind}_{version}"
    df.withColumn("config_key", F.lit(config_key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_key", "match_id").parquet(path)
    return path


def prediction_errors(predictions: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """(rule, n_bad): values outside 0 to 1 or NaN, repeated keys, keys that the grid lacks."""
    scores = [c for c in predictions.columns if c.startswith("p_")]
    if missing := [c for c in PREDICTION_KEYS if c not in predictions.columns]:
        raise ValueError(f"predictions lack {missing}")
    bad = predictions.agg(*[F.count_if(F.isnan(c) | ~F.col(c).between(0, 1)).alias(c) for c in scores]).select(F.explode(F.array(*[F.struct(F.lit(f"{c} outside 0 to 1").alias("rule"), F.col(c).alias("n_bad")) for c in scores])).alias("r")).select("r.*")
    key = ["match_id", "period", F.round(F.col("t_s") * 10).cast("long").alias("k")]
    twice = predictions.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n_bad")).select(F.lit("repeated key").alias("rule"), "n_bad")
    out = bad.unionByName(twice)
    if grid is not None:
        stray = predictions.select(*key).join(grid.select(*key), ["match_id", "period", "k"], "left_anti").agg(F.count("*").alias("n_bad")).select(F.lit("key not on the grid").alias("rule"), "n_bad")
        out = out.unionByName(stray)
    return out.where("n_bad > 0")


def save_run(predictions: DataFrame, path: str, meta: dict | None = None) -> None:
    """A run: its predictions, refused with errors, and what is known about it (``model`` and ``horizons`` at least), written last; a run without it is unfinished."""
    known = {"model": None, "horizons": [c.removeprefix("p_") for c in predictions.columns if c.startswith("p_")]} if meta is None else meta
    if missing := [k for k in ("model", "horizons") if k not in known]:
        raise ValueError(f"meta needs {missing}")
    if lacking := [h for h in known["horizons"] if f"p_{h}" not in predictions.columns]:
        raise ValueError(f"predictions lack p_ columns of {lacking}")
    rows = predictions.select(*[c for c in predictions.columns if not c.startswith("p_") or c.removeprefix("p_") in known["horizons"]])
    if errors := [f"{r['rule']}: {r['n_bad']}" for r in prediction_errors(rows).collect()]:
        raise ValueError("; ".join(errors))
    rows.write.mode("overwrite").partitionBy("match_id").parquet(f"{path}/predictions")
    spark = predictions.sparkSession
    stamped = {**known, "run_id": path.rstrip("/").split("/")[-1], "created": spark.range(1).select(F.current_timestamp().cast("string").alias("t")).first()["t"]}
    spark.createDataFrame([(json.dumps(stamped),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")


def load_run(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(meta, predictions) of a saved run, checked again."""
    meta = json.loads(spark.read.text(f"{path}/run").first()["value"])
    predictions = spark.read.parquet(f"{path}/predictions")
    if lacking := [h for h in meta["horizons"] if f"p_{h}" not in predictions.columns]:
        raise ValueError(f"{path}: predictions lack p_ columns of {lacking}")
    if errors := [f"{r['rule']}: {r['n_bad']}" for r in prediction_errors(predictions).collect()]:
        raise ValueError(f"{path}: " + "; ".join(errors))
    return meta, predictions


def every_nth(df: DataFrame, tick: str, n: int, path: str) -> None:
    """A thinned CSV export: the rows whose tick is a multiple of n."""
    df.where(F.col(tick) % n == 0).write.mode("overwrite").option("header", True).csv(path)
