"""Registered queries: a plan over the given tables and, where SQL can say it, the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions.timing import timestamp_us

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000
KEYS = ["match_id", "period"]

#: The events table as a tracking series: what ``bound`` makes, in SQL.
BOUND = """b AS (SELECT event_id, user_id % 64 AS match_id, 1 + (day(ts) - 1) // 15 AS period, user_id AS object_id,
  CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS team, epoch_us(ts) AS ts_us, event_type, value,
  least(value / 500, 1.0) AS p, (value % 105) - 52.5 AS x, (CAST(json_extract_string(props, '$.k') AS INTEGER) - 50) * 0.68 AS y FROM events)"""


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql.replace("{BOUND}", BOUND).replace("{HOUR}", str(HOUR))
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a series: 64 matches of two periods, a user is an object, its parity the team."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", (F.col("user_id") % 64).alias("match_id"), (1 + F.floor((F.dayofmonth("ts") - 1) / 15)).cast("long").alias("period"), F.col("user_id").alias("object_id"),
        F.when(F.col("user_id") % 2 == 0, "home").otherwise("away").alias("team"), timestamp_us(F.col("ts")).alias("ts_us"), "event_type", "value",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("p"), (F.col("value") % 105 - 52.5).alias("x"), ((k - 50) * 0.68).alias("y"),
    )


def exact(b: DataFrame) -> DataFrame:
    """``b`` with y as the decimal that it is in SQL, so that differences of places are exact where equal distances are told apart."""
    return b.withColumn("y", F.round("y", 2).cast("decimal(10,2)"))
