"""Fills possession, carrier and ball state into stored frames of matches, batch or stream: validated before anything is replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmark import schema
from gridmark.operators import possession, validate
from gridmark.session import staged
from gridmark.sources import sinks


def filled_frames(frames: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames with ball_state, possession_team and ball_carrier_id inferred from objects, a report of each match).

    A carrier without a possession, and one whom the frame's objects lack, is dropped and counted.
    """
    place = objects.join(frames.select("match_id", "frame_id", "period"), ["match_id", "frame_id"])
    near = possession.candidates(place, ["match_id", "period"], "frame_id")
    rows = frames.drop("ball_state", "possession_team", "ball_carrier_id").withColumn("ts_us", F.round(F.col("timestamp_s") * 1e6).cast("long")).join(near, ["match_id", "period", "frame_id"], "left")
    state = possession.carried(rows, ["match_id", "period"], ["frame_id"])
    people = objects.where(F.col("object_type").isin("player", "goalkeeper")).select("match_id", "frame_id", F.col("object_id").alias("carrier"), F.lit(True).alias("_there")).distinct()
    state = state.join(people, ["match_id", "frame_id", "carrier"], "left")
    named, teamless = F.col("carrier").isNotNull(), F.col("possession").isNull()
    out = state.select(
        *[F.col("possession").alias(c) if c == "possession_team" else F.when(~teamless & F.col("_there"), F.col("carrier")).alias(c) if c == "ball_carrier_id" else F.col(c) for c in frames.columns], (named & teamless).alias("_teamless"), (named & ~teamless & F.col("_there").isNull()).alias("_gone"),
    )
    share = lambda c: F.avg(c.cast("double"))
    report = out.groupBy("match_id").agg(
        F.count("*").alias("frames"), share(F.col("possession_team").isNotNull()).alias("possession_set_share"), share(F.coalesce(F.col("ball_state") == "alive", F.lit(False))).alias("alive_share"), share(F.coalesce(F.col("ball_state") == "dead", F.lit(False))).alias("dead_share"),
        F.count_if("_teamless").alias("carrier_without_team_dropped"), F.count_if("_gone").alias("carrier_not_in_frame_dropped"),
    )
    return out.select(*frames.columns), report


def fill_matches(matches: DataFrame, root: str) -> DataFrame:
    """Fills the frames of ``matches`` (match_id) below ``root`` (tables as ``sinks.write_matches`` lays them out) and returns the report; each match's frames are replaced as a whole.

    The filled frames are written beside the tables first and validated there with the other tables of their matches; if any rule is violated, or a match has no player with a
    team, nothing is replaced.  Filling again gives the same frames, so a repeated call changes nothing.
    """
    spark = matches.sparkSession
    wanted = staged(matches.select("match_id").distinct(), "wanted")
    own = {t: sinks.read_matches(spark, root, t).join(wanted, "match_id", "left_semi") for t in schema.DDL}
    team = own["objects"].where(F.col("object_type").isin("player", "goalkeeper") & F.col("team").isNotNull()).select("match_id").distinct()
    if bare := [r["match_id"] for r in wanted.join(team, "match_id", "left_anti").limit(5).collect()]:
        raise ValueError(f"no player has a team, so possession would be null everywhere: {bare}")
    frames, report = filled_frames(own["frames"], own["objects"])
    frames, report = staged(frames, "filled"), staged(report, "fill-report")
    wrong = validate.validated({**own, "frames": frames}).limit(5).collect()
    if wrong:
        raise ValueError(f"filled frames break rules, nothing was replaced: {[(r['match_id'], r['table'], r['rule']) for r in wrong]}")
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(f"{root}/frames")
    return report


def fill_batches(root: str, reports: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of arrived matches: fills each micro-batch, and keeps its report under its number, so that a replayed batch replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            report = fill_matches(batch, root).withColumn("batch", F.lit(number))
            report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(reports)

    return run


def latest_reports(reports: DataFrame) -> DataFrame:
    """The last report of each match."""
    w = Window.partitionBy("match_id").orderBy(F.desc("batch"))
    return reports.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
