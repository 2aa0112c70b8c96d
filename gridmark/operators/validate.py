"""Data quality over whole tables of many matches: (match_id, table, rule, n_bad, sample), one row for each violated rule.

The rules of a table's rows are judged in one scan that leaves the broken rows only; rules across tables are anti-joins.  All broken rules of all tables are
counted in one aggregation, so that the shuffle and its buffers grow with what is wrong, not with the tables.  No rule reads a match by itself.
Rules that sort or group a table deal it out by its counted rows (``dealt``): a task holds as many rows of a large table as of a small one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark import schema
from gridmark.session import dealt

MOST_SAMPLES = 5
REPORT = "match_id string, table string, rule string, n_bad long, sample string"


def faults(df: DataFrame, table: str, key: str, bad: dict[str, Column | tuple[Column, Column]], sample: Column | None = None) -> DataFrame:
    """(match_id, table, rule, sample): a row for each rule of ``bad`` that a row of ``df`` breaks.  Rows that break none leave before anything is built for them.

    ``sample``: what to show of such rows; a rule may bring its own, as (condition, sample).
    """
    broken = {name: rule if isinstance(rule, tuple) else (rule, F.lit(None) if sample is None else sample) for name, rule in bad.items()}
    each = [F.when(holds, F.struct(F.lit(name).alias("rule"), shown.cast("string").alias("sample"))) for name, (holds, shown) in broken.items()]
    some = reduce(Column.__or__, [F.coalesce(holds, F.lit(False)) for holds, _ in broken.values()])
    rows = df.where(some).select(F.col(key).cast("string").alias("match_id"), F.explode(F.array_compact(F.array(*each))).alias("f"))
    return rows.select("match_id", F.lit(table).alias("table"), "f.rule", "f.sample")


def counted(found: DataFrame, *more: str) -> DataFrame:
    """The report of the rows of ``faults``: one shuffle by match and rule, combined before it."""
    by = found.groupBy("match_id", "table", "rule", *more).agg(F.count("*").alias("n_bad"), F.array_join(_least(F.col("sample")), ",").alias("sample"))
    return by.select("match_id", "table", "rule", "n_bad", "sample", *more)


def rules(df: DataFrame, table: str, key: str, bad: dict[str, Column | tuple[Column, Column]], sample: Column | None = None) -> DataFrame:
    """One row for each rule of ``bad`` that holds on some row of a match."""
    return counted(faults(df, table, key, bad, sample))


def _least(value: Column) -> Column:
    """At most ``MOST_SAMPLES`` values to show: the least, and the least of each of the other hash classes.  Each buffer holds one value."""
    part = F.pmod(F.xxhash64(value), F.lit(MOST_SAMPLES))
    return F.array_sort(F.array_compact(F.array(*[F.min(F.when(part == i, value)) for i in range(MOST_SAMPLES)])))


def column_errors(df: DataFrame, table: str) -> list[str]:
    """Missing columns and wrong kinds: a check of the schema alone.  Any integer or fraction will do for one of its sort."""
    have, out = {f.name: f.dataType for f in df.schema.fields}, []
    for f in schema.struct(table).fields:
        kind = have.get(f.name)
        if kind is None:
            out.append(f"{f.name}: missing")
        elif not _same_sort(f.dataType, kind):
            out.append(f"{f.name}: {kind.simpleString()} is not {f.dataType.simpleString()}")
    return out


def _same_sort(want: T.DataType, got: T.DataType) -> bool:
    if isinstance(want, T.ArrayType) and isinstance(got, T.ArrayType):
        return _same_sort(want.elementType, got.elementType)
    return want == got or any(isinstance(want, sort) and isinstance(got, sort) for sort in (T.IntegralType, T.FractionalType))


def column_bad(table: str) -> dict[str, tuple[Column, Column]]:
    """The rules of a table's columns: NaN, nulls in columns that have none, values outside a domain, arrays of wrong length."""
    bad, none = {}, F.lit(None).cast("string")
    for f in schema.struct(table).fields:
        v = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            bad[f"{f.name}: NaN"] = (F.isnan(v), none)
        if not f.nullable:
            bad[f"{f.name}: null"] = (v.isNull(), none)
        if f.name in schema.DOMAINS:
            bad[f"{f.name}: outside its domain"] = (~v.isin(*schema.DOMAINS[f.name]), v)
        if f.name in schema.LENGTHS:
            bad[f"{f.name}: not {schema.LENGTHS[f.name]} values"] = (F.size(v) != schema.LENGTHS[f.name], none)
    return bad


def repeats(df: DataFrame, table: str, keys: list[str], rule: str, n_rows: int | None = None) -> DataFrame:
    """Keys that more than one row of a match has, as faults.  ``n_rows``: how many rows there are, if they are counted."""
    by = ["match_id", *keys]
    twice = dealt(df.select(*by), df.count() if n_rows is None else n_rows, *by).groupBy(*by).count().where("count > 1")
    return faults(twice, table, "match_id", {rule: F.lit(True)}, F.concat_ws("/", *keys))


def strays(df: DataFrame, table: str, to: DataFrame, on: list[str], rule: str, n_rows: int | None = None) -> DataFrame:
    """Rows whose key the other table lacks, as faults.  ``n_rows``: how many rows both tables have, if they are counted."""
    n = df.count() + to.count() if n_rows is None else n_rows
    rows = dealt(df.select("match_id", *[c for c in on if c != "match_id"]), n, *on).join(dealt(to.select(*on), n, *on), on, "left_anti")
    return faults(rows, table, "match_id", {rule: F.lit(True)}, F.col(on[-1]))


def orphans(df: DataFrame, table: str, to: DataFrame, on: list[str], rule: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return counted(strays(df, table, to, on, rule))


def frame_faults(frames: DataFrame, n_rows: int | None = None) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("frame_id")
    rows = dealt(frames, frames.count() if n_rows is None else n_rows, "match_id").withColumns({"_period": F.lag("period").over(w), "_t": F.lag("timestamp_s").over(w), "_id": F.lag("frame_id").over(w), "_next": F.lead("frame_id").over(w)})
    first_of_many = (F.col("_next") == F.col("frame_id")) & ~F.coalesce(F.col("_id") == F.col("frame_id"), F.lit(False))
    return faults(rows, "frames", "match_id", {
        "frame_id repeats": first_of_many, "period decreases": F.col("period") < F.col("_period"), "timestamp decreases": (F.col("period") == F.col("_period")) & (F.col("timestamp_s") < F.col("_t")),
        "shootout is alive": (F.col("period") == 5) & (F.col("ball_state") == "alive"),
        "carrier without team": F.col("ball_carrier_id").isNotNull() & F.col("possession_team").isNull(), "set play without team": F.col("set_play_phase") & F.col("possession_team").isNull(),
    }, F.col("frame_id"))


def frame_rules(frames: DataFrame) -> DataFrame:
    """Order, repeats and states of frames: one window over each match."""
    return counted(frame_faults(frames))


def position_bad() -> dict[str, Column]:
    return {"x out of bounds": F.abs("x") > 67.5, "y out of bounds": F.abs("y") > 49}


def object_bad() -> dict[str, tuple[Column, Column]]:
    kind, name = F.col("object_type"), F.col("object_id")
    return {
        "team on ball or referee": (kind.isin("ball", "referee") & F.col("team").isNotNull(), name), "z on another than the ball": ((kind != "ball") & F.col("z").isNotNull(), name),
        "confidence outside 0 to 1": (~F.col("confidence").between(0, 1), name), "hidden but not interpolated": (~F.col("visible") & ~F.col("interpolated"), name),
    }


def object_links(objects: DataFrame, frames: DataFrame, players: DataFrame, n_rows: int | None = None) -> list[DataFrame]:
    """Faults of objects among themselves and towards frames and players.  ``n_rows``: how many rows objects and frames have, if they are counted."""
    n = objects.count() + frames.count() if n_rows is None else n_rows
    per_frame = dealt(objects.where("object_type = 'ball'").select("match_id", "frame_id"), n, "match_id", "frame_id").groupBy("match_id", "frame_id").agg(F.count("*").alias("balls"))
    carried = frames.where("ball_carrier_id IS NOT NULL").select("match_id", "frame_id", F.col("ball_carrier_id").alias("object_id"))
    return [
        faults(per_frame, "objects", "match_id", {"more than one ball": F.col("balls") > 1}, F.col("frame_id")), strays(objects.where("player_id IS NOT NULL"), "objects", players, ["match_id", "player_id"], "player unknown", n),
        strays(carried, "frames", objects, ["match_id", "frame_id", "object_id"], "carrier absent", n), repeats(objects, "objects", ["frame_id", "object_id"], "object repeats", n), strays(objects, "objects", frames, ["match_id", "frame_id"], "frame unknown", n),
    ]


def absent_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables in which a match that some table knows has no rows, but for those that may be empty: one aggregation over the ids alone."""
    ids = reduce(DataFrame.unionByName, [df.select(F.col("match_id").cast("string").alias("match_id"), F.lit(name).alias("table")) for name, df in tables.items()])
    needed = [name for name in schema.DDL if name not in schema.MAY_BE_EMPTY]
    has = ids.groupBy("match_id").agg(F.array(*[F.struct(F.lit(name).alias("table"), F.count_if(F.col("table") == name).alias("n")) for name in needed]).alias("has"))
    return has.select("match_id", F.explode("has").alias("h")).where("h.n = 0").select("match_id", "h.table", F.lit("no rows").alias("rule"), F.lit(None).cast("string").alias("sample"))


def validated(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules over all matches in one plan.

    Tables that lack columns or have the wrong kinds are reported alone.  A match whose columns break a rule, or that lacks a table, is reported with these rules
    alone: those across rows and tables take columns that passed.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    wrong = [("*", t, e, 1, "") for t in schema.DDL for e in (column_errors(tables[t], t) if t in tables else ["missing"])]
    if wrong:
        return spark.createDataFrame(wrong, REPORT)
    t, frame = tables, ["match_id", "frame_id"]
    n = {name: t[name].count() for name in ("frames", "objects", "events")}
    of_events = n["events"] + n["frames"]
    late = dealt(t["events"].select(*frame, "event_type"), of_events, *frame).join(dealt(t["frames"].where("period = 5").select(*frame), of_events, *frame), frame, "left_semi")
    disallowed = {"disallowed goal": (F.col("event_type") == "goal") & (F.col("outcome") == "disallowed")}
    waits = {"match": {"native_fps: not above 0": (F.col("native_fps") <= 0, F.col("native_fps"))}, "objects": position_bad() | object_bad(), "events": position_bad() | disallowed}
    columns = [*[faults(t[name], name, "match_id", column_bad(name) | waits.get(name, {}), F.col("frame_id") if name in ("objects", "events") else None) for name in schema.DDL], absent_tables(t)]
    across = [repeats(t["match"], "match", [], "more than one row", n["frames"]), frame_faults(t["frames"], n["frames"]), *object_links(t["objects"], t["frames"], t["players"], n["objects"] + n["frames"]), strays(t["events"], "events", t["frames"], frame, "frame unknown", of_events), faults(late, "events", "match_id", {"shot in a shootout": F.col("event_type") == "shot"}, F.col("frame_id")), repeats(t["players"], "players", ["player_id"], "player repeats", n["frames"])]
    waiting = [rule for bad in waits.values() for rule in bad]
    found = reduce(DataFrame.unionByName, columns).withColumn("_across", F.col("rule").isin(waiting)).unionByName(reduce(DataFrame.unionByName, across).withColumn("_across", F.lit(True)))
    first = F.min("_across").over(Window.partitionBy("match_id"))  # a row for each broken rule of a match
    return counted(found, "_across").withColumn("_first", first).where(F.col("_across") == F.col("_first")).drop("_across", "_first")


def equal_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one table only, with the side that has them; no rows if both have the same, with multiplicity."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).withColumn("only_in", F.lit("a")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("b")))


def contract(right: DataFrame, on: list[str]) -> DataFrame:
    """Keys that break an m:1 join onto ``right``."""
    return right.groupBy(*on).count().where("count > 1")


def off_pitch_runs(objects: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Runs of consecutive frames with positions off the pitch: their bounds, types and objects."""
    bad = objects.where((F.abs("x") > 52.5) | (F.abs("y") > 34))
    frames = bad.select(*keys, frame).distinct()
    run = frames.withColumn("run", F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame)))
    return bad.join(run, [*keys, frame]).groupBy(*keys, "run").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.countDistinct("object_id").alias("n_objects"), F.array_join(F.array_sort(F.collect_set("object_type")), ",").alias("types"), F.max(F.abs("x")).alias("max_x"), F.max(F.abs("y")).alias("max_y")).drop("run")


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, digest): an order-free digest of a group's rows, repeated ones included, to tell whether a derived table is stale."""
    mixed = F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), mixed.alias("digest"))


def stale(recorded: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose recorded fingerprint is absent or differs, and recorded groups that are gone (their n and digest are null)."""
    r = recorded.select(*keys, F.col("n").alias("_n"), F.col("digest").alias("_d"))
    return current.join(r, keys, "full").where(~(F.col("_n").eqNullSafe(F.col("n")) & F.col("_d").eqNullSafe(F.col("digest")))).drop("_n", "_d")
