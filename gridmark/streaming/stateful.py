"""Streams: the batch step functions with state per key, and windowed tapes with watermarks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from gridmark.operators.sequential import plain
from gridmark.session import ship


class _Place:
    """A row's place in the order: nulls before values."""

    def __init__(self, values: list) -> None:
        self.values = values

    def __lt__(self, other: _Place) -> bool:
        return [(v is not None, v) for v in self.values] < [(v is not None, v) for v in other.values]


def stream(df: DataFrame, keys: list[str], order: str, machine: Callable[[dict], object], schema: str, *, tie: tuple[str, ...] = (), delay: str | None = None, event_time: str | None = None) -> DataFrame:
    """``sequential.batch`` for a stream: one machine for each key, its ``__dict__`` kept as JSON in the state store.

    Rows of a micro-batch are sorted by ``order`` and ``tie``; rows before the last one of the micro-batches so far come too late and are dropped, so the output equals the
    batch operator's on the rows that were in time.  Rows of equal time all count: those that differ in ``tie`` only in their order, others as they come.  With ``event_time`` and ``delay`` a key whose rows have ended is closed when the watermark passes it.
    """
    ship(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = [f.name for f in StructType.fromDDL(schema)]
    names = [*keys, *fields]
    timed = bool(delay and event_time)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = machine({})
        last = None
        if state.exists:
            saved, place = state.get
            m.__dict__.update(json.loads(saved))
            last = _Place(json.loads(place))
        if state.hasTimedOut:
            state.remove()
            rows = m.end()
        else:
            table = pd.concat(list(batches))
            rows, came, now = [], [{c: plain(v) for c, v in zip(table.columns, values, strict=True)} for values in table.itertuples(index=False, name=None)], last
            for place, row in sorted(((_Place([row[c] for c in (order, *tie)]), row) for row in came), key=lambda x: x[0]):
                if last is not None and place < last:
                    continue
                now = place
                rows += m.step(row)
            state.update((json.dumps(m.__dict__), json.dumps(now.values)))
            if timed:
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(pd.Timestamp(table[event_time].max()).value // 1_000_000) + 1))
        if rows:
            yield pd.DataFrame([(*key, *[r.get(f) for f in fields]) for r in rows], columns=names, dtype=object)

    source = df.withWatermark(event_time, delay) if timed else df
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    out = ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema])
    return source.groupBy(*keys).applyInPandasWithState(run, out, "machine string, last string", "append", timeout)


STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def asof_stream(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: dict[str, str], *, delay: str, most_age_us: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """``asof.asof_backward`` of two streams: each left row with ``columns`` of the latest right row at or before it, at most ``most_age_us`` old.

    ``time`` is a timestamp in both.  Rows wait in their key's state until the watermark, ``delay`` behind the latest time seen, has passed them; then they are taken in the order of
    time, right rows before left ones, and right rows of equal time by ``order``, so the last of them counts.  A key keeps its waiting rows and one right row.
    The output equals the batch operator's on all rows that come less than ``delay`` late; later ones are dropped.
    """
    ship(left.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    got = ", ".join(f"`{name}` {right.schema[c].dataType.simpleString()}" for c, name in columns.items())
    tie = F.to_json(F.struct(*[F.col(c) for c in order], F.lit(0).alias("_")), STAMPS)
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit("").alias("_tie"), F.to_json(F.struct(*left.columns), STAMPS).alias("_row"))
    b = right.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), F.to_json(F.struct(*[F.col(c).alias(n) for c, n in columns.items()]), STAMPS).alias("_row"))
    both = a.where(F.col(time).isNotNull()).unionByName(b).withColumn("_us", F.unix_micros("_t"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = json.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            for table in batches:
                waiting += [list(r) for r in zip(table["_us"].tolist(), table["_side"].tolist(), table["_tie"].tolist(), table["_row"].tolist(), strict=True)]
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted((r for r in waiting if r[0] < passed), key=lambda r: (r[0], r[1], [(v is not None, v) for v in json.loads(r[2]).values()] if r[2] else []))
        waiting, out = [r for r in waiting if r[0] >= passed], []
        for us, side, _, row in ready:
            if side == 0:
                last = [us, row]
            else:
                out.append((*key, row, last[1] if last and (most_age_us is None or us - last[0] <= most_age_us) else None))
        state.update((json.dumps([waiting, last]),))
        if waiting:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(r[0] for r in waiting) // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=[*keys, "_left", "_right"], dtype=object)

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["_left string", "_right string"])
    found = both.withWatermark("_t", delay).groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    found = found.select(F.from_json("_left", rest, STAMPS).alias("_l"), F.from_json("_right", got, STAMPS).alias("_r"))
    return found.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_r")[n].alias(n) for n in columns.values()])


def tape(trades: DataFrame, time: str, value: str, side: str, *, width: str = "60 seconds", slide: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Volume by side over sliding windows; rows later than the watermark are dropped."""
    by = trades.withWatermark(time, delay).groupBy(F.window(time, width, slide), side).agg(F.sum(value).alias("volume"), F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), side, "volume", "n")


def sessions(rows: DataFrame, keys: list[str], time: str, gap: str, delay: str) -> DataFrame:
    """Runs of a key's rows without a gap, as session windows."""
    by = rows.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return by.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def distinct_trades(trades: DataFrame, time: str, delay: str) -> DataFrame:
    """Trades with each (block, log_index) once within the watermark."""
    return trades.withWatermark(time, delay).dropDuplicatesWithinWatermark(["block", "log_index"])
