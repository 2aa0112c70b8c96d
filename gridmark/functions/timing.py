"""Times as integers.  Series are compared on whole microseconds or ticks, never on floating seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
TICK_US = 100_000


def to_us(seconds: Column) -> Column:
    """Seconds as whole microseconds."""
    return F.round(seconds * SECOND).cast("long")


def timestamp_us(ts: Column) -> Column:
    """A timestamp, with or without a zone, as microseconds since the epoch in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def tick(seconds: Column, per_second: int = 10) -> Column:
    """The nearest grid tick of a second."""
    return F.round(seconds * per_second).cast("long")


def event_tick(seconds: Column, per_second: int = 10) -> Column:
    """The grid tick at or before a second; a hair of tolerance lets 0.3 be tick 3."""
    return F.floor(seconds * per_second + 1e-6).cast("long")


def frame_of(seconds: Column, fps: float = 29.97) -> Column:
    """The frame number of a second, halves to even."""
    return F.bround(seconds * fps).cast("long")


def clock_seconds(text: Column) -> Column:
    """``HH:MM:SS.f`` as seconds."""
    part = F.split(text, ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def match_clock(period: Column, seconds: Column) -> Column:
    """``mm:ss`` on the match's clock: periods begin at minute 0, 45, 90, 105 and 120."""
    base = F.element_at(F.array(*[F.lit(m * 60) for m in (0, 45, 90, 105, 120)]), period.cast("int"))
    whole = (base + F.floor(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def utc_us(period_start: Column, seconds: Column) -> Column:
    """The UTC microseconds of a moment in a period that starts at a timestamp."""
    return timestamp_us(period_start) + to_us(seconds)
