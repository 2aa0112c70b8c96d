"""Step functions of sequential operators.  Each is a class with ``step(row) -> list of output dicts`` and ``end() -> list``.

The same object runs a batch group (``sequential.batch``) and a stream key (``streaming.stateful``); its state is its ``__dict__``, plain values
only, so a stream can store it as JSON.
"""

from __future__ import annotations

import heapq
import math
from collections import deque


class ViewGate:
    """Flips on after ``on_us`` of passing shares, off after ``off_us`` of failing ones."""

    def __init__(self, least: float, on_us: int, off_us: int) -> None:
        self.least, self.on_us, self.off_us, self.on, self.since = least, on_us, off_us, False, None

    def step(self, row: dict) -> list[dict]:
        passes = row["share"] is not None and row["share"] >= self.least
        if passes == self.on:
            self.since = None
        else:
            self.since = row["ts_us"] if self.since is None else self.since
            if row["ts_us"] - self.since >= (self.off_us if self.on else self.on_us):
                self.on, self.since = passes, None
        return [{"ts_us": row["ts_us"], "on": self.on}]

    def end(self) -> list[dict]:
        return []


class BallTrack:
    """One track through candidates (x, y, confidence): inside a gate that grows with time, the best of confidence less distance.

    A strong candidate restarts a track older than ``gap_us``; a gap is bridged at the last velocity up to ``coast_us``.
    """

    def __init__(self, gate: float = 2.0, per_second: float = 40.0, gap_us: int = 1_000_000, strong: float = 0.6, fastest: float = 45.0, coast_us: int = 300_000) -> None:
        self.gate, self.per_second, self.gap_us, self.strong, self.fastest, self.coast_us = gate, per_second, gap_us, strong, fastest, coast_us
        self.at = self.velocity = None

    def step(self, row: dict) -> list[dict]:
        t, best, worth = row["ts_us"], None, -math.inf
        old = self.at is None or t - self.at[0] > self.gap_us
        for x, y, confidence in row["candidates"] or []:
            if old:
                value, ok = confidence, confidence >= self.strong
            else:
                dt = (t - self.at[0]) / 1e6
                d = math.hypot(x - self.at[1], y - self.at[2])
                value, ok = confidence - d / max(self.gate + self.per_second * dt, 1e-9), d <= self.gate + self.per_second * dt and d <= self.fastest * max(dt, 1e-3)
            if ok and value > worth:
                best, worth = (x, y), value
        kind = "seen"
        if best:
            dt = 0 if old else (t - self.at[0]) / 1e6
            self.velocity = [(best[0] - self.at[1]) / dt, (best[1] - self.at[2]) / dt] if dt > 0 else None
            self.at = [t, *best]
        elif self.at and self.velocity and t - self.at[0] <= self.coast_us:
            dt = (t - self.at[0]) / 1e6
            best, kind = (self.at[1] + self.velocity[0] * dt, self.at[2] + self.velocity[1] * dt), "coasted"
        return [{"ts_us": t, "x": best[0] if best else None, "y": best[1] if best else None, "kind": kind if best else None}]

    def end(self) -> list[dict]:
        return []


class RateLimit:
    """Of the marked rows, the first and then none for ``every_us``."""

    def __init__(self, every_us: int) -> None:
        self.every_us, self.last = every_us, None

    def step(self, row: dict) -> list[dict]:
        if not row["mark"] or (self.last is not None and row["ts_us"] - self.last < self.every_us):
            return []
        self.last = row["ts_us"]
        return [{"event_id": row["event_id"], "ts_us": row["ts_us"]}]

    def end(self) -> list[dict]:
        return []


class Autoregressive:
    """A stationary AR(1) series from each row's unit normal ``z``: a = exp(-dt / tau)."""

    def __init__(self, tau_us: int, sigma: float) -> None:
        self.tau_us, self.sigma, self.value, self.at = tau_us, sigma, None, None

    def step(self, row: dict) -> list[dict]:
        if self.value is None:
            self.value = row["z"]
        else:
            a = math.exp(-(row["ts_us"] - self.at) / self.tau_us)
            self.value = a * self.value + math.sqrt(1 - a * a) * row["z"]
        self.at = row["ts_us"]
        return [{"event_id": row["event_id"], "noise": self.sigma * self.value}]

    def end(self) -> list[dict]:
        return []


class TrailingMedian:
    """The median and the number of values from ``back`` before a row's time to just before it, for ``sequential.along``: steps return (median, n).

    Values lie in two heaps, the lower half and the upper one.  They leave in the order in which they came, so one is gone if its number is below the first that
    stays; a heap drops such values when they reach its top, and all of them when they are half of it.  Null values don't count.
    """

    def __init__(self, back: int) -> None:
        self.back, self.time, self.next, self.first = back, None, 0, 0
        self.waiting, self.live, self.low, self.high, self.n_low, self.n_high = [], deque(), [], [], 0, 0

    def step(self, time: int | None, value: float | None) -> tuple:
        if time is None:
            return None, 0
        if time != self.time:
            for v in self.waiting:
                self._add(v)
            self.waiting, self.time = [], time
            while self.live and self.live[0][0] < time - self.back:
                self._drop()
        if value is not None:
            self.waiting.append(value)
        n = self.n_low + self.n_high
        if not n:
            return None, 0
        low = -self.low[0][0]
        return (low if n % 2 else 0.5 * low + 0.5 * self.high[0][0]), n

    def _add(self, v: float) -> None:
        item = (v, self.next)
        self.live.append((self.time, *item))
        self.next += 1
        if self.n_low and item > self._top():
            heapq.heappush(self.high, item)
            self.n_high += 1
        else:
            heapq.heappush(self.low, (-v, -item[1]))
            self.n_low += 1
        self._even()

    def _drop(self) -> None:
        _, v, i = self.live.popleft()
        in_low = (v, i) <= self._top()
        self.first = i + 1
        self.n_low, self.n_high = self.n_low - in_low, self.n_high - (not in_low)
        self._prune()
        self._even()

    def _top(self) -> tuple:
        return -self.low[0][0], -self.low[0][1]

    def _prune(self) -> None:
        while self.low and -self.low[0][1] < self.first:
            heapq.heappop(self.low)
        while self.high and self.high[0][1] < self.first:
            heapq.heappop(self.high)
        if len(self.low) + len(self.high) > 2 * (self.n_low + self.n_high) + 64:
            self.low, self.high = [x for x in self.low if -x[1] >= self.first], [x for x in self.high if x[1] >= self.first]
            heapq.heapify(self.low)
            heapq.heapify(self.high)

    def _even(self) -> None:
        """As many values in the lower half as in the upper one, or one more."""
        while self.n_low > self.n_high + 1 or self.n_low < self.n_high:
            if self.n_low > self.n_high:
                v, i = heapq.heappop(self.low)
                heapq.heappush(self.high, (-v, -i))
                self.n_low, self.n_high = self.n_low - 1, self.n_high + 1
            else:
                v, i = heapq.heappop(self.high)
                heapq.heappush(self.low, (-v, -i))
                self.n_low, self.n_high = self.n_low + 1, self.n_high - 1
            self._prune()


class LatestMark:
    """The label of the mark that holds a time, of several that of the greatest ordinal, for ``sequential.along``: marks, at their starts, and points come in the order of time.

    Marks lie in a heap by ordinal; one that has ended leaves when it reaches the top, and all of them when they may be half of it.
    """

    def __init__(self) -> None:
        self.heap, self.n, self.most = [], 0, 1024

    def step(self, is_mark: bool, time: int | None, end: int | None, ordinal: int | None, label: object) -> tuple:
        if is_mark:
            self.n += 1
            heapq.heappush(self.heap, (-ordinal, -self.n, end, label))
            if len(self.heap) > self.most:
                self.heap = [m for m in self.heap if m[2] > time]
                heapq.heapify(self.heap)
                self.most = 2 * len(self.heap) + 1024
            return (None,)
        while self.heap and self.heap[0][2] <= time:
            heapq.heappop(self.heap)
        return (self.heap[0][3] if self.heap else None,)
