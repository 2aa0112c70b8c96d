"""Mutual nearest neighbours in groups of any size: each place looks its nearest up in a tree of boxes, so that the pairs of a group are never made.

Distances, and which of two equal ones counts, are those of ``tables.mutual_nearest`` to the last digit: rounding keeps the order of numbers, so that the gap and the
span of two boxes, rounded as a distance is, bound all rounded distances between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from gridmark.operators import sequential, tables
from gridmark.session import TASK_ROWS

#: Places in a leaf of a tree; pairs of a group that are compared without one.
LEAF, FEW = 8, 1 << 14
#: Distances, and pairs of boxes, in memory at once.
STEP, BOXES = 1 << 20, 1 << 16
NOBODY = np.iinfo(np.int64).max


def mutual_nearest(a: DataFrame, b: DataFrame, on: list[str], gate: float, block: int = TASK_ROWS) -> DataFrame:
    """(on, a_id, b_id, d): pairs within the gate of which each is the other's nearest, ties by a_id, then b_id.  ``a``, ``b``: (on, id, x, y).

    x, y: doubles, or decimals of up to 15 digits, whose differences are exact; rows without a finite place are left out.  A task holds one group.  A side of more than
    ``block`` rows is cut in blocks by a hash: a task holds one of each side, and the nearest of all blocks counts.  These groups are counted first (without places), and
    there are fewer than rows / ``block`` of them.
    """
    scales = [_scale(a, b, c) for c in "xy"]
    x, y = ((F.col(c) * F.lit(10**s) if s else F.col(c)).cast("double") for c, s in zip("xy", scales, strict=True))  # decimals as whole numbers of their last digit
    own = {0: F.col("id").alias("a_id"), 1: F.lit(None).cast(a.schema["id"].dataType).alias("a_id")}
    other = {0: F.lit(None).cast(b.schema["id"].dataType).alias("b_id"), 1: F.col("id").alias("b_id")}
    sides = [df.select(*on, F.lit(s).alias("_side"), own[s], other[s], x.alias("_x"), y.alias("_y")) for s, df in enumerate((a, b))]
    known = " AND ".join(["abs(_x) < double('inf')", "abs(_y) < double('inf')", *[f"`{k}` IS NOT NULL" for k in on]])
    rows = sides[0].unionByName(sides[1]).where(known)
    n_a, n_b = F.count_if(F.col("_side") == 0), F.count_if(F.col("_side") == 1)
    counts = sides[0].select(*on, "_side").unionByName(sides[1].select(*on, "_side")).groupBy(*on).agg(*[F.greatest(F.ceil(n / block), F.lit(1)).alias(c) for c, n in (("_p", n_a), ("_q", n_b))])
    large = F.broadcast(counts.where("_p > 1 OR _q > 1"))

    pairs = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*on, "a_id", "b_id"]) + ", d double"
    order = ["_side", F.col("a_id").asc_nulls_last(), F.col("b_id").asc_nulls_last()]
    whole = sequential.groups(rows.join(large, on, "left_anti"), on, order, lambda t, starts: _pairs(t, starts, on, gate, scales, True), pairs)

    at = F.xxhash64("a_id", "b_id", "_x", "_y")
    block_of = lambda s, n: F.explode(F.when(F.col("_side") == s, F.array(F.pmod(at, n))).otherwise(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    cut = rows.join(large, on).withColumn("_i", block_of(0, "_p")).withColumn("_j", block_of(1, "_q")).drop("_p", "_q")
    best = sequential.groups(cut, [*on, "_i", "_j"], order, lambda t, starts: _pairs(t, starts, on, gate, scales, False), pairs)
    return whole.unionByName(tables.mutual(best.distinct(), on))


def _scale(a: DataFrame, b: DataFrame, c: str) -> int:
    """The digits after the point of column ``c``, if it is a decimal on both sides."""
    kinds = [df.schema[c].dataType for df in (a, b)]
    if not all(isinstance(k, DecimalType) for k in kinds):
        return 0
    scale = max(k.scale for k in kinds)
    if max(k.precision - k.scale for k in kinds) + scale > 15:
        raise ValueError(f"{c} has more than 15 digits")
    return scale


def _pairs(t: pa.Table, starts: np.ndarray, on: list[str], gate: float, scales: list[int], mutual: bool) -> Iterator[pa.RecordBatch]:
    """Of groups that begin at ``starts``, ordered by side and id: pairs of which each is the other's nearest, or else every row's nearest."""
    n = t.num_rows
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    side, x, y = (t.column(c).to_numpy() for c in ("_side", "_x", "_y"))
    first = sequential.changes(group, side, *[sequential.codes(t.column(c)) for c in ("a_id", "b_id")])
    who, of = np.cumsum(first) - 1, np.flatnonzero(first)  # the number of a row's id, in their order, and the first row of each
    order = np.lexsort((y, x, side, group))
    new = sequential.changes(group[order], side[order], x[order], y[order])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    at = order[new]
    ends = np.searchsorted(2 * group[at] + side[at], np.arange(2 * len(starts) + 1))
    places = Places(x[at], y[at], who[at], scales, gate)
    moved = places.match(ends[:-1:2], ends[1::2], ends[2::2])
    place = moved[place]
    d, nearest = places.d[place], places.nearest[place]
    least = np.minimum.reduceat(d, of)
    nearest = np.minimum.reduceat(np.where(d == least[who], nearest, NOBODY), of)
    is_a = side[of] == 0
    one = np.flatnonzero(nearest != NOBODY)
    if mutual:
        one = one[is_a[one]]
        one = one[nearest[nearest[one]] == one]
    other = nearest[one]
    a, b = np.where(is_a[one], one, other), np.where(is_a[one], other, one)
    out = [t.column(k).take(pa.array(of[a])) for k in [*on, "a_id"]] + [t.column("b_id").take(pa.array(of[b])), pa.array(least[one])]
    yield from pa.table(out, names=[*on, "a_id", "b_id", "d"]).to_batches()


class Places:
    """Different places of groups, the least id at each, and the distance and the least id of the nearest place of the other side, once these are matched."""

    def __init__(self, x: np.ndarray, y: np.ndarray, who: np.ndarray, scales: list[int], gate: float) -> None:
        self.x, self.y, self.who, self.units, self.gate = x, y, who, [10.0**s for s in scales], gate
        self.d, self.nearest = np.full(len(x), np.inf), np.full(len(x), NOBODY)

    def apart(self, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        """As ``tables.apart``: the root of a sum of squares, each step rounded."""
        dx, dy = dx / self.units[0], dy / self.units[1]
        return np.sqrt(dx * dx + dy * dy)

    def match(self, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Finds the nearest in groups of places from ``start``, those of the other side from ``middle``, to ``end``; returns where each place has moved."""
        moved = np.arange(len(self.x))
        n = (middle - start) * (end - middle)
        few = (n > 0) & (n <= FEW)
        s, m, e = start[few], middle[few], end[few]
        self.look_up(s, m, m, e)
        self.look_up(m, e, s, m)
        for g in np.flatnonzero(n > FEW):
            trees = [Tree(self, lo, hi, moved) for lo, hi in ((start[g], middle[g]), (middle[g], end[g]))]
            for q, t in (trees, trees[::-1]):
                for ranges in self.close(q, t):
                    self.look_up(*ranges)
        return moved

    def close(self, q: Tree, t: Tree) -> Iterator[tuple[np.ndarray, ...]]:
        """(start, end) of the leaves of ``q``, and of those of ``t`` that can hold the nearest of one of their places; all of a leaf come together."""
        waiting = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while waiting:
            level, i, j = waiting.pop()
            if 0 < level <= t.depth:
                i, j = np.repeat(i, 2), np.column_stack((2 * j, 2 * j + 1)).ravel()
            if 0 < level <= q.depth:
                i, j = np.concatenate((2 * i, 2 * i + 1)), np.concatenate((j, j))
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
            at, to = q.levels[min(level, q.depth)], t.levels[min(level, t.depth)]
            gap, span = zip(*[(np.maximum(np.maximum(to[lo][j] - at[hi][i], at[lo][i] - to[hi][j]), 0.0), np.maximum(to[hi][j] - at[lo][i], at[hi][i] - to[lo][j])) for lo, hi in ((1, 2), (3, 4))], strict=True)
            heads = np.flatnonzero(sequential.changes(i))
            reach = np.minimum(np.minimum.reduceat(self.apart(*span), heads), self.gate)
            kept = self.apart(*gap) <= np.repeat(reach, np.diff(np.append(heads, len(i))))
            i, j = i[kept], j[kept]
            if level < max(q.depth, t.depth):
                heads = np.flatnonzero(sequential.changes(i))
                cuts = heads[sequential.changes(heads // BOXES)]
                waiting += [(level + 1, i[a:b], j[a:b]) for a, b in zip(cuts, np.append(cuts, len(i))[1:], strict=True)]
            elif len(i):
                yield at[0][i], at[0][i + 1], to[0][j], to[0][j + 1]

    def look_up(self, start: np.ndarray, end: np.ndarray, to_start: np.ndarray, to_end: np.ndarray) -> None:
        """Each place from ``start`` to ``end`` gets its nearest of those from ``to_start`` to ``to_end``; ranges of one start stand together."""
        if not len(start):
            return
        heads = np.flatnonzero(sequential.changes(start))
        sizes = np.add.reduceat(to_end - to_start, heads)
        steps = np.cumsum(sizes * (end - start)[heads]) // STEP
        cuts = [*np.flatnonzero(sequential.changes(steps)), len(heads)]
        for h, k in zip(cuts[:-1], cuts[1:], strict=True):
            ranges = slice(heads[h], heads[k] if k < len(heads) else len(start))
            targets = sequential.spread(to_start[ranges], (to_end - to_start)[ranges])
            size, many = sizes[h:k], (end - start)[heads[h:k]]
            one = sequential.spread(start[heads[h:k]], many)
            begins, size = np.repeat(np.cumsum(size) - size, many), np.repeat(size, many)
            to = targets[sequential.spread(begins, size)]
            d = self.apart(np.repeat(self.x[one], size) - self.x[to], np.repeat(self.y[one], size) - self.y[to])
            begins = np.cumsum(size) - size
            least = np.minimum.reduceat(d, begins)
            equal = np.flatnonzero(d == np.repeat(least, size))
            nearest = np.minimum.reduceat(self.who[to[equal]], np.searchsorted(equal, begins))
            near = least <= self.gate
            self.d[one[near]], self.nearest[one[near]] = least[near], nearest[near]


class Tree:
    """Places from ``lo`` to ``hi``, put in the order of a tree that halves them at the middle of their wider side.

    ``levels``: from the root to the leaves, where each box begins and the last ends, and the least and greatest x and y of each.
    """

    def __init__(self, places: Places, lo: int, hi: int, moved: np.ndarray) -> None:
        n = hi - lo
        x, y, order = places.x[lo:hi], places.y[lo:hi], np.arange(n)
        self.depth, self.levels = max(0, int(np.ceil(np.log2(n / LEAF)))), []
        for level in range(self.depth + 1):
            cuts = (np.arange((1 << level) + 1) * n) >> level
            xs, ys = x[order], y[order]
            x0, x1, y0, y1 = (f.reduceat(v, cuts[:-1]) for v in (xs, ys) for f in (np.minimum, np.maximum))
            self.levels.append((lo + cuts, x0, x1, y0, y1))
            if level < self.depth:
                wide = (x1 - x0) / places.units[0] >= (y1 - y0) / places.units[1]
                node = np.repeat(np.arange(1 << level), np.diff(cuts))
                order = order[np.lexsort((np.where(wide[node], xs, ys), node))]
        moved[lo + order] = np.arange(lo, hi)
        for v in (places.x, places.y, places.who):
            v[lo:hi] = v[lo:hi][order]
