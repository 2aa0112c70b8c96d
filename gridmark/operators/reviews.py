"""Comparisons of an inferred series with a recorded one, and reviews of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.operators import asof, machines, sequential, tables


def agreement(df: DataFrame, keys: list[str], truth: str, inferred: str, alive: Column) -> DataFrame:
    """Counters and shares of agreement by group and pooled (null keys); an unknown inferred value disagrees with a known one."""
    known = F.col(truth).isNotNull()
    same = known & F.col(inferred).eqNullSafe(F.col(truth))
    by = df.rollup(*keys).agg(F.count_if(known).alias("n"), F.count_if(same).alias("agree"), F.count_if(known & alive).alias("n_alive"), F.count_if(same & alive).alias("agree_alive"), F.count_if(known & F.col(inferred).isNull()).alias("unknown"))
    return by.withColumns({"share": F.try_divide("agree", "n"), "share_alive": F.try_divide("agree_alive", "n_alive")})


def shifted_join(a: DataFrame, b: DataFrame, keys: list[str], time_a: str, time_b: str, shift: float, per_second: int, columns: dict[str, str]) -> DataFrame:
    """a's rows with b's ``columns`` on the tick of a's time moved by ``shift`` seconds."""
    tick = F.round((F.col(time_a) + shift) * per_second).cast("long")
    other = b.select(*keys, F.round(F.col(time_b) * per_second).cast("long").alias("_k"), *[F.col(c).alias(n) for c, n in columns.items()])
    return a.withColumn("_k", tick).join(other, [*keys, "_k"]).drop("_k")


def kicks(ball: DataFrame, keys: list[str], time: str, slow: float = 7.0, fast: float = 9.0, mean: float = 10.0, gap: int = 100_000, ahead: int = 200_000, *, repeats: bool = False) -> DataFrame:
    """Rows where a slow ball turns fast and stays so: speed before below ``slow``, after above ``fast``, over the next ``ahead`` micros above ``mean``.

    Repeated positions are dropped first, unless ``repeats`` keeps them as steps of speed 0; a step over a longer gap counts as none.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    moved = ball if repeats else ball.withColumn("_same", (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))).where("NOT coalesce(_same, false)").drop("_same")
    dt = F.lead(time).over(w) - F.col(time)
    step = F.when((dt > 0) & (dt <= gap), tables.apart(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")) / (dt / 1e6))
    rows = moved.withColumn("after", step).withColumn("before", F.lag("after").over(w)).where((F.col("before") < slow) & (F.col("after") > fast))
    rows = asof.asof_backward(rows.withColumn("_until", F.col(time) + ahead), moved.select(*keys, time, "x", "y"), keys, "_until", time, {time: "_lt", "x": "_lx", "y": "_ly"})
    over = tables.apart(F.col("_lx") - F.col("x"), F.col("_ly") - F.col("y")) / ((F.col("_lt") - F.col(time)) / 1e6)
    return rows.where(F.when(F.col("_lt") > F.col(time), over) > mean).drop("_until", "_lt", "_lx", "_ly")


def triggers(df: DataFrame, keys: list[str], time: str, fast: str, slow: str, truth: str, ahead: int) -> DataFrame:
    """Rows where the fast rule changes its team and the slow one keeps its own, with ``seen``, which of the two teams truth shows in the next ``ahead`` micros, and ``right``.

    Each team's next time is looked up (``asof.asof_forward``), so that a long horizon reads no frame of rows.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.withColumns({"_f": F.lag(fast).over(w), "_s": F.lag(slow).over(w)})
    rows = rows.where((F.col("_f") != F.col(fast)) & F.col("_s").eqNullSafe(F.col(slow)) & (F.col(fast) != F.col(slow))).drop("_f", "_s")
    shown = df.where(F.col(truth).isNotNull()).select(*keys, F.col(truth).alias("_team"), F.col(time).alias("_next"))
    soon = {}
    for rule in (fast, slow):
        rows = asof.asof_forward(rows.withColumn("_team", F.col(rule)), shown, [*keys, "_team"], time, "_next", {"_next": f"_next_{rule}"}, strict=True).drop("_team")
        soon[rule] = F.coalesce(F.col(f"_next_{rule}") - F.col(time) <= ahead, F.lit(False))
    rows = rows.withColumns({"seen": F.array_compact(F.array(*[F.when(soon[r], F.col(r)) for r in (fast, slow)])), "right": soon[fast] & ~soon[slow]})
    return rows.drop(f"_next_{fast}", f"_next_{slow}")


def withdrawn(labels: DataFrame, checks: DataFrame, clip: str, frame: str, most: float = 0.03) -> DataFrame:
    """Labels that stay: where over ``most`` of a clip's checked automatic labels were changed, its unchecked automatic ones go."""
    changed = checks.groupBy(clip).agg((F.avg(F.col("changed").cast("double")) > most).alias("_bad"))
    rows = labels.join(changed, clip, "left").join(checks.select(clip, frame, F.lit(True).alias("_checked")), [clip, frame], "left")
    goes = F.coalesce("_bad", F.lit(False)) & F.col("automatic") & F.col("_checked").isNull()
    return rows.where(~goes).drop("_bad", "_checked")


def drift(points: DataFrame, keys: list[str], time: str, near: int = 200_000, far: int = 1_000_000) -> DataFrame:
    """``points`` (dx, dy: offsets of confident candidates) with the median offset of the rows ``near`` to ``far`` micros away; null without any."""
    w = Window.partitionBy(*keys).orderBy(time)

    def around(c: str) -> Column:
        both = F.concat(F.collect_list(c).over(w.rangeBetween(-far, -near)), F.collect_list(c).over(w.rangeBetween(near, far)))
        n = F.size(both)
        return F.when(n > 0, (F.get(F.sort_array(both), F.floor((n - 1) / 2).cast("int")) + F.get(F.sort_array(both), F.floor(n / 2).cast("int"))) / 2)

    return points.withColumns({"bias_x": around("dx"), "bias_y": around("dy")})


def decided(labels: DataFrame, candidates: DataFrame, on: list[str], hit: float, spare: float) -> DataFrame:
    """Each label (on, x, y) with its decision by the distances of candidates: missed, rival, positive or spare, and the far ones as negatives."""
    d = labels.join(candidates.select(*on, F.col("x").alias("cx"), F.col("y").alias("cy"), "confidence"), on, "left").withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    by = d.groupBy(*on).agg(F.min("d").alias("nearest"), F.count_if(F.col("d") <= hit).alias("inside"), F.array_sort(F.collect_list(F.when(F.col("d") > spare, F.struct("cx", "cy")))).alias("negatives"))
    return by.withColumn("decision", F.when(F.col("nearest").isNull() | (F.col("nearest") > spare), "missed").when(F.col("inside") > 1, "rival").when(F.col("inside") == 1, "positive").otherwise("spare"))


def marked_at(points: DataFrame, marks: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """``points`` with the label of the interval [start, end) that holds them; of several, the later one, which has the greatest ordinal.

    Marks are copied to the cells of ``width`` that they span, and each cell is passed over once in the order of time (``machines.LatestMark``): a point is paired with
    no mark, however many hold it.
    """
    cell = lambda t: F.floor(t / width)
    whole = marks.where((F.col("start") < F.col("end")) & F.col("ordinal").isNotNull()).dropna(subset=keys)
    label = whole.schema["label"].dataType.simpleString()
    m = whole.select(*keys, F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("_cell"), F.lit(True).alias("_mark"), F.col("start").alias("_t"), F.col("end").alias("_end"), F.col("ordinal").alias("_ordinal"), F.col("label").alias("_label"))
    p = points.select(*keys, cell(F.col(time)).alias("_cell"), F.lit(False).alias("_mark"), F.col(time).alias("_t"), F.struct(*points.columns).alias("_p"))
    order = ["_t", F.desc("_mark"), "_ordinal", "_label"]
    rows = sequential.along(p.unionByName(m, allowMissingColumns=True), [*keys, "_cell"], order, ["_mark", "_t", "_end", "_ordinal", "_label"], machines.LatestMark, f"label {label}")
    return rows.where("NOT _mark").select("_p.*", "label")


def clip_scores(pairs: DataFrame, clip: str) -> DataFrame:
    """(clip, frames, truth, seen, matched, recall, precision) from per-frame counts, and pooled in the row without a clip."""
    by = pairs.rollup(clip).agg(F.count("*").alias("frames"), F.sum("truth").alias("truth"), F.sum("seen").alias("seen"), F.sum("matched").alias("matched"))
    return by.withColumns({"recall": F.try_divide("matched", "truth"), "precision": F.try_divide("matched", "seen")})
