"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words (``targets``), so each of its documents a fractional number of copies.  Its whole part
is taken; the fractions are rounded together: two documents are paired, and words of probability move at random from one to the
other, with chances that keep both expectations, until one fraction is 0 or 1.  What stays fractional meets the next
document.  Pairs move words, not copies, so a source's total never changes while fractions remain.

``mixed`` folds buckets of about ``fan`` documents in parallel, each leaving at most one fractional document; those meet in
buckets of buckets, and so on: a reduction tree of depth log_fan(documents).  A hot source just has more buckets.
Larger documents meet first, so that what stays fractional shrinks: a pair ends at the document that has fewer words left to move.
At the root the one document left of a source rounds to the nearer number, and one decided document of the source, the one whose
words come nearest to what that rounding adds or takes, is decided the other way (``settled_up``).  So a source ends nearer to its target than half of its smallest
free document wherever it has documents of all sizes; this swap is the only step that moves an expectation, by one document of each source.  Chances come from hashes of ids, so reruns agree.

Defined cases: null and blank texts have size 0 and take nothing; the null source is a source, last in order; repeated rows (the same
id, source and text) share one decision; no documents give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.common import fingerprint, hinted, let, n_words, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
MOST_BROADCAST_ROWS = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, th, size): a narrow row for each document."""
    return docs.select("doc_id", "source", fingerprint(F.col("text")).alias("th"), n_words(F.col("text")).alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target): ``share`` of all words dealt out by weight, none above ``most`` times its size.

    Dealing the excess of capped sources to the others by weight, until none is above, ends at one level: a source's target is the
    lesser of its cap and level x weight.  Sources by cap / weight show the level at the first that is not capped.
    The windows run over one row for each source.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    code = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (code + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("before", F.sum("cap").over(upto) - F.col("cap")).withColumn("weight_left", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
    level = (share * F.sum("source_size").over(every) - F.col("before")) / F.col("weight_left")
    by = by.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("before", "level"))).over(every)["level"])
    return by.select("source", "n_docs", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).cast("double").alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(members: Column, seed: int) -> Column:
    """Folds an array of (less, h, key, size, base, p), ``less`` being -size: the struct (done: array of (key, size, base, up), one: the fractional one, or null); ``up`` is 1 for one copy more than ``base``."""
    kind = "struct<less:bigint,h:bigint,key:struct<doc_id:bigint,source:string,th:bigint>,size:bigint,base:bigint,p:double>"

    def settled(x: Column, up: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["size"].alias("size"), x["base"].alias("base"), up.alias("up"))

    def moved(x: Column, p: Column) -> Column:
        return F.struct(x["less"].alias("less"), x["h"].alias("h"), x["key"].alias("key"), x["size"].alias("size"), x["base"].alias("base"), p.alias("p"))

    def pair(done: Column, a: Column, x: Column) -> Column:
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
        down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])

        def after(m: Column) -> Column:
            rises = _uniform(F.lit(seed), a["h"], x["h"]) * (m["up"] + m["down"]) < m["down"]
            words = F.when(rises, m["up"]).otherwise(-m["down"])
            ends_a = F.when(rises, (1 - a["p"]) * a["size"] <= m["up"]).otherwise(a["p"] * a["size"] <= m["down"])
            ends_x = F.when(rises, x["p"] * x["size"] <= m["up"]).otherwise((1 - x["p"]) * x["size"] <= m["down"])
            one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
            a_done = settled(a, F.when(rises, one).otherwise(zero))
            x_done = settled(x, F.when(rises, zero).otherwise(one))
            a_left = moved(a, a["p"] + words / a["size"])
            x_left = moved(x, x["p"] - words / x["size"])
            return F.struct(
                F.when(ends_a & ends_x, F.concat(done, F.array(a_done, x_done))).when(ends_a, F.array_append(done, a_done)).otherwise(F.array_append(done, x_done)).alias("done"),
                F.when(ends_a & ends_x, F.lit(None).cast(kind)).when(ends_a, x_left).otherwise(a_left).alias("one"),
            )

        return let(F.struct(up.alias("up"), down.alias("down")), after)

    start = F.struct(F.array().cast("array<struct<key:struct<doc_id:bigint,source:string,th:bigint>,size:bigint,base:bigint,up:bigint>>").alias("done"), F.lit(None).cast(kind).alias("one"))
    return F.aggregate(members, start, lambda acc, x: F.when(acc["one"].isNull(), F.struct(acc["done"].alias("done"), x.alias("one"))).otherwise(pair(acc["done"], acc["one"], x)))


def decisions(sized: DataFrame, goals: DataFrame, *, seed: int = 17, fan: int = 96) -> DataFrame:
    """(doc_id, source, th, copies) for each different document with words, of staged ``sizes`` and ``targets``."""
    units = sized.where(F.col("size") > 0).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "th").agg(F.sum("size").alias("size"))
    g = hinted(goals.select(F.col("source").alias("of"), "n_docs", F.try_divide("target", F.col("source_size").cast("double")).alias("each")), MOST_BROADCAST_ROWS)
    units = units.join(g, units["source"].eqNullSafe(g["of"]))
    base = F.floor("each").cast("bigint")
    h = F.xxhash64(F.lit(seed), "doc_id", "source", "th")
    bucket = F.pmod(h, F.ceil(F.col("n_docs") / fan).cast("bigint"))
    units = units.select("source", bucket.alias("bucket"), F.struct((-F.col("size")).alias("less"), h.alias("h"), F.struct("doc_id", "source", "th").alias("key"), "size", base.alias("base"), (F.col("each") - base).alias("p")).alias("x"))
    buckets = -(-(goals.agg(F.max("n_docs")).first()[0] or 1) // fan)
    whole, level, done = units.where(F.col("x.p") == 0).select("x.key.*", F.col("x.base").alias("copies")), units.where(F.col("x.p") > 0), []
    while True:
        folded = level.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("source", "bucket", _fold(F.col("xs"), seed).alias("f"))
        folded = staged(folded, "pivots")
        done.append(folded.select(F.explode("f.done").alias("d")).select("d.key.*", "d.size", "d.base", "d.up"))
        left = folded.where(F.col("f.one").isNotNull()).select("source", F.floor(F.col("bucket") / fan).alias("bucket"), F.col("f.one").alias("x"))
        if buckets <= 1:
            return whole.unionByName(settled_up(reduce(DataFrame.unionByName, done), left))
        level, buckets = left, -(-buckets // fan)


def settled_up(done: DataFrame, left: DataFrame) -> DataFrame:
    """(doc_id, source, th, copies) of the decided documents and of the one left of each source, with the swap that makes up for rounding it."""
    up = F.round("x.p").cast("bigint")
    roots = staged(left.select("source", F.struct("x.key.*", (F.col("x.base") + up).alias("copies")).alias("root"), ((up - F.col("x.p")) * F.col("x.size")).alias("excess")), "roots")
    of = hinted(roots.select(F.col("source").alias("of"), "excess"), MOST_BROADCAST_ROWS)
    off = F.abs(F.col("size") - F.abs("excess"))
    able = done.join(of, done["source"].eqNullSafe(F.col("of"))).where(((F.col("up") == 1) == (F.col("excess") > 0)) & (off < F.abs("excess")))
    swaps = staged(able.groupBy("source").agg(F.min(F.struct(off.alias("off"), "doc_id", "th")).alias("m")).select(F.col("source").alias("of"), F.col("m.doc_id").alias("of_id"), F.col("m.th").alias("of_th"), F.lit(1).cast("bigint").alias("swap")), "swaps")
    same = done["source"].eqNullSafe(F.col("of")) & done["doc_id"].eqNullSafe(F.col("of_id")) & (done["th"] == F.col("of_th"))
    swapped = done.join(hinted(swaps, MOST_BROADCAST_ROWS), same, "left")
    copies = F.col("base") + F.abs(F.col("up") - F.coalesce("swap", F.lit(0).cast("bigint")))
    return swapped.select("doc_id", "source", "th", copies.alias("copies")).unionByName(roots.select("root.*"))


def mixed(docs: DataFrame, *, seed: int = 17) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, copies, taken): a row for each row of ``docs``."""
    sized = staged(sizes(docs), "sizes")
    goals = staged(targets(sized), "targets")
    chosen = decisions(sized, goals, seed=seed)
    c = chosen.select(F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), F.col("th").alias("c_th"), "copies")
    rows = sized.join(c, sized["doc_id"].eqNullSafe(c["c_id"]) & sized["source"].eqNullSafe(c["c_source"]) & (sized["th"] == c["c_th"]), "left").drop("c_id", "c_source", "c_th")
    g = hinted(goals.select(F.col("source").alias("of"), "source_size", "target"), MOST_BROADCAST_ROWS)
    copies = F.coalesce("copies", F.lit(0).cast("bigint"))
    return rows.join(g, rows["source"].eqNullSafe(g["of"])).select("doc_id", "source", "th", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns; documents without words go."""
    sized = staged(sizes(docs), "sizes")
    c = decisions(sized, staged(targets(sized), "targets"), seed=seed).where(F.col("copies") > 0)
    c = c.select(F.col("doc_id").alias("c_id"), F.col("source").alias("c_source"), F.col("th").alias("c_th"), F.col("copies").alias("c_n"))
    d = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), fingerprint(F.col("text")).alias("d_th"))
    same = d["d_id"].eqNullSafe(c["c_id"]) & d["d_source"].eqNullSafe(c["c_source"]) & (d["d_th"] == c["c_th"])
    return d.join(c, same).select("whole", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c_n")))).select("whole.*")
