"""Quality rules: base counts of a text, and an ordered list of threshold rules learned from labels.

``text_measures`` counts natively inside the row, so a text is read once and never shuffled.  ``learn`` is
sequential covering: it grows a conjunction of thresholds by FOIL gain on two thirds of the labelled rows, prunes
it on the other third, removes the rows that it covers, and goes on.  Labelled rows alone are measured for that, and stored as one row for each different vector of bins
(at most one for each labelled row); the driver sees only histograms of (measures x bins x classes), whatever the size of the corpus.  All documents are
then measured and judged in one pass that stores nothing.

Defined cases: a null text counts as an empty one (no words, ``base_failed``); a null or repeated doc_id is judged
row by row; without usable labels of both classes the list is empty, and only the base rules reject.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.common import hinted, let, n_matching, staged, words

WINDOW = 8
#: Labels up to which they may be broadcast: at about 16 bytes a row, 8 MB.
MOST_BROADCAST_ROWS = 500_000
MEASURES = ("n_words", "mean_word_chars", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share")


def repeated_words(w: Column, k: int = WINDOW) -> Column:
    """How many words of the array ``w`` lie in a window of k words that occurs twice or more in it."""
    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k))))

    def covered(v: Column) -> Column:
        ordered = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, j: (e["h"] == F.get(s, j + 1)["h"]) | (e["h"] == F.get(s, j - 1)["h"])))
        starts = F.sort_array(F.transform(twice, lambda e: e["p"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x))

    found = let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))
    return F.when(F.size(w) > k, found).otherwise(F.lit(0)).cast("long")


def text_measures(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """``docs`` with a struct column ``into``: the base counts, ``base_failed`` and the measures that rules test."""
    t = F.coalesce(F.col(text), F.lit(""))
    bearing = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    raw = docs.withColumns({into: F.struct(words(t).alias("w"), bearing.alias("lines"), F.length(t).alias("chars"))})
    m = F.col(into)
    counts = {
        "n_words": F.size(m["w"]).cast("long"),
        "word_chars": F.aggregate(m["w"], F.lit(0), lambda a, x: a + F.length(x)).cast("long"),
        "n_symbols": n_matching(t, r"#*$%&|<>"),
        "n_dup_lines": (F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))).cast("long"),
        "n_repeat_words": repeated_words(m["w"]),
        "n_lines": F.size(m["lines"]).cast("long"),
        "n_upper": n_matching(t, r"\p{Lu}"),
        "n_marks": n_matching(t, r"!?"),
        "n_distinct": F.size(F.array_distinct(m["w"])).cast("long"),
        "chars": m["chars"].cast("long"),
    }
    counted = raw.withColumns({into: F.struct(*[c.alias(k) for k, c in counts.items()])})

    def share(a: str, b: str) -> Column:
        return F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0))

    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    tested = {
        "n_words": m["n_words"].cast("double"), "mean_word_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "chars"),
        "upper_share": share("n_upper", "chars"), "mark_share": share("n_marks", "chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
    }
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return counted.withColumns({into: F.struct(*[m[c].alias(c) for c in base], failed.alias("base_failed"), F.struct(*[c.alias(k) for k, c in tested.items()]).alias("tested"))})


@dataclass(frozen=True)
class Condition:
    """A measure is at least, or at most, a threshold."""

    measure: str
    at_least: bool
    threshold: float
    bin: int = 0

    def on(self, values: Column) -> Column:
        return values[self.measure] >= F.lit(self.threshold) if self.at_least else values[self.measure] < F.lit(self.threshold)

    def binned(self) -> Column:
        return F.col(self.measure) >= self.bin if self.at_least else F.col(self.measure) < self.bin


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects.  ``verdict`` is one Spark CASE expression."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, values: Column) -> Column:
        """True where no rule rejects."""
        case = None
        for rule in self.rules:
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.on(values)
            case = F.when(holds, F.lit(False)) if case is None else case.when(holds, F.lit(False))
        return F.lit(True) if case is None else case.otherwise(F.lit(True))

    def rule_of(self, values: Column) -> Column:
        """The number of the rule that rejects, from 1; null where none does."""
        case = F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.on(values)
            case = F.when(holds, F.lit(n)).otherwise(case)
        return case

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.measure} {'>=' if c.at_least else '<'} {c.threshold:g}" for c in rule) for rule in self.rules]


def learn(labelled: DataFrame, measures: tuple[str, ...] = MEASURES, *, bad: str = "bad", bins: int = 24, most_rules: int = 8, most_conditions: int = 3, least_precision: float = 0.9, least_share: float = 0.005) -> DecisionList:
    """The decision list for rows ``(row, bad boolean, <measures> double)``; rows with a null ``bad`` don't count.

    ``least_precision``: a rule must reach it on the rows it was not grown on.  ``least_share``: of the bad rows, that a
    rule must cover.  The driver holds histograms of fixed size, never rows.
    """
    known = labelled.where(F.col(bad).isNotNull())
    cuts_of = known.agg(*[F.percentile_approx(m, [i / bins for i in range(1, bins)], 2000).alias(m) for m in measures], *[F.percentile_approx(F.when(F.col(bad), F.col(m)), [i / bins for i in range(1, bins)], 2000).alias(f"{m} bad") for m in measures]).first()
    cuts = {m: sorted({*(cuts_of[m] or ()), *(cuts_of[f"{m} bad"] or ())}) for m in measures}
    if not any(cuts.values()):
        return DecisionList()
    binned = known.select(
        F.col(bad).alias("bad"), (F.pmod(F.xxhash64("row"), F.lit(3)) == 0).alias("prune"),
        *[_bin(m, cuts[m]).alias(m) for m in measures],
    )
    rows = staged(binned.groupBy(*binned.columns).agg(F.count("*").alias("n")), "rule-bins")

    def histogram(where: Column) -> dict[tuple[str, int], list[int]]:
        cells = rows.where(where & ~F.col("prune")).select("bad", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in measures])).alias("c"))
        out: dict[tuple[str, int], list[int]] = {}
        for r in cells.groupBy("c.measure", "c.bin").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("n")).collect():
            out[r["measure"], r["bin"]] = [r["p"], r["n"]]
        return out

    left, rules, all_bad = F.lit(True), [], None
    while len(rules) < most_rules:
        rule: list[Condition] = []
        inside = left
        while len(rule) < most_conditions:
            cells = histogram(inside)
            p0, n0 = (sum(v[i] for (m, _), v in cells.items() if m == measures[0]) for i in (0, 1))
            all_bad = p0 if all_bad is None else all_bad
            if not p0 or not n0:
                break
            best, most = None, 0.0
            for m in measures:
                for at in range(1, len(cuts[m]) + 1):
                    up = [sum(v[i] for (x, b), v in cells.items() if x == m and b >= at) for i in (0, 1)]
                    for at_least, (p, n) in ((True, up), (False, [p0 - up[0], n0 - up[1]])):
                        if p and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > most + 1e-9:
                            best, most = Condition(m, at_least, float(cuts[m][at - 1]), at), gain
            if best is None:
                break
            rule.append(best)
            inside = inside & best.binned()
        if not rule:
            break
        rule = _pruned(rows, left, rule)
        holds = left
        for c in rule:
            holds = holds & c.binned()
        seen = rows.where(holds).agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("all"), F.sum(F.when(F.col("prune") & F.col("bad"), F.col("n")).otherwise(0)).alias("pp"), F.sum(F.when(F.col("prune"), F.col("n")).otherwise(0)).alias("pall")).first()
        of = (seen["pp"], seen["pall"]) if (seen["pall"] or 0) >= 10 else (seen["p"], seen["all"])
        if not of[1] or of[0] / of[1] < least_precision or seen["p"] < least_share * (all_bad or 1):
            break
        rules.append(rule)
        out = F.lit(True)
        for c in rule:
            out = out & c.binned()
        left = left & ~out
    return DecisionList(rules)


def _bin(measure: str, cuts: list[float]) -> Column:
    """How many of the cuts a measure reaches."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col(measure) >= c))


def _pruned(rows: DataFrame, left: Column, rule: list[Condition]) -> list[Condition]:
    """The leading part of the rule with the best (p - n) / (p + n) on the pruning rows; the shorter at a tie."""
    if len(rule) == 1:
        return rule
    holds, sums = left & F.col("prune"), []
    for i, c in enumerate(rule):
        holds = holds & c.binned()
        sums += [F.sum(F.when(holds & F.col("bad"), F.col("n")).otherwise(0)).alias(f"p{i}"), F.sum(F.when(holds, F.col("n")).otherwise(0)).alias(f"all{i}")]
    got = rows.agg(*sums).first()
    worth = [(2 * (got[f"p{i}"] or 0) - got[f"all{i}"]) / got[f"all{i}"] if got[f"all{i}"] else -1.0 for i in range(len(rule))]
    return rule[: worth.index(max(worth)) + 1]


def labelled_measures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures of the labelled rows, for ``learn``; a doc_id with several labels counts with the lowest.  Texts without a label are not measured."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return text_measures(docs.select("doc_id", "text").join(hinted(known, MOST_BROADCAST_ROWS), "doc_id")).select(F.col("doc_id").alias("row"), "bad", "measures.tested.*").select("row", "bad", *MEASURES)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: its id, the base counts, ``base_failed``, ``rule`` and ``kept``."""
    rules = learn(staged(labelled_measures(docs, labels), "labelled-measures"))
    m = F.col("measures")
    rule = F.when(~m["base_failed"], rules.rule_of(m["tested"]))
    kept = ~m["base_failed"] & rules.verdict(m["tested"])
    measured = text_measures(docs.select("doc_id", "text"))
    return measured.select("doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], kept.alias("kept"), rule.alias("rule"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that base rules and learned rules keep, with all their columns and no others."""
    rules = learn(staged(labelled_measures(docs, labels), "labelled-measures"))
    m = F.col("measures")
    measured = text_measures(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    # a filter would be pushed below the measures and compute them again for each rule; an exploded array is not
    kept = F.explode(F.when(~m["base_failed"] & rules.verdict(m["tested"]), F.array("row")))
    return measured.select(kept.alias("row")).select("row.*")
