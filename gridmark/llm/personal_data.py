"""Personal data: strict base patterns, and more spans that boosted trees select among overlapping candidates.

1. ``found`` reads each text once: the base spans (``PATTERNS``, then ``valid``), and the runs that wider patterns match (``WIDE`` and ``WINDOWS``: other
   separators, spelt-out signs, missing prefixes).  A window pattern matches at every group of digits, so that a longer wrong span hides no right one.
2. ``candidates`` proposes spans in each run: for cards each number of digits in ``SIZES``, for phones each end of a group, for IPv4 addresses four groups.
   ``free_candidates`` leaves those that touch no base span; it sorts both by place and carries the furthest end of a base span along.
3. ``fit`` has no labels of its own, and doesn't learn the base patterns back: it writes all base spans in other ways (``_rewritten``: spelt-out or spaced signs,
   other separators, no prefix, other numbering) and spoils them (broken check digits, octets over 255, dates, prose), in their own surroundings.  What the
   generators propose there, and all other numbers of the documents, are the examples; the sign and the plus that define base spans are no features.  Examples of
   equal features are counted together, and weights set how much each kind of span, and the other numbers, count as a whole.  Thresholds come from spans that the
   trees haven't seen: the lowest with the asked precision; a kind with fewer than ``LEAST_HELD_OUT`` of them takes that of all kinds together.
4. ``added``: the candidates above their kind's threshold; of overlapping ones the likeliest stays, then the longest, and what it doesn't touch is judged anew.

Positions are code points, ends exclusive: the pieces between the matches of a pattern have the lengths that the positions sum up.
Repeated groups in the patterns are possessive where nothing can follow, so long runs need no stack.  All steps are linear in the text: windows and
candidates of a window are bounded, and overlaps are settled in cells of ``CELL`` characters.

Defined cases: null and empty texts have no spans; rows that share an id are told apart by their text, equal rows have equal results; where no base span of
any kind is in the documents nothing is learnt and nothing added.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.common import fingerprint, let, staged

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Looking back for the rest of a run skips starts inside a run that has failed from its first character.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: IPv6 with "::" for the groups left out: at most seven on both sides together, and at least one; an IPv4 end belongs to it.
COMPRESSED = (
    r"(?<![0-9A-Za-z:.])(?!:{0,2}[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){7})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+)?+|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)"
    r"(?:(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))?(?![0-9A-Za-z]|:[0-9A-Za-z:])"
)
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": rf"{COMPRESSED}|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{{1,4}}:){{3,7}}+[0-9A-Fa-f]{{1,4}}",
}
#: Patterns of no width: at each group of digits the longest run that may hold a span, and the character after it.
WINDOWS = {
    "ip": r"(?<![0-9])(?=([0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])[\s\S]?))",
    "card": r"(?<![0-9])(?=([0-9](?:[\x20./-]{0,2}[0-9]){11,18}[\s\S]?))",
    "phone": r"(?:(?=[+(][0-9])|(?<![0-9+(])(?=[0-9]))(?=([+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,17}[\s\S]?))",
}
#: The least and most digits of a card and a phone number; two more after "00".
SIZES = {"card": (12, 19), "phone": (7, 16)}
CUES = {"email": r"(?i)(?:e-?mail|contact|write)\W*\w*\W*$", "ip": r"(?i)(?:\bip|address|host|server)\W*\w*\W*$", "card": r"(?i)(?:card|visa|account|payment)\W*\w*\W*$", "phone": r"(?i)(?:call|tel|phone|mobile|fax)\W*\w*\W*$"}
FEATURES = ("kind", "n_chars", "n_digits", "n_letters", "n_seps", "n_dots", "n_colons", "n_groups", "longest_group", "luhn", "octets", "spelt", "ending", "zero_first", "cue", "sign_before", "alnum_before", "alnum_after")
CONTEXT, CHUNK, CELL, LEAST_HELD_OUT = 32, 256, 64, 20
#: Rewritten spans that a task reads: they are short, so files of them would be merged into few tasks.
TASK_SPANS = 20_000
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\x20?\.\x20?|$)){4}$"
SPAN = "array<struct<start:int,end:int>>"
RUN = "array<struct<kind:int,form:string,start:int,s:string,before:string,after:string>>"


def _starts(lengths: Column) -> Column:
    """The sums of all lengths before each; summed by chunks, and chunks by chunks of sums, so long arrays aren't copied for each item."""

    def scan(values: Column, first: Column) -> Column:
        begin = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, begin, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        return let(scan(sums, F.lit(0)), lambda s: F.flatten(F.transform(chunks, lambda c, i: scan(c, F.get(s, i)))))

    return let(lengths, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a pattern: an array of (start, end, s, before, after)."""

    def build(both: Column) -> Column:
        steps = F.transform(both["m"], lambda s, i: F.length(F.get(both["between"], i)) + F.length(s))
        return let(_starts(steps), lambda at: F.transform(both["m"], lambda s, i: let(F.get(at, i) + F.length(F.get(both["between"], i)), lambda start: F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"), F.right(F.get(both["between"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(both["between"], i + 1), F.lit(1)).alias("after")))))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between")), build)


def windows(text: Column, pattern: str) -> Column:
    """The matches of a pattern of no width: an array of (start, s, before), ``s`` what its group took."""

    def build(both: Column) -> Column:
        return let(_starts(F.transform(both["between"], lambda s: F.length(s))), lambda at: F.transform(both["m"], lambda s, i: F.struct((F.get(at, i + 1) - 1).alias("start"), s.alias("s"), F.right(F.array_join(F.transform(F.slice(both["between"], F.greatest(i - 6, F.lit(1)), F.least(i + 1, F.lit(8))), lambda x: F.right(x, F.lit(CONTEXT))), ""), F.lit(CONTEXT)).alias("before"))))

    led = F.concat(F.lit("\n"), text)  # so that no match is at the beginning
    return let(F.struct(F.regexp_extract_all(led, F.lit(pattern), F.lit(1)).alias("m"), F.split(led, pattern, -1).alias("between")), build)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check; strings of over 24 digits don't count as passing."""

    def total(r: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.substring(r, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(r)), value), F.lit(0), lambda a, x: a + x)

    return F.when(F.length(d).between(1, 24), let(F.reverse(d), total) % 10 == 0).otherwise(F.lit(False))


def valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(s, F.lit(OCTETS))
    if kind == "card":
        return let(digits(s), lambda d: F.length(d).between(16, 19) & luhn(d))
    return F.length(digits(s)).between(8, 15)


def _valid(matches: Column, kind: str) -> Column:
    return F.filter(matches, lambda x: valid(kind, x["s"]))


def _read(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the base spans of each kind, ``examples`` (the base spans with their text and surroundings) and ``runs``."""
    digit = F.rlike(text, F.lit("[0-9]"))
    may = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    # No gate is narrower than its pattern: each wide e-mail address has one of the signs for "at".
    wide = {"email": may["email"] | F.rlike(text, F.lit(r"[\[(]at[\])]|\x20at\x20")), "ip": F.contains(text, F.lit(":"))}
    out = docs.withColumns({f"{k} spans": F.when(may[k], _valid(spans(text, PATTERNS[k]), k)) for k in KINDS})
    pair = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    base = {k: F.coalesce(F.transform(f"{k} spans", pair), F.array().cast(SPAN)) for k in KINDS}

    def example(n: int):
        return lambda x: F.struct(F.lit(n).alias("kind"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"))

    examples = [F.coalesce(F.transform(f"{k} spans", example(n)), F.array().cast("array<struct<kind:int,s:string,before:string,after:string>>")) for n, k in enumerate(KINDS)]

    def run(n: int, form: str):
        return lambda x: F.struct(F.lit(n).alias("kind"), F.lit(form).alias("form"), x["start"].alias("start"), x["s"].alias("s"), x["before"].alias("before"), (x["after"] if form == "whole" else F.lit(None).cast("string")).alias("after"))

    runs = [F.when(wide[k], F.transform(spans(text, WIDE[k]), run(KINDS.index(k), "whole"))) for k in WIDE] + [F.when(digit, F.transform(windows(text, WINDOWS[k]), run(KINDS.index(k), k))) for k in WINDOWS]
    out = out.withColumns({**base, "examples": F.concat(*examples), "runs": F.concat(*[F.coalesce(r.cast(RUN), F.array().cast(RUN)) for r in runs])})
    return out.drop(*[f"{k} spans" for k in KINDS])


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, th, <kind>: base spans (start, end) for each kind, examples, runs): a row for each row of ``docs``."""
    rows = docs.select("doc_id", fingerprint(F.col("text")).alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return _read(rows, F.col("text")).drop("text")


def proposed(rows: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, kind, start, end, s, before, after): the spans that generators propose in ``runs``."""
    r = rows.select(*keep, F.explode("runs").alias("r")).select(*keep, "r.*")
    whole = r.where("form = 'whole'").select(*keep, "kind", "start", (F.col("start") + F.length("s")).alias("end"), "s", "before", "after")
    chars = F.split("s", "")
    d = r.where("form <> 'whole'").withColumn("at", F.filter(F.sequence(F.lit(0), F.length("s") - 1), lambda i: F.get(chars, i).between("0", "9")))
    at = F.col("at")
    ended = lambda n: (n >= F.size(at)) | (F.get(at, n) > F.get(at, n - 1) + 1)
    zeros = F.rlike("s", F.lit(r"^[+(]?0[\x20()./-]{0,2}0"))
    longest = F.when(zeros, SIZES["phone"][1] + 2).otherwise(SIZES["phone"][1])
    sizes = {k: F.filter(F.array(*[F.lit(n) for n in range(SIZES[k][0], SIZES[k][1] + 3)]), lambda n: n <= F.size(at)) for k in SIZES}
    cards = F.filter(sizes["card"], lambda n: n <= SIZES["card"][1])
    phones = F.filter(sizes["phone"], lambda n: (n == longest) | ((n < longest) & ended(n)))
    of_form = F.when(F.col("form") == "card", cards).when(F.col("form") == "phone", phones).otherwise(F.array(F.size(at)))
    d = d.withColumn("n", F.explode(of_form)).withColumn("length", F.get(at, F.col("n") - 1) + 1)
    d = d.select(*keep, "kind", "start", (F.col("start") + F.col("length")).alias("end"), F.substring("s", F.lit(1), F.col("length")).alias("s"), "before", F.substring("s", F.col("length") + 1, F.lit(1)).alias("after"))
    return whole.union(d)


def candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end, s, before, after) for ``found`` rows; rows that occur several times count once."""
    return proposed(rows.where(F.size("runs") > 0).dropDuplicates(["doc_id", "th"]), "doc_id", "th")


def free_candidates(rows: DataFrame) -> DataFrame:
    """The candidates that touch no base span of their document."""
    own = candidates(rows).withColumns({"place": F.col("end"), "reach": F.lit(None).cast("int")})
    base = rows.where(F.size(F.concat(*KINDS)) > 0).select("doc_id", "th", F.explode(F.concat(*KINDS)).alias("b")).select("doc_id", "th", F.col("b.start").alias("place"), F.col("b.end").alias("reach")).distinct()
    before = Window.partitionBy("doc_id", "th").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(base, allowMissingColumns=True).withColumn("furthest", F.max("reach").over(before))
    return both.where(F.col("kind").isNotNull() & ~F.coalesce(F.col("furthest") > F.col("start"), F.lit(False))).drop("place", "reach", "furthest")


def measured(spans: DataFrame) -> DataFrame:
    """``spans`` with the columns of ``FEATURES``, and ``unsure``: whether content or context speaks for a span."""
    s, d = F.col("s"), digits(F.col("s"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    of_kind = lambda by: F.element_at(F.array(*[by[k] for k in KINDS]), F.col("kind") + 1)
    cue = of_kind({k: F.rlike("before", F.lit(CUES[k])) for k in KINDS})
    unsure = of_kind({"email": F.rlike(s, F.lit(r"[\[(]at[\])]")), "ip": cue | F.rlike(s, F.lit(r"::|^(?:[0-9A-Fa-f]+:){7}")), "card": luhn(d) & F.length(d).between(16, 19), "phone": cue})
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]+", ""))
    columns = {
        "n_chars": F.length(s), "n_digits": F.length(d), "n_letters": letters, "n_seps": F.length(s) - F.length(d) - letters, "n_dots": F.regexp_count(s, F.lit(r"\.")), "n_colons": F.regexp_count(s, F.lit(":")),
        "n_groups": F.regexp_count(s, F.lit("[0-9]+")), "longest_group": F.array_max(F.transform(F.split(s, "[^0-9]+", -1), lambda x: F.length(x))), "luhn": flag(luhn(d)), "octets": flag(F.rlike(s, F.lit(OCTETS))),
        "spelt": flag(F.rlike(s, F.lit(r"(?:[\[(]|\x20)(?:at|dot)(?:[\])]|\x20)"))), "ending": flag(F.rlike(s, F.lit(r"[^A-Za-z][a-z]{2,4}$"))), "zero_first": flag(F.rlike(s, F.lit(r"^[+(]?0"))), "cue": flag(cue),
        "sign_before": flag(F.rlike("before", F.lit(r"[#$€£=_/.:-]$"))), "alnum_before": flag(F.rlike("before", F.lit("[A-Za-z0-9]$"))), "alnum_after": flag(F.rlike(F.coalesce("after", F.lit("")), F.lit("[A-Za-z0-9]"))),
    }
    return spans.withColumns({k: c.cast("double") for k, c in columns.items()} | {"unsure": unsure})


def _rewritten(s: Column, kind: str) -> Column:
    """Other ways to write a base span, and spans spoilt: an array of (s, size, good), ``size`` the length of the span that ``s`` begins with."""
    d = digits(s)
    local, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)

    def grouped(x: Column, sep: str) -> Column:
        return F.regexp_replace(x, "(?<=^(?:[0-9]{4}){1,4})(?=[0-9])", sep)

    octet = [F.split_part(s, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    hexes = [F.lower(F.hex(o)) for o in octet]
    broken = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    bare = F.regexp_replace(s, r"^\+", "")
    national = F.regexp_replace(s, r"^\+[0-9]+[\x20.-]*", "")
    ways = {
        "email": (
            [F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in ((" [at] ", "."), ("(at)", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "(dot)"), ("@", " dot "))],
            [F.concat(F.lit("meet at "), F.substring(F.crc32(local).cast("string"), 1, 2), F.lit(".30")), F.concat(F.substring_index(local, ".", 1), F.lit(" at version 2.0")), F.concat(F.substring_index(local, ".", 1), F.lit(" at home.Then")), F.concat(F.substring_index(local, ".", 1), F.lit(" at "), F.substring_index(host, ".", 1), F.lit(".However"))],
        ),
        "ip": (
            [F.replace(s, F.lit("."), F.lit(" . ")), F.replace(s, F.lit("."), F.lit(". ")), F.concat(F.lit("fd00:"), hexes[0], F.lit("::"), hexes[1], F.lit(":"), hexes[2]), F.concat(F.lit("2001:db8:"), F.concat_ws(":", *hexes), F.lit(":0:1")), F.concat(F.lit("::ffff:"), hexes[0], F.lit(":"), hexes[3])],
            [F.concat_ws(".", octet[0] + 256, *octet[1:]), F.concat_ws(" . ", octet[0], octet[1] + 300, octet[2], octet[3]), F.concat_ws(":", *[F.lpad(o % 24, 2, "0") for o in octet]), F.concat_ws(". ", *octet[:3], octet[3] + 256)],
        ),
        "card": (
            [grouped(d, sep) for sep in (".", "/", ". ", " - ")] + [F.concat(grouped(d, "."), F.lit(" 12/27"))],
            [broken] + [grouped(broken, sep) for sep in (".", "/", ". ", " - ", " ")],
        ),
        "phone": (
            [F.concat(F.lit("00"), bare), national, F.btrim(F.regexp_replace(national, r"[\x20()-]+", "."), F.lit(".")), F.concat(F.lit("(0"), F.substring(d, 3, 3), F.lit(") "), F.substring(d, 6, 7)), F.concat(F.lit("0"), F.substring(d, 3, 3), F.lit("/"), F.substring(d, 6, 7))],
            [d, F.substring(d, 1, 9), F.concat(F.lit("20"), F.substring(d, 1, 2), F.lit("-0"), F.substring(d, 3, 1), F.lit("-1"), F.substring(d, 4, 1), F.lit(" 10")), F.concat(F.substring(d, 1, 2), F.lit("."), F.substring(d, 3, 8)), F.concat_ws(" ", F.substring(d, 1, 1), F.substring(d, 2, 3), F.substring(d, 5, 3)), F.concat_ws("/", F.substring(d, 1, 4), F.substring(d, 5, 4))],
        ),
    }

    good, bad = ways[kind]
    written = [(F.coalesce(x, F.lit("")), g) for g, each in ((True, good), (False, bad)) for x in each]
    return F.array(*[F.struct(x.alias("s"), F.length(F.regexp_replace(x, " 12/27$", "")).alias("size"), F.lit(g).alias("good")) for x, g in written])


def examples(rows: DataFrame, spans_weigh: int = 300, others_weigh: int = 5000) -> DataFrame:
    """The examples that ``fit`` learns from, all of them: FEATURES, y, ``part``: whether the trees may see them, their number ``n``, and their ``weight`` together.

    ``spans_weigh``: at most what all base spans of a kind weigh.  ``others_weigh``: at most what all other numbers of the documents weigh.  A span or number weighs 1 at most.
    """
    spans_ = rows.where(F.size("examples") > 0).select(F.explode("examples").alias("e")).select("e.*").where(F.length("s") <= CELL)
    part = F.pmod(F.xxhash64(F.xxhash64("s"), F.lit(2)), F.lit(10)) < 7
    taken = staged(spans_.groupBy("kind", "s", "before", "after").agg(F.count("*").alias("n")).withColumn("part", part), "base-spans")
    n = {r["kind"]: r["n"] for r in taken.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    by_kind = [taken.where(F.col("kind") == i).select(F.col("kind").alias("of"), "before", "after", "part", "n", F.explode(_rewritten(F.col("s"), k)).alias("w")) for i, k in enumerate(KINDS)]
    written = staged(functools.reduce(DataFrame.union, by_kind), "rewritten-spans")
    made = written.repartition(max(1, math.ceil(written.count() / TASK_SPANS))).select("of", "part", "n", F.col("w.good").alias("good"), F.length("before").alias("t_start"), (F.length("before") + F.col("w.size")).alias("t_end"), F.concat("before", "w.s", F.coalesce("after", F.lit("")), F.lit(" ")).alias("text"))
    made = proposed(_read(made, F.col("text")), "of", "part", "n", "good", "t_start", "t_end")
    right = F.col("good") & (F.col("of") == F.col("kind")) & (F.col("start") == F.col("t_start")) & (F.col("end") == F.col("t_end"))
    made = measured(made).select("of", *FEATURES, right.cast("double").alias("y"), "part", "n")
    others = staged(free_candidates(rows), "other-candidates")
    rest = measured(others).where("NOT unsure").select(F.lit(len(KINDS)).alias("of"), *FEATURES, F.lit(0.0).alias("y"), (F.pmod(F.xxhash64("s"), F.lit(10)) < 7).alias("part"), F.lit(1).cast("long").alias("n"))
    whole = [spans_weigh / max(n.get(k, 1), 1) for k in range(len(KINDS))] + [others_weigh / max(others.count(), 1)]
    each = F.element_at(F.array(*[F.lit(min(1.0, w)) for w in whole]), F.col("of") + 1)
    alike = made.union(rest).withColumn("kind", F.col("kind").cast("double")).groupBy("of", "part", "y", *FEATURES).agg(F.sum("n").alias("n"))
    return alike.withColumn("weight", F.col("n") * each).drop("of")


@dataclass(frozen=True)
class Model:
    """``thresholds`` by kind; ``held_out``: for each kind precision and recall on rewritten spans that the trees haven't seen, and their number."""

    steps: tuple[Transformer, ...]
    thresholds: tuple[float, ...]
    held_out: dict[str, tuple[float, float, int]]


def fit(rows: DataFrame, *, precision: float = 0.99, spans_weigh: int = 300, others_weigh: int = 5000) -> Model | None:
    """Trees and thresholds from staged ``found`` rows, all of them; None without a base span to rewrite."""
    every = staged(examples(rows, spans_weigh, others_weigh), "examples")
    n = {(r["part"], r["y"]): r["n"] for r in every.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    if not n.get((True, 1.0)) or not n.get((True, 0.0)):
        return None
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    ready = assemble.transform(every).select("part", "kind", "y", "vector", "n", "weight")
    trees = GBTClassifier(featuresCol="vector", labelCol="y", weightCol="weight", maxIter=15, maxDepth=5, stepSize=0.3, seed=3).fit(ready.where("part"))
    share = trees.transform(ready.where("NOT part")).select("kind", "y", "n", "weight", F.floor(vector_to_array("probability")[1] * 100).cast("int").alias("bin"))
    sums = [F.sum(F.col("y") * F.col("weight")).alias("good"), F.sum("weight").alias("all"), F.sum(F.col("y") * F.col("n")).alias("n")]
    cells = [(int(r["kind"]), r["bin"], r["good"], r["all"], r["n"]) for r in share.groupBy("kind", "bin").agg(*sums).collect()]

    def chosen(kinds: set[int]) -> tuple[float, float, float, int]:
        """The threshold, its precision and recall by weight, and how many rewritten spans there are."""
        own = [c for c in cells if c[0] in kinds]
        right, number = sum(c[2] for c in own), sum(c[4] for c in own)
        best, rate, recall, good, taken = 1.0, 1.0, 0.0, 0.0, 0.0
        for at in range(100, 49, -1):
            good, taken = good + sum(c[2] for c in own if c[1] == at), taken + sum(c[3] for c in own if c[1] == at)
            if taken and good / taken >= precision:
                best, rate, recall = at / 100, good / taken, good / (right or 1)
        return best, rate, recall, int(number)

    own, together = [chosen({k}) for k in range(len(KINDS))], chosen(set(range(len(KINDS))))
    return Model((assemble, trees), tuple(c[0] if c[3] >= LEAST_HELD_OUT else together[0] for c in own), {k: c[1:] for k, c in zip(KINDS, own, strict=True)})


def redactions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<kind> of the base spans, base_sha256, spans, n_added) for each row of ``docs``."""
    rows = staged(found(docs.select("doc_id", "text")), "personal-data")
    model = fit(rows)

    def written(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    base = F.array_join(F.concat(*[written(F.col(k), k) for k in KINDS]), ",")
    out = rows.select("doc_id", "th", *KINDS, base.alias("base"))
    if model is None:
        out = out.withColumn("added", F.lit(None).cast("array<struct<kind:int,start:int,end:int>>"))
    else:
        a = added(rows, model).groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
        a = a.select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), "added")
        out = out.join(a, out["doc_id"].eqNullSafe(a["a_id"]) & (out["th"] == a["a_th"]), "left")
    both = [F.sort_array(F.concat(F.col(k), F.coalesce(_of_kind(F.col("added"), n), F.array().cast(SPAN)))) for n, k in enumerate(KINDS)]
    every = F.array_join(F.concat(*[written(s, k) for s, k in zip(both, KINDS, strict=True)]), ",")
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2("base", 256).alias("base_sha256"), every.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def _of_kind(added: Column, number: int) -> Column:
    return F.transform(F.filter(added, lambda x: x["kind"] == number), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def likely(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, kind, start, end, p): the candidates above their kind's threshold that touch no base span."""
    assemble, trees = model.steps
    out = trees.transform(assemble.transform(measured(free_candidates(rows)).withColumn("of", F.col("kind")).withColumn("kind", F.col("kind").cast("double"))))
    out = out.select("doc_id", "th", F.col("of").alias("kind"), "start", "end", vector_to_array("probability")[1].alias("p"))
    return out.where(F.col("p") >= F.element_at(F.array(*[F.lit(float(t)) for t in model.thresholds]), F.col("kind") + 1))


def added(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, kind, start, end): of overlapping likely candidates the likeliest.

    In each round those stay that no overlapping one beats; equal ones are ranked by length and then by a hash, so that few rounds settle long chains.
    """
    key = ["doc_id", "th", "kind", "start", "end"]
    rank = F.struct("p", F.col("end") - F.col("start"), F.xxhash64("start", "end", "kind"))
    left, out = staged(likely(rows, model).withColumn("rank", rank), "likely"), None
    while not left.isEmpty():
        cells = left.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))
        met = cells.groupBy("doc_id", "th", "cell").agg(F.collect_list(F.struct("start", "end", "kind", "rank")).alias("all"))
        over = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
        beaten = met.select("doc_id", "th", F.explode(F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.exists("all", lambda y: over(x, y) & (y["rank"] > x["rank"])).alias("lost")))).alias("c")).select("doc_id", "th", "c.*").groupBy(*key).agg(F.max("lost").alias("lost"))
        best = staged(beaten.where("NOT lost").select(*key), "best")
        out = best if out is None else out.union(best)
        taken = best.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)))).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "cell", F.col("start").alias("b"), F.col("end").alias("e"))
        touched = cells.join(taken, cells["doc_id"].eqNullSafe(taken["d"]) & (cells["th"] == taken["h"]) & (cells["cell"] == taken["cell"]) & (cells["start"] < taken["e"]) & (taken["b"] < cells["end"]), "left_anti").groupBy(*key, "p", "rank").agg(F.count("*").alias("n"))
        left = staged(touched.where(F.col("n") == F.floor((F.col("end") - 1) / CELL) - F.floor(F.col("start") / CELL) + 1).drop("n"), "left")
    none = rows.select("doc_id", "th", *[F.lit(0).alias(c) for c in key[2:]]).limit(0)
    return none if out is None else out
