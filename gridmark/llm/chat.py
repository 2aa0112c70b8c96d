"""Chat formatting of reply trees.

A message names the one that it answers.  ``lifts`` doubles the distance to an ancestor in each self-join and sums the scores on the way; branches are ranked
by that sum for their leaf.  ``paths`` then enumerates the chosen root-to-leaf paths: it takes each ancestor from the widest distance to the
narrowest, so log2(depth) joins reach every message of a path once.  ``formatted`` writes each chosen path as one conversation.

The template is ``<|im_start|>role LF text <|im_end|> LF``.  Inside roles and texts every ``<``, backslashes, ``|`` gets one more
backslash, so no control string of a text survives and ``unescaped`` takes exactly that one away.

Defined cases: a null text or role is an empty one; rows of equal turn follow in the order of role and text, nulls first, and each is a
message; a null conv_id is a conversation; a message whose parent is missing starts a path; messages on a cycle of answers, and those
that answer them, have no root and belong to no path; of rows with the same conv_id and msg_id the least counts (``one_row_each``), and each row with a null msg_id is a
message of its own that none can answer; null scores and those that aren't numbers count 0; columns other than those of ``TREE`` are not looked at; no rows give no rows.  One conversation is one row, so it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.common import let, staged

START, END = "<|im_start|>", "<|im_end|>\n"
TREE = ("conv_id", "msg_id", "parent_id", "role", "text", "score")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def role_line(role: Column) -> Column:
    """A role on one line: its backslashes and line feeds are written as two characters each."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_of(line: Column) -> Column:
    pieces = F.split(unescaped(line), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def reply_chain(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a tree in which each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    return rows.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def one_row_each(messages: DataFrame) -> DataFrame:
    """``messages`` with one row for each conv_id and msg_id: the least by parent, role, text and score, nulls first.

    Rows with a null msg_id all stay.  They get the numbers after all ids that their conversation names, so none of its messages answers them.
    """
    rest = ("parent_id", "role", "text", "score")
    messages = messages.select(*TREE)
    if messages.schema["msg_id"].nullable:
        named = messages.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max(F.greatest("msg_id", "parent_id")), F.lit(0)).alias("last"))
        nameless = messages.where(F.col("msg_id").isNull())
        nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*rest))
        nameless = nameless.join(named, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", (F.col("last") + nth).cast("long").alias("msg_id"), *rest)
        messages = messages.where(F.col("msg_id").isNotNull()).unionByName(nameless)
    return messages.groupBy("conv_id", "msg_id").agg(F.min(F.struct(*rest)).alias("m")).select("conv_id", "msg_id", *[F.col(f"m.{c}").alias(c) for c in rest]).select(*TREE)


def lifts(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For each k the table (conv_id, node, up, gain) of the messages with an ancestor 2^k above: it, and the scores on the way to below it; and the
    messages whose way to a root is known, with the score of their whole path as ``gain``.

    Each table joins the one before with what is known of the ancestors; a message whose way has ended is joined no more.  Messages above or on a cycle never end.
    """
    known = messages.select("conv_id", F.col("msg_id").alias("node"), F.col("parent_id").alias("p"), F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("gain"))
    m = messages.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("up"))
    now = staged(known.join(m, known["conv_id"].eqNullSafe(m["c"]) & (known["p"] == m["up"]), "left").select("conv_id", "node", "up", "gain"), "lift")
    most, out, ended = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0, [now.where("up IS NOT NULL")], now.where("up IS NULL")
    while 1 << len(out) - 1 < most and not out[-1].isEmpty():
        b = out[-1].union(ended).select(F.col("conv_id").alias("c"), F.col("node").alias("mid"), F.col("up").alias("far"), F.col("gain").alias("more"))
        further = out[-1].join(b, out[-1]["conv_id"].eqNullSafe(b["c"]) & (out[-1]["up"] == b["mid"]))
        now = staged(further.select("conv_id", "node", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain")), "lift")
        out.append(now.where("up IS NOT NULL"))
        ended = ended.union(now.where("up IS NULL"))
    return out, ended


def paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, leaf, place, node, back): the messages of each chosen path, ``back`` steps above its leaf.

    ``place``: the path's rank in its conversation by the sum of its scores, then by leaf.  ``keep``: how many paths of each to take; None for all.
    Leaves are ranked by what ``lifts`` summed up for them, and only chosen paths are enumerated.  ``messages``: one row each.
    """
    ups, rooted = lifts(messages)
    parents = messages.where(F.col("parent_id").isNotNull()).select(F.col("conv_id").alias("c"), F.col("parent_id").alias("p")).distinct()
    leaves = rooted.join(parents, rooted["conv_id"].eqNullSafe(parents["c"]) & (rooted["node"] == parents["p"]), "left_anti")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.nanvl("gain", F.lit(0.0)).desc(), "node"))
    chosen = leaves.select("conv_id", F.col("node").alias("leaf"), place.alias("place"), "node", F.lit(0).cast("long").alias("back"))
    on = chosen if keep is None else chosen.where(F.col("place") <= keep)
    for k in range(len(ups) - 1, -1, -1):
        up = ups[k].select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        further = on.join(up, on["conv_id"].eqNullSafe(up["c"]) & (on["node"] == up["n"])).select("conv_id", "leaf", "place", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        on = staged(on.union(further), "paths")  # else each step would hold the plan of the one before twice
    return on


def formatted(messages: DataFrame, keep: int | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, place, formatted, loss): one row for each chosen path of ``messages`` (``TREE``).

    ``loss``: the ranges (start, end) of code points that carry loss, the escaped texts of roles in ``learn``.
    """
    messages = staged(one_row_each(messages), "messages")
    on = paths(messages, keep)
    m = messages.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.coalesce("role", F.lit("")).alias("role"), escaped(F.col("text")).alias("body"))
    rows = on.join(m, on["conv_id"].eqNullSafe(m["c"]) & (on["node"] == m["m"]))
    head = F.concat(F.lit(START), role_line(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "place", "back", head.alias("head"), "body", F.col("role").isin(*learn).alias("learnt"))
    size = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("conv_id", "place").orderBy(F.col("back").desc())
    rows = rows.withColumn("at", F.sum(size).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size + F.length("head"))
    rows = rows.groupBy("conv_id", "place").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at_turn"), F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("learnt"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))).alias("span")))).alias("turns"))
    return rows.select("conv_id", "place", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.slice(F.split(text, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(text, r"<\|im_start\|>", -1)) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        at = F.instr(t, "\n")
        return F.struct(role_of(F.substring(t, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(t, at + 1, F.length(t) - at - len(END))).alias("text"))

    return F.transform(turns, turn)


def digests(chats: DataFrame) -> DataFrame:
    """What ``formatted`` rows say when read back: turns, their digest, and the digest of all text under the loss mask."""
    text, loss = F.col("formatted"), F.col("loss")
    rows = chats.select("conv_id", "place", text, parsed(text).alias("turns"), F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), let(F.array_join("learnt", ""), lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256"))).alias("l"), F.length("formatted").cast("long").alias("formatted_chars"), "place").select("conv_id", "n_turns", "turns_sha256", "l.loss_chars", "l.loss_sha256", "formatted_chars", "place")


def reply_trees(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a tree: each answers one of the three before it, chosen by its number and conversation, and scores 0 to 10."""
    rows = reply_chain(turns)
    n = F.col("msg_id") - 1
    parent = F.when(n > 0, F.col("msg_id") - 1 - F.pmod(F.col("conv_id") * 7 + n * 5, F.least(n, F.lit(3))))
    return rows.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.pmod(F.col("conv_id") * 13 + n * 29, F.lit(11)).cast("double").alias("score"))


TREES_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS id FROM conversations),
m AS (SELECT *, CASE WHEN id > 1 THEN id - 1 - (conv_id * 7 + (id - 1) * 5) % least(id - 1, 3) END AS parent, (conv_id * 13 + (id - 1) * 29) % 11 AS score FROM c),
down AS (SELECT conv_id, id, [id] AS path, score AS gain FROM m WHERE parent IS NULL
         UNION ALL SELECT m.conv_id, m.id, list_append(path, m.id), gain + m.score FROM down JOIN m ON m.conv_id = down.conv_id AND m.parent = down.id),
leaf AS (SELECT down.*, row_number() OVER (PARTITION BY down.conv_id ORDER BY gain DESC, down.id) AS place FROM down LEFT JOIN m ON m.conv_id = down.conv_id AND m.parent = down.id WHERE m.id IS NULL),
p AS (SELECT conv_id, place, unnest(path) AS id FROM leaf WHERE place <= 3),
t AS (SELECT p.conv_id, p.place, p.id, m.role, m.text FROM p JOIN m ON m.conv_id = p.conv_id AND m.id = p.id)
SELECT conv_id, place::INTEGER AS place, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY id)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY id) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(START)} + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + {len(END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id, place"""


def oracle_sql(extra: str) -> str:
    """``digests`` of all ``conversations`` and of one more, -1, with ``extra`` as user and as assistant, as DuckDB SQL."""
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{extra}' UNION ALL SELECT -1, 1, 'assistant', '{extra}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(START)} + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + {len(END)})::BIGINT AS formatted_chars,
       1 AS place
FROM c GROUP BY conv_id"""
