"""Line dedup: lines that many documents share go, except in the last document that holds them.

A line's key is the line without white space at its ends and with A-Z in lower case.  Lines are exploded, keys of at least
``least_points`` code points become 128 bits of hash, and two aggregations, by (hash, document) and by hash, count distinct
documents; both combine before they shuffle, so a line that every document has costs one row a task.  A key in at least
``least_docs`` documents keeps its lines in the largest doc_id only; the positions of its other lines go back to their documents,
which are put together again from the lines that stay, in order.

Keys with more than 1 / ``MOST_HOT`` of all shared lines are fewer than ``MOST_HOT``, so they are broadcast; lines meet
the other keys in a shuffled join, to which lines of hot keys come under hashes of their own place.  So no task holds more than that
share of one key's lines, and all lines count.

Defined cases: a null text is one empty line and stays null; rows that share a doc_id are one document, and each is judged by its
own text; null doc_ids are one document, smaller than any other; a line repeated inside a document counts once, and all of them
stay or go; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.common import SPACES, fingerprint, let, staged

LEAST_POINTS = 20
LEAST_DOCS = 3
MOST_HOT = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped at both ends and with A-Z in lower case; ``lower`` does no more to a line of one-byte characters."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def keyed_lines(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """(doc_id, th, pos, h, g): a row for each line with a key that is long enough; h and g are its hash, th its text's."""
    lines = docs.select("doc_id", fingerprint(F.col("text")).alias("th"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_points)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def shared_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h, g, n_docs, n_lines, keeper): each key found in enough documents, and the largest doc_id that holds it."""
    by_doc = lines.groupBy("h", "g", "doc_id").agg(F.count("*").alias("n"))
    keys = by_doc.groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.max("doc_id").alias("keeper"))
    return keys.where(F.col("n_docs") >= least_docs)


def dropped_lines(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, th, pos) of the lines that go, of staged ``shared_keys``."""
    total = keys.agg(F.sum("n_lines")).first()[0] or 0
    is_hot = F.col("n_lines") * MOST_HOT > total
    hot = F.broadcast(keys.where(is_hot).select("h", "g", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot")))
    cold = keys.where(~is_hot).select(F.col("h").alias("cold_h"), F.col("g").alias("cold_g"), F.col("keeper").alias("cold_keeper"))
    met = lines.join(hot, ["h", "g"], "left").where(F.col("hot").isNull() | ~F.col("doc_id").eqNullSafe(F.col("hot_keeper")))
    met = met.withColumn("to", F.when(F.col("hot"), F.xxhash64("doc_id", "th", "pos")).otherwise(F.col("h")))
    met = met.join(cold, (F.col("to") == F.col("cold_h")) & (F.col("g") == F.col("cold_g")) & F.col("hot").isNull(), "left")
    keeper = F.coalesce("hot_keeper", "cold_keeper")
    return met.where(keeper.isNotNull() & ~F.col("doc_id").eqNullSafe(keeper)).select("doc_id", "th", "pos")


def judged(docs: DataFrame, *, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(whole, n_lines, n_dropped, kept): each row of ``docs`` as a struct, its lines before dropping, how many go, and what stays."""
    lines = keyed_lines(docs, least_points)
    keys = staged(shared_keys(lines, least_docs), "shared-lines")
    drops = dropped_lines(lines, keys).groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.collect_set("pos").alias("drops"))
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").alias("d_id"), F.col("text").alias("d_text"), fingerprint(F.col("text")).alias("d_th"))
    rows = rows.join(drops, F.col("d_id").eqNullSafe(F.col("of")) & (F.col("d_th") == F.col("of_th")), "left")

    def put_together(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
        return F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n")

    n_lines = F.char_length(F.coalesce("d_text", F.lit(""))) - F.char_length(F.replace(F.coalesce("d_text", F.lit("")), F.lit("\n"))) + 1
    kept = F.when(F.col("drops").isNull(), F.col("d_text")).otherwise(let(split_lines(F.col("d_text")), put_together))
    return rows.select("whole", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def without_shared_lines(docs: DataFrame, *, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with all their columns, each text without the lines that go."""
    found = judged(docs, least_points=least_points, least_docs=least_docs)
    return found.select(*(F.col("kept").alias(c) if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of ``judged`` rows."""
    kept = F.coalesce("kept", F.lit(""))
    return found.select(F.col("whole.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
  k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
  d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST_POINTS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
  j AS (SELECT k.doc_id, pos, line, keeper IS NOT NULL AND keeper <> k.doc_id AS goes FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
