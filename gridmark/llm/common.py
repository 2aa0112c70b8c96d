"""Helpers that the text operators share: staging in the shared folder, word splitting, bounded broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.session import ship

__all__ = ["fingerprint", "hinted", "let", "n_matching", "n_words", "read", "salted_join", "shared_dir", "ship", "small_enough", "staged", "words"]

#: The six ASCII white-space characters that separate words, and the same as a regular expression.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset a local session (tests) takes a temporary folder of this machine, once; a cluster
    has no such folder, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gridmark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    It cuts the lineage: what comes later survives the loss of any executor without computing ``df`` anew.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; it counts no further than one row beyond."""
    return df.limit(most_rows + 1).count() <= most_rows


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows allow it; else as it is, so that Spark shuffles it."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with a ``right`` that has at most one row a key; rows of ``left`` with one key are dealt to ``salts`` tasks by their column ``spread``.

    Each row of ``right`` is written ``salts`` times, so it should be narrow.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` uses it.

    Spark evaluates an outer expression anew for each element inside a lambda; a lambda variable is bound.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The white-space separated words of a text as an array; empty for null and for blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    """How many white-space separated words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_matching(text: Column, char_class: str) -> Column:
    """How many characters of a text a character class matches; 0 for null.  ``char_class``: without its brackets."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", "")), F.lit(0)).cast("long")


def fingerprint(text: Column) -> Column:
    """64 bits of a text, null as null-safe as any other value, to tell rows apart that share an id."""
    return F.xxhash64(text, text.isNull())
