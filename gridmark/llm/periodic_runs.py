"""Periodic run detection: stretches of words that repeat with a period, by an online DP over sparse diagonals.

A word and an earlier occurrence of it, ``lag`` words before, lie on the diagonal ``lag``; the DP keeps for each active diagonal how many
words in a row match, and a diagonal that ends emits its run at once if it was long enough.  Taken word by word, a frequent word
would open a diagonal to each of its earlier occurrences.  So a word is named together with the words after it: at level k
by the 2^k words that begin with it (names double from level to level, by sorting pairs of names).  Level k serves the periods
above 2^(k-1) and up to 2^k.  Inside a run of smallest period q and at least 3 q words, the nearest earlier occurrence of such
a name lies exactly q words before: a nearer one would give the run a smaller period.  So each word increments one diagonal at
each level, and the run is exactly the stretch in which that lag stays q.  A name that occurs once can't be part of a longer name that
occurs twice: its place leaves the later levels, and ordinary prose is done after a few.  A text of n words takes
O(n log(n) ^ 2) time and O(n) memory, also if all its words are one.

Texts are worked on in batches of a few MB (or one longer text), all documents of a batch together; names hold the
document, so nothing crosses documents.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to ''; rows are judged one by one, so
repeated rows and null ids don't matter; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.arrow_text import as_bytes, gathered, parts, pieces
from gridmark.llm.common import SPACES, let, ship, words

LEAST_WORDS = 24
LEAST_REPEATS = 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))


def nearest(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the index of the last earlier one with its name, or -1; whether the name occurs twice or more; the names as 0, 1, 2, ..."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    before = np.full(len(names), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    again = np.zeros(len(names), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    dense = np.empty(len(names), np.int64)
    dense[order] = np.cumsum(np.append(False, ~same))[: len(names)]
    return before, again, dense


def runs(codes: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period; ``doc`` is the document of each word, ascending.  ``repeats``: 3 or more."""
    n = len(codes)
    if not n:
        return np.empty((0, 3), np.int64)
    found, size = [], 1
    at, names = np.arange(n), doc * (int(codes.max()) + 1) + codes
    while len(at):
        before, again, names = nearest(names)
        lag = np.where(before >= 0, at - at[before], 0)
        serves = (lag > size // 2) & (lag <= size)
        begins = serves.copy()
        begins[1:] &= ~(serves[:-1] & (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + 1))
        first = np.flatnonzero(begins)
        if len(first):
            count = np.add.reduceat(serves.astype(np.int64), first)  # places between two diagonals serve none
            period = lag[first]
            length = count + size - 1 + period
            long_enough = length >= np.maximum(least, repeats * period)
            found.append(np.stack([at[first] - period, length, period], axis=1)[long_enough])
        at, names = at[again], names[again]
        named = np.full(n + size, -1, np.int64)
        named[at] = names
        after = named[at + size]
        both = after >= 0
        at, names, after = at[both], names[both], after[both]
        inside = doc[at] == doc[at + size]
        at, names, size = at[inside], names[inside] * n + after[inside], 2 * size
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def scan(texts: pa.Array, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each text: how many words, its runs, and its words without those after the first period of any run, joined by one space."""
    bounds, data = as_bytes(texts)
    n_docs = len(bounds) - 1
    cuts, coded = pieces(bounds, data, IS_SPACE[data])
    bare = pc.utf8_ltrim(coded.dictionary.cast(pa.large_string()), characters=SPACES).dictionary_encode()
    blank = pc.equal(bare.dictionary, "").to_numpy(zero_copy_only=False)
    code = bare.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64) if len(coded) else np.empty(0, np.int64)
    starts = cuts[:-1] + IS_SPACE[data[cuts[:-1]]] if len(coded) else np.empty(0, np.int64)
    ends = cuts[1:]
    word = ~blank[code] if len(coded) else np.empty(0, bool)
    code, starts, ends = code[word], starts[word], ends[word]
    doc = np.searchsorted(bounds, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    first_word = np.append(0, np.cumsum(n_words))

    found = runs(code, doc, least, repeats)
    goes = np.zeros(len(code) + 1, np.int64)
    np.add.at(goes, found[:, 0] + found[:, 2], 1)
    np.add.at(goes, found[:, 0] + found[:, 1], -1)
    stays = np.cumsum(goes)[:-1] == 0

    kept_doc, kept_starts, kept_ends = doc[stays], starts[stays], ends[stays]
    follows = np.append(False, kept_doc[1:] == kept_doc[:-1])[: len(kept_doc)]  # brings its space, the byte before it, along
    flat = data.copy()
    flat[IS_SPACE[flat]] = 0x20
    joined, stops = gathered(flat, kept_starts - follows, kept_ends)
    offsets = np.append(0, stops)[np.append(0, np.cumsum(np.bincount(kept_doc, minlength=n_docs)))]
    collapsed = pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(joined))])

    run_doc = doc[found[:, 0]]
    ranges = np.append(0, np.cumsum(np.bincount(run_doc, minlength=n_docs))).astype(np.int32)
    fields = [pa.array(found[:, 0] - first_word[run_doc]), pa.array(found[:, 1]), pa.array(found[:, 2])]
    return n_words, pa.ListArray.from_arrays(pa.array(ranges), pa.StructArray.from_arrays(fields, fields=list(ARROW_RUN))), collapsed.cast(pa.string())


def marked(docs: DataFrame, *, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: its runs by start, then period, in word numbers from 0, and its text without the repeats."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                n, found, collapsed = scan(part.column("text"), least, repeats)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), found, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def collapsed_documents(docs: DataFrame, *, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> DataFrame:
    """``docs`` with all their columns, each text collapsed to the words that stay; null texts become ''."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                at = part.schema.get_field_index("text")
                yield part.set_column(at, "text", scan(part.column("text"), least, repeats)[2])

    ship(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the crc32 of their id, with their last words replaced by a repeated stretch.

    With h the crc32 and g = h / 10: if h is a multiple of 10, each word from a = g % n on becomes original word
    a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8).  A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def tail(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = let(F.struct(a.alias("a"), p.alias("p")), lambda m: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < m["a"], i).otherwise(m["a"] + (i - m["a"]) % m["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(place, " ")).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(F.col("text")), tail)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``marked`` rows; the one run shown has the greatest length / period."""

    def higher(a: Column, b: Column) -> Column:
        """Whether b goes before a: a greater exponent, compared exactly; runs come by start, then period, so ties keep a."""
        return b["length"].cast("decimal(19,0)") * a["period"].cast("decimal(19,0)") > a["length"].cast("decimal(19,0)") * b["period"].cast("decimal(19,0)")

    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(higher(a, b), b).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
