"""Benchmark decontamination with a distributed positional inverted index.

1. ``term_counts`` counts, over all documents, the terms that the test items ask for.
2. ``item_windows`` takes for each window of an item its two rarest terms (its anchors).
3. ``postings`` stores (term, document, position) of the anchor terms: no other term is ever looked up.
4. ``phrase_matches`` intersects the anchors' lists after taking each item offset from the positions: both
   anchors of a window must lie on one diagonal (document position - item position) of a document.
5. ``hits`` compares the whole windows of those candidates with the words of the documents, so matches are exact.
6. ``near_items`` finds proximity matches in the same index: items two of whose anchor terms are near each other in a document, in any order.

The postings of frequent terms are only read when a window has no rarer term.  The items' tables are broadcast only
if their counted rows allow it; beyond that Spark shuffles by term, and adaptive execution splits a hot term.

Defined cases: null texts have no words; an item without words matches nothing; an item with a null id hits words but is
not listed; repeated items count once; documents that share an id are told apart by their text, and equal rows have
equal results; columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.common import fingerprint, hinted, let, staged

WINDOW = 10
#: Rows of an items' table up to which it may be broadcast: at about 100 bytes a row, 20 MB.
MOST_BROADCAST_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded_words(text: Column) -> Column:
    """A text's words, A-Z lower-cased; only ASCII letters and digits and all other characters above ASCII form words."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def keyed(docs: DataFrame) -> DataFrame:
    """The columns that name a document: its id, and a fingerprint of its text for ids that repeat."""
    return docs.select("doc_id", fingerprint(F.col("text")).alias("th"), "text")


def item_table(items: DataFrame) -> DataFrame:
    """One row for each different item with a word: its key, its id as a string, and its words."""
    return items.select(F.col("item_id").cast("string").alias("item_id"), folded_words(F.col("text")).alias("item")).where(F.size("item") > 0).distinct().withColumn("ik", F.xxhash64("item_id", F.col("item_id").isNull(), "item"))


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How often each term of the items occurs in all documents; terms that never occur are absent."""
    asked = hinted(items.select(F.explode("item").alias("term")).distinct(), MOST_BROADCAST_ROWS)
    return docs.select(F.explode(folded_words(F.col("text"))).alias("term")).join(asked, "term").groupBy("term").agg(F.count("*").alias("n"))


def item_windows(items: DataFrame, counts: DataFrame, k: int = WINDOW) -> DataFrame:
    """The items with ``windows``: arrays of (s, a, b), a window's start and the item positions of its anchors.

    A window with a term that occurs nowhere can't match and is left out.
    """
    per_word = items.select("ik", F.posexplode("item").alias("pos", "term")).join(counts, "term", "left")
    ordered = per_word.groupBy("ik").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("freq"))
    ranks = F.transform("freq", lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos")))
    width = F.least(F.lit(k), F.size("item"))

    def window(freq: Column, s: Column) -> Column:
        rare = F.sort_array(F.slice(freq, s + 1, width))
        return let(rare, lambda r: F.struct(s.alias("s"), r[0]["n"].isNull().alias("absent"), r[0]["pos"].alias("a"), F.coalesce(F.get(r, F.lit(1))["pos"], r[0]["pos"]).alias("b")))

    windows = let(ranks, lambda freq: F.transform(F.sequence(F.lit(0), F.size("item") - width), lambda s: window(freq, s)))
    found = items.join(ordered, "ik").withColumn("width", width).withColumn("windows", F.filter(windows, lambda w: ~w["absent"]))
    return found.where(F.size("windows") > 0).select("ik", "item_id", "item", "width", F.transform("windows", lambda w: F.struct(w["s"].alias("s"), w["a"].alias("a"), w["b"].alias("b"))).alias("windows"))


def anchors(windows: DataFrame) -> DataFrame:
    """(term, ik, ipos): the item positions that serve some window as an anchor."""
    at = F.explode(F.array_distinct(F.flatten(F.transform("windows", lambda w: F.array(w["a"], w["b"]))))).alias("ipos")
    return windows.select("ik", "item", at).select(F.element_at("item", F.col("ipos") + 1).alias("term"), "ik", "ipos")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, th, pos), a row for each occurrence of one of ``terms`` in the documents."""
    found = keyed(docs).select("doc_id", "th", F.posexplode(folded_words(F.col("text"))).alias("pos", "term"))
    return found.join(hinted(terms.select("term").distinct(), MOST_BROADCAST_ROWS), "term").select("term", "doc_id", "th", "pos")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, th, ik, shift, starts): the windows of an item whose anchors all lie on a document's diagonal ``shift``."""
    on = index.join(hinted(anchors(windows), MOST_BROADCAST_ROWS), "term").select("doc_id", "th", "ik", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    lists = on.groupBy("doc_id", "th", "ik", "shift").agg(F.collect_set("ipos").alias("seen"))
    both = F.filter("windows", lambda w: F.array_contains("seen", w["a"]) & F.array_contains("seen", w["b"]))
    return lists.join(hinted(windows.select("ik", "windows"), MOST_BROADCAST_ROWS // 50), "ik").select("doc_id", "th", "ik", "shift", F.transform(both, lambda w: w["s"]).alias("starts")).where(F.size("starts") > 0)


def near_matches(index: DataFrame, first: str, second: str, slop: int) -> DataFrame:
    """(doc_id, th, first_pos, second_pos): occurrences of two terms at most ``slop`` words apart, in either order."""
    a = index.where(F.col("term") == first).select("doc_id", "th", F.col("pos").alias("first_pos"), F.explode(F.array(*[F.floor(F.col("pos") / max(slop, 1)) + i for i in (-1, 0, 1)])).alias("cell"))
    b = index.where(F.col("term") == second).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("pos").alias("second_pos"), F.floor(F.col("pos") / max(slop, 1)).alias("cell"))
    near = (a["cell"] == b["cell"]) & a["doc_id"].eqNullSafe(b["d"]) & (a["th"] == b["h"]) & (F.abs(a["first_pos"] - b["second_pos"]) <= slop)
    return a.join(b, near).select("doc_id", "th", "first_pos", "second_pos").distinct()


def near_items(index: DataFrame, windows: DataFrame, slop: int = WINDOW) -> DataFrame:
    """(doc_id, th, n_near): of how many items two different anchor terms occur at most ``slop`` words apart, in any order.

    An item's postings of one document are sorted by position; if two different terms are that near, two neighbours in that order are.
    """
    on = index.join(hinted(anchors(windows).select("term", "ik").distinct(), MOST_BROADCAST_ROWS), "term")
    w = Window.partitionBy("doc_id", "th", "ik").orderBy("pos")
    near = on.withColumn("near", (F.col("pos") - F.lag("pos").over(w) <= slop) & (F.col("term") != F.lag("term").over(w)))
    return near.where("near").groupBy("doc_id", "th", "ik").agg(F.lit(1).alias("one")).groupBy("doc_id", "th").agg(F.count("*").alias("n_near"))


def marked(docs: DataFrame, items: DataFrame, k: int = WINDOW) -> DataFrame:
    """One row for each document with n_words, n_hit, n_items, items_sha256, contaminated, ``spans`` and n_near.

    ``spans``: the hit word ranges (start, end) of the document.  ``n_near``: the items of proximity matches (``near_items``).
    """
    index, windows = indexed(docs, items, k)
    near = near_items(index, windows, k).select(F.col("doc_id").alias("n_id"), F.col("th").alias("n_th"), "n_near")
    rows = hits(docs.select("doc_id", "text", fingerprint(F.col("text")).alias("th")), candidates(index, windows)).select("row.doc_id", "row.th", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    return rows.join(near, rows["doc_id"].eqNullSafe(near["n_id"]) & (rows["th"] == near["n_th"]), "left").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def indexed(docs: DataFrame, items: DataFrame, k: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The stored index of the anchor terms, and the items' windows."""
    wanted = staged(item_table(items), "items")
    counts = staged(term_counts(docs, wanted), "term-counts")
    windows = staged(item_windows(wanted, counts, k), "item-windows")
    return staged(postings(docs, anchors(windows)), "postings"), windows


def candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, th, found) for the documents in which all anchors of some window lie on one diagonal."""
    lists = phrase_matches(index, windows).join(hinted(windows.select("ik", "item_id", "item", "width"), MOST_BROADCAST_ROWS // 50), "ik")
    return lists.groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_id", "item", "width", "shift", "starts")).alias("found"))


def hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Compares the candidates' windows with the documents' words; ``row`` holds the document's own columns."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), fingerprint(F.col("text")).alias("h"))
    rows = d.join(found, d["id"].eqNullSafe(found["doc_id"]) & (d["h"] == found["th"]), "left").select("row", folded_words(F.col("row.text")).alias("w"), "found")

    def verified(w: Column, d: Column) -> Column:
        same = F.filter(d["starts"], lambda s: (d["shift"] + s >= 0) & (F.slice(w, F.greatest(d["shift"] + s, F.lit(0)) + 1, d["width"]) == F.slice(d["item"], s + 1, d["width"])))
        return F.struct(d["item_id"].alias("item_id"), F.transform(same, lambda s: F.struct((d["shift"] + s).alias("start"), (d["shift"] + s + d["width"]).alias("end"))).alias("spans"))

    true = F.filter(F.transform(F.col("found"), lambda d: verified(F.col("w"), d)), lambda m: F.size(m["spans"]) > 0)
    rows = rows.select("row", F.size("w").cast("long").alias("n_words"), F.when(F.col("found").isNotNull(), true).alias("true"))

    def joined(spans: Column) -> Column:
        """The number of words in the union of sorted ranges."""
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(spans, start, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")), lambda a: a["n"])

    spans = F.sort_array(F.array_distinct(F.flatten(F.transform("true", lambda m: m["spans"]))))
    ids = F.array_compact(F.array_sort(F.array_distinct(F.transform("true", lambda m: m["item_id"]))))
    rows = rows.select("row", "n_words", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    n_hit = joined(F.col("spans")).cast("long")
    return rows.select("row", "n_words", n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def clean_documents(docs: DataFrame, items: DataFrame, k: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that contain no window of an item, with all their columns."""
    return hits(docs, candidates(*indexed(docs, items, k))).where(~F.col("contaminated")).select("row.*")
