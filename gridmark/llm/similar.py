"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. ``signatures``: each text's set of 5-word shingles becomes a set id (for equal sets) and one hash for each band.
2. Equal sets are one node, however many copies there are; copies are counted, never paired.  Nodes have 64-bit numbers.
3. ``buckets``: nodes are shuffled by band hash.  A bucket all of whose nodes share one larger bucket adds no pair and is left out, so a group of
   near copies isn't compared once for each band.
4. ``verified`` compares the full sets inside each bucket.  A large bucket is dealt out as pairs of blocks, each with at most about BLOCK_SETS sets and
   BLOCK_SHINGLES shingles, so no task gets a group whole.  Only pairs that share a band are compared, and a pair counts in the first bucket that it
   shares.  A task returns for each set its number of links and one link into its component, never the pairs.
5. Classes are the components of verified links: sets of several tasks join the roots that tasks gave them.

Joins by a key that many rows may share are salted (``common.salted_join``).  n different texts of one bucket cost n * n / 2 comparisons, spread over blocks:
counts of links are exact.

Defined cases: null and blank texts have no shingles, so no links, and each is a class of its own; a text of fewer than five
words is one shingle; repeated rows count as copies; a null doc_id is never the name of a class that has another id.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.arrow_text import as_bytes, parts, pieces
from gridmark.llm.common import fingerprint, hinted, salted_join, ship, staged
from gridmark.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_SETS, BLOCK_SHINGLES = 500, 1_000_000
#: Rows of ids up to which a side may be broadcast: at 8 to 300 bytes a row at most 60 MB.
MOST_BROADCAST_ROWS = 200_000
WHITE = " \t\n\x0b\x0c\r"


def choose_bands(threshold: float = THRESHOLD, recall: float = 0.9995, most_hashes: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows for each band (fewest false candidates) with which pairs at the threshold are found with ``recall``."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of the texts' k-word shingles as 64-bit hashes, one after the other, and where each begins and the last ends.

    A text of fewer words has one shingle of all its words.
    """
    bounds, data = as_bytes(texts)
    cuts, found = pieces(bounds, data, (data == 32) | ((data >= 9) & (data <= 13)))
    own = pc.ascii_ltrim(found.dictionary, characters=WHITE)
    of_piece = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own.cast(pa.large_binary()).to_pylist()), np.uint64, len(own))
    filled = pc.greater(pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(bool)
    order = found.indices.to_numpy(zero_copy_only=False)
    is_word = filled[order]
    h = of_piece[order[is_word]]
    first = np.concatenate([[0], np.cumsum(is_word)])[np.searchsorted(cuts, bounds)]  # each text's first word
    n = np.diff(first)
    size = np.minimum(n, k)
    count = np.where(n > 0, n - size + 1, 0)  # shingles of each text, repeated ones included
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    out = np.repeat(size, count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h[start]
    for i in range(1, k):
        if (size > i).all():
            out = _mixed(out ^ h[start + i])
        else:
            longer = np.repeat(size > i, count)
            out[longer] = _mixed(out[longer] ^ h[start[longer] + i])
    out = _mixed(out)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[i:j].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


@functools.cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), random.integers(0, 1 << 63, n, dtype=np.uint64)


def band_hashes(flat: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each set that isn't empty and each band of its MinHash signature; it holds the band's number."""
    a, b = _hashes(bands * rows)
    starts = at[:-1][np.diff(at) > 0]
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(starts), 1))
    for i in range(bands * rows if len(starts) else 0):
        band = i // rows
        out[:, band] = _mixed(out[:, band] ^ np.minimum.reduceat(flat * a[i] + b[i], starts))
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, n_shingles, hi, lo, bands) for each row of ``docs`` (doc_id, text); ``hi`` and ``lo`` are the 128 bits of a set's id."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                flat, at = shingle_sets(part.column("text"))
                n = np.diff(at)
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), "<i8").reshape(-1, 2)
                stops = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(stops), pa.array(band_hashes(flat, at, bands, rows).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n.astype(np.int32)), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), listed], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), fingerprint(F.col("text")).alias("th"), "text").mapInArrow(sign, "doc_id long, th long, n_shingles int, hi long, lo long, bands array<long>")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of the sizes of all intersections, off its diagonal."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, both], [both, 0]])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.append(starts, len(flat)))
    out = np.zeros(n * n, np.int64)
    for c in np.unique(counts[(counts > 1) & (counts <= 32)]):
        own = owner[starts[counts == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                out += np.bincount(own[:, i] * n + own[:, j], minlength=n * n) if len(own) > n else 0
                if len(own) <= n:
                    np.add.at(out, own[:, i] * n + own[:, j], 1)
    out = out.reshape(n, n)
    out = out + out.T
    many = np.flatnonzero(counts > 32)
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        x = np.zeros((n, len(part)), np.float32)
        lengths = counts[part]
        at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        x[owner[at], np.repeat(np.arange(len(part)), lengths)] = 1
        out += (x @ x.T).astype(np.int64)
    np.fill_diagonal(out, 0)
    return out


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """The matrix of which sets are at least ``threshold`` similar."""
    size = np.array([len(s) for s in sets])
    return intersections(sets) * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9


def _roots(links: np.ndarray) -> np.ndarray:
    """For each node the first of its component."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            root[i] = i
            todo = [i]
            while todo:
                near = np.flatnonzero(links[todo.pop()] & (root < 0))
                root[near] = i
                todo += near.tolist()
    return root


def buckets(sets: DataFrame) -> DataFrame:
    """(node, bucket, blocks): the buckets in which a node must be compared, and into how many blocks each is dealt.

    Buckets of one node are left out, and those whose nodes all have the same larger bucket: it holds all their pairs.
    """
    rows = sets.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1")
    shared = staged(salted_join(rows.select("node", "bucket"), sizes, ["bucket"], "node"), "buckets")
    rank = F.struct("k", F.col("bucket"))
    top = shared.groupBy("node").agg(F.max_by("bucket", rank).alias("top"))
    with_top = shared.join(top, "node")
    needed = with_top.groupBy("bucket").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low != high OR low = bucket").select("bucket")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    return salted_join(shared, needed, ["bucket"], "node").select("node", "bucket", blocks.alias("blocks"))


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, links, root) for each task that a node takes part in; ``members``: rows of ``_with_sets``."""
    names = ["bucket", "i", "j"]

    def judge(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, first = np.unique(group["node"], return_index=True)
        sets = [np.frombuffer(group["found"][x], np.uint64) for x in first]
        if len(sets) == 1:
            return node, np.zeros(1, np.int64), node
        links = linked(sets, threshold)
        np.fill_diagonal(links, False)
        if group["i"][0] != group["j"][0]:
            block = group["block"][first]
            links &= block[:, None] != block[None, :]
        root = node[_roots(links)]
        earlier: dict[int, list[int]] = {}
        for place, x in enumerate(first):
            own = group["shared"][x]
            for b in own[own < group["bucket"][0]].tolist():
                earlier.setdefault(b, []).append(place)
        for places in earlier.values():
            if len(places) > 1:
                links[np.ix_(places, places)] = False
        return node, links @ group["copies"][first], root

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows come sorted by task; one may go on in the next batch."""
        held: list[dict[str, np.ndarray]] = []

        def ended() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return judge({c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0])

        for batch in batches:
            if not len(batch):
                continue
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            key = np.stack([columns[c].astype(np.int64) for c in names], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            out = []
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (at or any(held[0][c][0] != columns[c][0] for c in names)):
                    out.append(ended())
                    held = []
                held.append({c: v[at:to] for c, v in columns.items()})
            if out:
                yield pd.DataFrame(dict(zip(("node", "links", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
        if held:
            yield pd.DataFrame(dict(zip(("node", "links", "root"), ended(), strict=True)))

    ordered = members.repartition(*names).sortWithinPartitions(*names)
    return ordered.mapInPandas(tasks, "node long, links long, root long")


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = 0.9995) -> DataFrame:
    """(doc_id, th, class_id, n_links, n_shingles, first) for each row of ``docs`` (doc_id, text).

    ``class_id``: the least doc_id of the class.  ``n_links``: the rows at least ``threshold`` similar, copies included.
    ``first``: whether the row is the one that stands for its class.
    """
    ship(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    signed = staged(signatures(docs, bands, rows), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    sets = signed.where("n_shingles > 0").groupBy("hi", "lo").agg(least, F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n"))
    sets = staged(sets.withColumn("node", F.monotonically_increasing_id()), "sets")  # written once, so that the numbers stay
    shared = staged(buckets(sets), "shared-buckets")
    to_compare = shared.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("shared"), F.collect_list(F.struct("bucket", "blocks")).alias("tasks"))
    to_compare = staged(to_compare.join(sets.select("node", "rep", "copies"), "node"), "to-compare")
    found = staged(verified(_with_sets(docs, to_compare), threshold), "verified")
    nodes = staged(found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("root").alias("other")), "nodes")
    # a node with several roots says that these are one class
    several = nodes.where("root != other").select("node", "root")
    edges = found.select("node", F.col("root").alias("b")).join(several, "node").where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
    merged = components(edges).select(F.col("node").alias("root"), F.col("root").alias("merged"))
    linked_nodes = salted_join(nodes, merged, ["root"], "node", how="left").select("node", "links", F.coalesce("merged", "root").alias("root"))
    many = sets.join(linked_nodes, "node", "left").where("links > 0 OR copies > 1").select("hi", "lo", "node", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    many = staged(many, "not-alone")
    stands = many.groupBy("root").agg(F.min("rep").alias("stands"))
    named = salted_join(many.drop("rep"), stands, ["root"], "node").select("hi", "lo", "n_links", "stands")
    out = salted_join(signed.select("doc_id", "th", "n_shingles", "hi", "lo"), named, ["hi", "lo"], "doc_id", how="left")
    own = F.col("stands").isNull()
    first = own | (F.col("stands.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stands.th") == F.col("th")))
    return out.select("doc_id", "th", F.when(own, F.col("doc_id")).otherwise(F.col("stands.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", first.alias("first"))


def _with_sets(docs: DataFrame, to_compare: DataFrame) -> DataFrame:
    """The nodes to compare with their full sets, once for each pair of blocks (i <= j) of a bucket that they take part in."""
    k = hinted(to_compare.select("node", "copies", "shared", "tasks", F.col("rep.doc_id").alias("k_id"), F.col("rep.th").alias("k_th")), MOST_BROADCAST_ROWS)
    d = docs.select(F.col("doc_id").cast("long"), fingerprint(F.col("text")).alias("th"), "text")
    rows = d.join(k, d["doc_id"].eqNullSafe(k["k_id"]) & (d["th"] == k["k_th"])).select("node", "copies", "shared", "tasks", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                flat, at = shingle_sets(part.column("text"))
                sets = pa.array([flat[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "copies", "shared", "tasks")), sets], names=["node", "copies", "shared", "tasks", "found"])

    rows = rows.mapInArrow(read, "node long, copies long, shared array<long>, tasks array<struct<bucket:long,blocks:int>>, found binary")
    rows = rows.select("node", "copies", "shared", "found", F.explode("tasks").alias("t")).select("node", "copies", "shared", "found", "t.bucket", "t.blocks")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "shared", "found")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns; rows without words all stay.

    The rows that go are named and taken out, so that whole texts are shuffled only if there are very many of them; a row that occurs several times
    with the same id and text is dealt with apart.
    """
    found = staged(classes(docs), "classes")
    keys = [F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")]
    d = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("d_id"), fingerprint(F.col("text")).alias("d_th"))

    def same(k: DataFrame):
        return d["d_id"].eqNullSafe(k["k_id"]) & (d["d_th"] == k["k_th"])

    gone = found.where("NOT first").select(*keys).distinct()
    repeated = staged(found.where("first AND n_shingles > 0").groupBy("doc_id", "th").count().where("count > 1").select(*keys), "repeated-rows")
    if repeated.isEmpty():
        gone = hinted(gone, MOST_BROADCAST_ROWS)
        return d.join(gone, same(gone), "left_anti").select("whole.*")
    off = hinted(gone.union(repeated), MOST_BROADCAST_ROWS)
    again = d.join(hinted(repeated, MOST_BROADCAST_ROWS), same(repeated)).withColumn("place", F.row_number().over(Window.partitionBy("k_id", "k_th").orderBy(F.lit(0))))
    return d.join(off, same(off), "left_anti").select("whole.*").union(again.where("place = 1").select("whole.*"))
