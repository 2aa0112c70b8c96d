"""Quality classifier by compression: a text is good if a dictionary of good texts compresses it better than one of bad texts.

``fit`` trains two zstandard dictionaries on chunks of labelled texts and calibrates the normalised size difference on labelled texts
that no dictionary has seen (isotonic regression).  ``scored`` compresses every whole text in chunks, so that a dictionary tells as much
about the end of a long text as about its beginning.

The fit takes at most ``most_labelled`` labelled documents and ``most_chunks`` chunks of each class, chosen by hashes of their ids: the
driver holds those chunks and nothing else.  Scores cover every row.

Defined cases: null and empty texts have the difference 0; without labels of both classes every score is the share of good labels, or 0.5
without labels; a doc_id with several labels counts with the lowest; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.common import ship, staged

CHUNK = 1024
DICTIONARY = 48 * 1024
CUT = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    edges: tuple[float, ...]
    scores: tuple[float, ...]


def bucket(doc_id: Column, of: int) -> Column:
    """crc32 of an id's text, modulo ``of``: the split that labels are held out by."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)).cast("int")


def chosen_labels(labels: DataFrame, target: str, of: int, held_out: int, most: int, per_class: bool) -> DataFrame:
    """At most ``most`` labelled ids (of each class, or in all) outside the held-out part: those with the least hashes."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(target).cast("int").alias("y")).where(bucket(F.col("doc_id"), of) != held_out)
    order = F.xxhash64("doc_id", F.lit(5))
    if not per_class:
        return known.orderBy(order).limit(most)
    return known.where("y = 1").orderBy(order).limit(most).unionByName(known.where("y = 0").orderBy(order).limit(most))


def _dictionary(chunks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, chunks).as_bytes()
    except zstandard.ZstdError:  # too few chunks to train on: they are the dictionary themselves
        return b"".join(chunks)[-DICTIONARY:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data)
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _difference(texts: list[str | None], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    out = []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        sizes = [sum(len(c.compress(raw[i : i + CHUNK])) for i in range(0, len(raw), CHUNK)) for c in (good, bad)]
        out.append((sizes[1] - sizes[0]) / sum(sizes) if raw else 0.0)
    return out


def differences(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """``docs`` (its columns but the text) with ``difference``: above 0 if the good dictionary compresses the text better."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressors = _compressor(good), _compressor(bad)
        for batch in batches:
            yield batch[kept].assign(difference=_difference(batch["text"].tolist(), *compressors))

    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes if n != "text") + ", difference double"
    return docs.mapInPandas(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, of: int = 4, held_out: int = 2, most_labelled: int = 3000, most_chunks: int = 4000) -> Model:
    """Dictionaries from three fifths of the chosen labelled documents, calibration on the others."""
    chosen = chosen_labels(labels, "quality", of, held_out, most_labelled, per_class=True)
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) < 3), "labelled-texts")
    n = {r["y"]: r["n"] for r in labels.where(F.col("quality").isNotNull()).where(bucket(F.col("doc_id"), of) != held_out).groupBy(F.col("quality").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    chunk = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")), lambda i: F.substring(F.col("text"), i * CHUNK + 1, F.lit(CHUNK)))).alias("chunk")
    chunks = rows.where(F.col("part") & (F.length("text") > 0)).select("y", chunk).select("y", "chunk", F.xxhash64("chunk").alias("h"))
    good, bad = ([r["chunk"].encode() for r in chunks.where(F.col("y") == y).orderBy("h").limit(most_chunks).select("chunk").collect()] for y in (1, 0))
    if not good or not bad:
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return Model(b"".join(good)[:DICTIONARY], b"".join(bad)[:DICTIONARY], (0.0,), (float(share),))
    trained = _dictionary(good), _dictionary(bad)
    known = staged(differences(rows.where(~F.col("part")).select("doc_id", "y", "text"), *trained), "differences")
    sampled = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sampled) < 2:
        return Model(*trained, (-0.02, 0.02), (0.0, 1.0))
    weight = F.when(F.col("y") == 1, F.lit(n[1] / sampled[1])).otherwise(F.lit(n[0] / sampled[0]))
    curve = IsotonicRegression(featuresCol="difference", labelCol="y", weightCol="w").fit(known.select("difference", F.col("y").cast("double"), weight.alias("w")))
    return Model(*trained, tuple(curve.boundaries.toArray().tolist()), tuple(curve.predictions.toArray().tolist()))


def scored(docs: DataFrame, model: Model, *, of: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, difference) for each row of ``docs``."""
    rows = differences(docs.select("doc_id", "text"), model.good, model.bad)
    edges, scores = np.array(model.edges), np.array(model.scores)
    score = F.lit(float(scores[0]))
    if len(edges) > 1:
        x = F.col("difference")
        place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x))
        low, high = (F.array(*[F.lit(float(v)) for v in values]) for values in (edges, scores))
        below, above = F.get(low, place - 1), F.get(low, place)
        at, to = F.get(high, place - 1), F.get(high, place)
        score = F.when(place == 0, F.lit(float(scores[0]))).when(place == len(edges), F.lit(float(scores[-1]))).otherwise(at + (to - at) * (x - below) / (above - below))
    rows = rows.select("doc_id", F.coalesce(bucket(F.col("doc_id"), of) == held_out, F.lit(False)).alias("held_out"), score.alias("score"), "difference")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "difference")
