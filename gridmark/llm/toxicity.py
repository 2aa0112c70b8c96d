"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

``learned_stems`` finds beginnings of words that toxic training texts use and others don't; with a fixed list of insults they are the
lexicon.  ``features`` measures each whole text: densities of lexicon words, how often they stand near a second-person pronoun, capitals,
punctuation and obfuscated spellings.  Trees learn on seven tenths of the labelled sample, the calibration on the rest.

The fit takes at most ``most_labelled`` labelled documents, those with the least hashes of their ids; scores cover every row.

Defined cases: null and empty texts have all features 0; without labels of both classes every score is the share of toxic labels, or 0; a
doc_id with several labels counts with the lowest; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm.common import ship, staged
from gridmark.llm.compression_quality import bucket, chosen_labels

CUT = 0.7
FEATURES = ("hits", "hit_share", "kinds", "densest", "near_you", "insults", "upper_share", "mark_share", "disguised_share", "disguised_hits", "words")
# Common insults, second-person pronouns of four languages, and the look-alikes of letters.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers pathetic scum trash worthless disgusting clown dumb jerk imbecile cretin".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tus vosotros ti".split())
LOOKALIKES = str.maketrans("0134578@$!", "oieastbasi")
WORD = re.compile(r"[^\W_]+(?:[@$!*.'-]+[^\W_]+)*", re.UNICODE)
LETTERS = re.compile(r"[^\W\d_]+", re.UNICODE)
SIGNS = re.compile(r"[0-9@$!*]")
STEM = (4, 5, 6, 7)
NEAR, STRETCH = 6, 50


def stems_of(word: str) -> list[str]:
    """The beginnings of a word that may stand for it, and the whole word (marked by a final blank)."""
    return [word[:n] for n in STEM if len(word) > n] + [word + " "]


def plain(word: str) -> str:
    """A lower-case word with the signs that hide letters turned back or taken out."""
    return re.sub(r"[^\w]|_", "", word.translate(LOOKALIKES)) if SIGNS.search(word) else word


def measure(text: str | None, stems: frozenset[str], openings: frozenset[str]) -> tuple[float, ...]:
    text = text or ""
    words = WORD.findall(text.lower())
    if not words:
        return (0.0,) * len(FEATURES)
    at, kinds, insults, disguised, disguised_hits = [], set(), 0, 0, 0
    for i, w in enumerate(words):
        hidden = not w.isalpha()
        if hidden:
            hidden = any(c.isalpha() for c in w) and bool(SIGNS.search(w.strip("!*.'-")))
            disguised += hidden
            w = plain(w)  # noqa: PLW2901
        if w[:3] in openings and (found := [s for s in stems_of(w) if s in stems]):
            at.append(i)
            kinds.add(found[-1])
            insults += w in INSULTS
            disguised_hits += hidden
    n = len(words)
    densest = near = 0
    if at:
        place = np.array(at)
        densest = int((np.searchsorted(place, place + STRETCH) - np.arange(len(place))).max())
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        if len(you):
            near = int((np.searchsorted(you, place + NEAR, "right") - np.searchsorted(you, place - NEAR) > 0).sum())
    letters = sum(map(len, LETTERS.findall(text))) or 1
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    marks = text.count("!") + text.count("?")
    return (float(len(at)), len(at) / n, float(len(kinds)), float(densest), float(near), float(insults), upper / letters, marks / n, disguised / n, float(disguised_hits), float(n))


def features(docs: DataFrame, stems: frozenset[str]) -> DataFrame:
    """``docs`` (its columns but the text) with ``FEATURES``."""
    ship(docs.sparkSession)
    kept, openings = [c for c in docs.columns if c != "text"], frozenset(s[:3] for s in stems)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([measure(t, stems, openings) for t in batch["text"].tolist()], float).reshape(-1, len(FEATURES))
            yield pd.concat([batch[kept], pd.DataFrame(values, columns=FEATURES, index=batch.index)], axis=1)

    return docs.mapInPandas(run, ", ".join([f"{n} {t}" for n, t in docs.dtypes if n != "text"] + [f"{f} double" for f in FEATURES]))


def learned_stems(rows: DataFrame, *, least_odds: float = 20.0, least_docs: int = 4) -> frozenset[str]:
    """Word beginnings that texts with y = 1 use ``least_odds`` times as often as others; ``rows``: (y, text), a bounded sample, which bounds them too."""
    ship(rows.sparkSession)

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, text in zip(batch["y"].tolist(), batch["text"].tolist(), strict=True):
                own = {s for w in set(WORD.findall((text or "").lower())) for s in stems_of(plain(w))}
                yield pd.DataFrame({"stem": list(own), "y": y})

    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return frozenset(i + " " for i in INSULTS)
    seen = rows.select("y", "text").mapInPandas(stems, "stem string, y int").groupBy("stem").agg(F.sum("y").alias("a"), (F.count("*") - F.sum("y")).alias("b"))
    odds = ((F.col("a") + 0.5) / (n[1] + 1)) / ((F.col("b") + 0.5) / (n[0] + 1))
    telling = seen.where((F.col("a") >= max(least_docs, 0.01 * n[1])) & (odds >= least_odds))
    return frozenset(r["stem"] for r in telling.select("stem").collect()) | frozenset(i + " " for i in INSULTS)


@dataclass(frozen=True)
class Model:
    stems: frozenset[str]
    steps: tuple[Transformer, ...]
    constant: float | None = None


def fit(docs: DataFrame, labels: DataFrame, *, of: int = 3, held_out: int = 1, most_labelled: int = 12_000) -> Model:
    chosen = chosen_labels(labels, "toxic", of, held_out, most_labelled, per_class=False)
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(10)) < 7), "labelled-texts")
    stems = learned_stems(rows.where("part"))
    known = staged(features(rows.select("doc_id", "y", "part", "text"), stems).coalesce(4), "toxic-features")
    n = {(r["part"], r["y"]): r["n"] for r in known.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    if not n.get((True, 0)) or not n.get((True, 1)):
        bad = sum(v for (_, y), v in n.items() if y)
        return Model(stems, (), bad / sum(n.values()) if n else 0.0)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    ready = assemble.transform(known).select("part", F.col("y").cast("double").alias("y"), "vector")
    trees = GBTClassifier(featuresCol="vector", labelCol="y", maxIter=20, maxDepth=3, stepSize=0.2, seed=3).fit(ready.where("part"))
    rest = ready.where("NOT part") if n.get((False, 0)) and n.get((False, 1)) else ready
    curve = IsotonicRegression(featuresCol="margin", labelCol="y", predictionCol="score").fit(trees.transform(rest).select("y", vector_to_array("probability")[1].alias("margin")))
    return Model(stems, (assemble, trees, curve))


def scored(docs: DataFrame, model: Model, *, of: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    rows = features(docs.select("doc_id", "text"), model.stems)
    if model.constant is not None:
        rows = rows.withColumn("score", F.lit(float(model.constant)))
    else:
        assemble, trees, curve = model.steps
        rows = curve.transform(trees.transform(assemble.transform(rows)).select("doc_id", vector_to_array("probability")[1].alias("margin")))
    rows = rows.select("doc_id", F.coalesce(bucket(F.col("doc_id"), of) == held_out, F.lit(False)).alias("held_out"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
