"""Severity of toxic text by cumulative-link ordinal regression.

The model has one weight for each of a bounded number of word features, shared by all thresholds:
P(grade <= k) = logistic(threshold_k - x.w). It is fitted on at most max_rows labelled documents
(those with the smallest hashes), a documented bound. Their words are counted by Spark; what reaches
the driver is max_features words and, for each of the max_rows documents, its grade and which of
these words it has, so the gradient steps run there. Scoring runs in tasks, over whole texts.

Nulls: a null or empty text has no features and gets the grade that the thresholds alone give; a
null grade leaves the row out of the fit. Repeated rows score alike. An empty table gives an empty
result; without labelled rows of two grades, every document scores 0. A text of any length is the
set of its distinct words, which a task holds whole. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, materialise

EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"


@dataclass(frozen=True)
class Params:
    max_rows: int = 4000
    max_features: int = 2000
    min_docs: int = 3
    #: Log odds ratio over its standard error: at least this for a feature, and for a word that grades are counted by.
    min_z: float = 3.0
    grade_z: float = 5.0
    #: Words that grades are counted by, at most.
    grade_words: int = 200
    l2: float = 0.02
    iterations: int = 300
    rate: float = 0.1


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    thresholds: tuple[float, ...]


def features(text: str | None) -> set[bytes]:
    """The distinct words, A-Z in lower case, without punctuation at their ends."""
    return {w.strip(EDGES) for w in (text or "").encode().lower().split()} - {b""}


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_lists(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([sorted(w.decode() for w in features(t)) for t in s], dtype=object)


def bounded(labelled: DataFrame, params: Params) -> DataFrame:
    """The sample of the fit: words (distinct), grade. The hashes are cut first, so that no other row's words are made."""
    rows = labelled.filter("text is not null and grade is not null").select(F.xxhash64("text").alias("h"), "text", "grade")
    cut = rows.select("h").orderBy("h").limit(params.max_rows).agg(F.max("h")).first()[0]
    rows = rows.filter(F.col("h") <= F.lit(cut).cast("long")).select("h", word_lists("text").alias("words"), "grade")
    return materialise(rows.orderBy("h", "words", "grade").limit(params.max_rows).select("words", "grade"), "toxicity-sample")


def telling(sample: DataFrame, least_z: float, params: Params) -> list[tuple[float, str]]:
    """(z, word), by falling |z|, ties by word: the log odds ratio of a word over its standard error, of graded against grade 0."""
    n = sample.agg(F.count_if(F.col("grade") > 0).alias("n1"), F.count_if(F.col("grade") <= 0).alias("n0")).first()
    a, b, n1, n0 = F.col("a"), F.col("b"), max(1, n["n1"]), max(1, n["n0"])
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    counts = (sample.select(F.explode("words").alias("word"), "grade").groupBy("word")
              .agg(F.count_if(F.col("grade") > 0).alias("a"), F.count_if(F.col("grade") <= 0).alias("b")).filter(a + b >= params.min_docs))
    rows = counts.select((odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).alias("z"), "word").filter(F.abs("z") > least_z)
    return [(r["z"], r["word"]) for r in rows.orderBy(F.abs("z").desc(), "word").limit(params.max_features).collect()]


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """labelled: text, grade (0, 1, 2, ...)."""
    sample = bounded(labelled, params)
    if sample.select("grade").distinct().limit(2).count() < 2:
        return Model({}, ())
    index = {w: j for j, (_, w) in enumerate(telling(sample, params.min_z, params))}
    known = F.array_intersect("words", F.array(*map(F.lit, index)).cast("array<string>"))
    rows = sorted((r["grade"], sorted(index[w] for w in r["known"])) for r in sample.select("grade", known.alias("known")).collect())
    drop_tables(sample)
    grade = np.array([g for g, _ in rows], int)
    doc = np.repeat(np.arange(len(rows)), [len(w) for _, w in rows])
    word = np.array([j for _, w in rows for j in w], int)
    levels = int(grade.max())
    w, step = np.zeros(len(index)), np.full(levels - 1, 1.0)
    first = np.array([np.log((np.mean(grade <= 0) + 1e-3) / (1 - np.mean(grade <= 0) + 1e-3))])
    theta = [w, first, np.log(step)]
    moment, square = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for it in range(1, params.iterations + 1):
        w, first, gaps = theta
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])  # rising by construction
        x = np.bincount(doc, w[word], len(rows))
        p = 1 / (1 + np.exp(-np.clip(cuts[None, :] - x[:, None], -30, 30)))
        full = np.concatenate([np.zeros((len(rows), 1)), p, np.ones((len(rows), 1))], 1)
        r = np.arange(len(rows))
        prob = np.maximum(full[r, grade + 1] - full[r, grade], 1e-9)
        slope = np.concatenate([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))], 1)
        up, down = slope[r, grade + 1] / prob, slope[r, grade] / prob
        g_x = (up - down) / len(rows)
        g_cuts = np.zeros(levels + 2)
        np.add.at(g_cuts, grade + 1, -up / len(rows))
        np.add.at(g_cuts, grade, down / len(rows))
        g_cuts = g_cuts[1:-1]
        tail = np.cumsum(g_cuts[::-1])[::-1]
        grads = [np.bincount(word, g_x[doc], len(index)) + params.l2 * w / len(rows), tail[:1], tail[1:] * np.exp(gaps)]
        for k, g in enumerate(grads):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            theta[k] = theta[k] - params.rate * (moment[k] / (1 - 0.9 ** it)) / (np.sqrt(square[k] / (1 - 0.999 ** it)) + 1e-8)
    w, first, gaps = theta
    cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    return Model({x.encode(): float(w[j]) for x, j in index.items()}, tuple(map(float, cuts)))


def expected_severity(text: Column, model: Model) -> Column:
    """The sum over grades k of P(grade >= k)."""
    weights, cuts = model.weights, np.array(model.thresholds)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = weights.keys()
        for s in batches:
            x = np.array([sum(sorted(weights[w] for w in features(t) & known)) for t in s], float)
            yield pd.Series((1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -30, 30)))).sum(axis=1))

    return score(text)


def graded(docs: DataFrame, params: Params = Params(), cuts: tuple[int, ...] = (2, 4)) -> DataFrame:
    """text, grade from text, toxic (0 or 1): toxic documents are graded by how many toxic words they have.

    The words are those that tell toxic from other documents best in the bounded sample. Grade 0 is
    not toxic; a toxic document has grade 1, and one more for each of cuts that it reaches.
    """
    sample = bounded(docs.select("text", F.col("toxic").alias("grade")), params)
    terms = [w for z, w in telling(sample, params.grade_z, params) if z > 0][:params.grade_words]
    drop_tables(sample)
    found = F.size(F.array_intersect(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), F.array(*map(F.lit, terms)).cast("array<string>")))
    level = F.lit(1)
    for c in cuts:
        level = level + (found >= c).cast("int")
    return docs.select("text", F.when(F.col("toxic") > 0, level).when(F.col("toxic") == 0, F.lit(0)).alias("grade"))
