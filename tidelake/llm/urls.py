"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Training and scoring are DataFrame expressions. The gradient is a sum by feature in fixed point
(1e-12), so that it does not depend on the order of rows; only the gradient, of as many numbers as
the model has features, reaches the driver in an iteration.

Nulls: a null url, or one without "://", has an empty host and path; no rule fits it and the model
judges it. Repeated rows are judged alike. An empty table gives an empty result; without labelled
rows of both kinds the model allows everything. Urls are judged whole; the time for one grows with the
square of its length. Other columns are carried along in the struct row, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, packed, text_or_empty


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Params:
    features: int = 4096
    lengths: tuple[int, ...] = (3, 4)
    #: At most so many labelled rows of either kind are used: those with the smallest hashes.
    max_labelled: int = 1000
    iterations: int = 12
    rate: float = 0.25
    l2: float = 1e-3


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(text_or_empty(url), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), "://[^/?#]*([^?#]*)", 1)


def _grams(text: Column, n: int, tag: str, params: Params) -> Column:
    return F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)),
        lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n))), F.lit(params.features)).cast("int"),
    )).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column, params: Params = Params()) -> Column:
    """The distinct buckets of the n-grams; digits of the path count alike."""
    h, p = F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))
    return F.array_distinct(F.concat(*[_grams(x, n, tag, params) for n in params.lengths for x, tag in ((h, "h"), (p, "p"))]))


def _margin(model: Model, index: Column) -> Column:
    w = F.expr(f"cast(split('{','.join(map(repr, model.weights))}', ',') as array<double>)")
    return F.aggregate(index, F.lit(model.bias), lambda a, i: a + F.get(w, i))


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """labelled: url, label (1: block); a small table, of which a bounded part is used."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("int").alias("y")).distinct()
    half = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("url"), "url").limit(params.max_labelled) for y in (0, 1)]
    data = materialise(half[0].unionByName(half[1]).select("y", features(host, path, params).alias("x")), "url-labels")
    counts = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count("*").alias("n")).collect()}
    w, bias = [0.0] * params.features, 0.0
    if len(counts) < 2:
        return Model(tuple(w), -10.0)
    data = data.coalesce(1)  # bounded: 2 * max_labelled rows
    share = {y: 0.5 / n for y, n in counts.items()}  # both kinds weigh the same
    m, v = [0.0] * (params.features + 1), [0.0] * (params.features + 1)
    for step in range(1, params.iterations + 1):
        p = 1 / (1 + F.exp(-_margin(Model(tuple(w), bias), F.col("x"))))
        error = (p - F.col("y")) * F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
        grad = (data.select(F.explode(F.concat("x", F.array(F.lit(params.features)))).alias("j"),
                            F.round(error * 1e12).cast("long").alias("e"))
                .groupBy("j").agg(F.sum("e").alias("g")))
        g = {r["j"]: r["g"] / 1e12 for r in grad.collect()}
        for j in range(params.features + 1):
            d = g.get(j, 0.0) + (params.l2 * w[j] if j < params.features else 0.0)
            m[j], v[j] = 0.9 * m[j] + 0.1 * d, 0.99 * v[j] + 0.01 * d * d
            move = params.rate * (m[j] / (1 - 0.9 ** step)) / (math.sqrt(v[j] / (1 - 0.99 ** step)) + 1e-6)
            if j < params.features:
                w[j] -= move
            else:
                bias -= move
    return Model(tuple(w), bias)


def judge(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, params: Params = Params(),
          carry: list[str] | None = None) -> DataFrame:
    """row, host, path, rule (the longest that fits, or null), score (probability of block), verdict."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in (pages.columns if carry is None else carry)]
    df = packed(pages).select(F.struct(*kept).alias("row"), host_of(F.col("row.url")).alias("host"),
                              path_of(F.col("row.url")).alias("path"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    score = 1 / (1 + F.exp(-_margin(model, features(F.col("host"), F.col("path"), params))))
    df = df.select("*", name.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    said = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return df.select("row", "host", "path", "rule", "score", said.alias("verdict"))
