"""The URL model on paths, its scores against a plain sum, and odd urls."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelake.llm import queries, url_labels, urls


@pytest.fixture(scope="module")
def model(spark):
    rows = url_labels.url_labels() + url_labels.path_labels(lambda k: k % 4)
    return urls.fit(url_labels.labelled(spark, rows))


def test_paths_are_told_apart_by_themselves(spark, model):
    """Paths that the fit has not seen, on a host that both kinds have."""
    held_out = spark.createDataFrame(url_labels.path_labels(lambda k: k % 4 == 0), "url string, y int")
    n = Counter((r.y, r.verdict) for r in urls.judge(held_out, model, rules=()).select("row.y", "verdict").collect())
    assert n[1, "block"] > 0.6 * (n[1, "block"] + n[1, "allow"]) and n[0, "allow"] > 0.55 * (n[0, "allow"] + n[0, "block"])


def plain_score(spark, url, model, params=urls.Params()):
    """The probability of block, term by term."""
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (found[1].translate({i: i + 32 for i in range(65, 91)}), found[2]) if found else ("", "")
    grams = {(tag, x[i:i + n]) for n in params.lengths for tag, x in (("h", f"^{host}$"), ("p", re.sub("[0-9]+", "0", path) + "$")) for i in range(len(x) - n + 1)}
    if not grams:
        return 1 / (1 + math.exp(-model.bias)), host, path
    df = spark.createDataFrame(sorted(grams), "tag string, g string")
    buckets = {r[0] for r in df.select(F.pmod(F.xxhash64("tag", "g"), F.lit(params.features))).collect()}
    return 1 / (1 + math.exp(-(model.bias + math.fsum(model.weights[b] for b in buckets)))), host, path


def test_scores_are_plain_sums(spark, model):
    odd = ["http://WWW.Casino-Ä.example.com/A/12?x#y", "http://a", "no scheme", None, "://", "x://h#f", "http://h/" + "long/" * 300, "http://a\n/b", "http://a", ""]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(odd)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df, model, rules=()).select("row.page_id", "host", "path", "score", "verdict").collect()}
    for i, u in enumerate(odd):
        score, host, path = plain_score(spark, u, model)
        assert (got[i].host, got[i].path) == (host, path) and abs(got[i].score - score) < 1e-9
        assert got[i].verdict == ("block" if score >= 0.5 else "allow")


def test_no_pages_and_null_labels(spark, model):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0
    rows = [(u, y) for u, y in url_labels.path_labels()]
    fitted = urls.fit(spark.createDataFrame(rows, "url string, label int"), urls.Params(iterations=2))
    assert fitted == urls.fit(spark.createDataFrame([*rows, ("http://a/b", None), (None, 1), *rows[:5]], "url string, label int"), urls.Params(iterations=2))


def test_op3_returns_every_page(spark, tmp_path):
    pages = [(i, u, "x") for i, u in enumerate([None, "", "http://example.net/", "http://a.example.net/en/x", "http://example.com/de/1", "http://b.org/fr/", "http://example.com/en/"] * 2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op3_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and [got[i] for i in (2, 3, 4, 5)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert got[0][0] is None and got[6][0] is None
