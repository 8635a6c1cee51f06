"""The queries themselves against their SQL, on small tables with odd rows."""

import random

import duckdb
import pytest
from test_llm import corpus
from test_passages import passage_corpus

from tidelake.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, r = tmp_path_factory.mktemp("tables"), random.Random(6)
    texts = [t for _, t in corpus(seed=12, n=90)] + [t for _, t in passage_corpus(seed=5, n=40)] + ["new york city hall . new york city hall ; " * 40, "É É é é " * 60]
    docs = [(i * 5, t, ["en", "de", None, "und"][i % 4], ["s1", "é", None, "s2", "s3"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    html = ["<p>" + "x" * 1200, "<p>" + "x" * 1200, "short", "short", None, "", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 5000, "é" * 600, "é" * 600, "z" * 300_000]
    pages = [(i, [None, "http://a/é b", "u"][i % 3], h) for i, h in enumerate(html * 2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{root}/pages.parquet")
    nan = float("nan")
    vectors = [(i, [r.gauss(0, 0.3) + (j == i % 3) for j in range(8)], i % 5) for i in range(260)]
    vectors += [(300, None, 1), (350, [nan] * 8, 1), (400, [0.0] * 8, 1), (450, vectors[3][1], None), (500, vectors[3][1], 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{root}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet/*.parquet')")
    return str(root), con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_sql_agree(spark, tables, name):
    root, con = tables
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    df = queries.QUERIES[name](spark, root)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    near = lambda rows: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=str)
    assert near(got) == near(want) and len(want) > 0
