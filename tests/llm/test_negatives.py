"""Hard negatives against a plain search."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm import result

from tidelake.llm import negatives
from tidelake.llm.queries import op12_negatives

SCHEMA = "id long, label int, embedding array<double>, is_anchor boolean, key string, row string"


def plain(rows, k=5, m=3):
    ok = [(n, i, lab, [math.floor(256 * x) for x in v], anchor) for n, (i, lab, v, anchor, *_) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, i, lab, v, anchor in ok:
        if anchor:
            scored = [(sum(a * b for a, b in zip(v, w)), j, other) for q, j, other, w, _ in ok if q != n]
            for ps, p, _ in sorted([x for x in scored if x[2] == lab], key=order)[:k]:
                fit = sorted([x for x in scored if x[2] != lab and 50 * ps <= 100 * x[0] <= 95 * ps], key=order)[:m]
                out += [(i, p, r, q, ps, s) for r, (s, q, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors(seed, n=150, dim=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        v = [x + r.gauss(0, 0.6) for x in r.choice(centres)]
        if r.random() < 0.3 and rows:
            v = r.choice(rows)[2]  # ties
        rows.append((i, r.randint(0, 3), v, i % 10 == 0, "k", "r"))
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, centres[0], True, "k", "r"), (901, 1, None, True, "k", "r"), (902, 1, [nan] * dim, True, "k", "r"), (903, 1, [inf, *centres[0][1:]], False, "k", "r"),
             (904, 1, [None, *centres[0][1:]], False, "k", "r"), (None, 1, centres[1], False, "k", "r"), (None, 2, centres[1], True, "k", "r"), rows[10], rows[10], rows[20],
             (905, 1, [0.0] * dim, True, "k", "r"), (906, 7, centres[2], True, "k", "r"), (907, 2, [-x for x in centres[0]], True, "k", "r")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("params", [negatives.Params(), negatives.Params(block_rows=16, anchor_rows=4, anchor_group=2, references=3)])
def test_negatives(spark, params):
    rows = vectors(1)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), params)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows)
    assert len(want) > 100 and result(got) == want


def test_large_and_uneven_vectors(spark):
    """Scores beyond 53 and 64 bits, vectors of several lengths, and an empty one."""
    r = random.Random(5)
    rows = [(i, i % 2, [r.uniform(0.2, 1) * 2.0 ** r.choice([0, 1, 23]) for _ in range(r.choice([2, 3]))], i % 5 == 0, "k", "r") for i in range(40)]
    rows += [(50, 0, [], True, "k", "r"), (51, 1, [2.0 ** 30, 2.0 ** 29], True, "k", "r"), (52, 1, [1.9 * 2.0 ** 29, 2.0 ** 29], False, "k", "r")]
    clip = lambda s: max(-(2 ** 63 - 1), min(2 ** 63 - 1, s))
    want = sorted([(a, p, k, n, clip(ps), clip(s)) for a, p, k, n, ps, s in plain(rows)], key=str)
    got = result(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), negatives.Params(block_rows=10)))
    assert any(x[4] == 2 ** 63 - 1 for x in want) and got == want


def test_without_anchors_or_rows(spark):
    rows = [(i, 0, [1.0, 2.0], False, "k", "r") for i in range(5)]
    assert negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op12(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, r.randint(0, 9), [r.gauss(0, 0.2) for _ in range(8)]) for i in range(220)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [float(np.float32(x)) for x in v], i % 50 == 0) for i, lab, v in rows]
    assert result(op12_negatives(spark, str(tmp_path))) == plain(moved)


def block(v, ids, angles, norms):
    n = len(v)
    return negatives.Block(np.arange(n), ids, np.zeros(n, np.int64), v, norms, angles, [])


def test_bounds_hold_the_scores_and_leave_some_out():
    r = np.random.default_rng(4)
    centres = r.normal(size=(5, 16)) * 400
    v = np.floor(np.repeat(centres, 40, axis=0) + r.normal(size=(200, 16)) * 60)
    norms, angles = negatives.angles_to(v, negatives.farthest_first(v, 8))
    b = block(v, np.arange(200), angles, norms)
    low, high = negatives.bounds(b, np.arange(50), b, np.arange(200))
    exact = negatives.scores(v[:50], v)
    assert (low <= exact).all() and (exact <= high).all()
    window = exact.max(axis=1, keepdims=True) * 0.9
    assert (high < window).mean() > 0.5


def test_scores_are_exact():
    a, v = np.array([[2.0 ** 40, 3.0], [2.0 ** 31, 1.0]]), np.array([[2.0 ** 40, 1.0], [5.0, 7.0]])
    whole = lambda m: [[int(x) for x in row] for row in m]
    assert negatives.scores(a, v).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in whole(v)] for p in whole(a)]
    assert negatives.matrix(pa.array([[1.0], [], [2.0, 3.0]])).tolist() == [[1, 0], [0, 0], [2, 3]]
