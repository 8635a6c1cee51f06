"""Passage removal against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from test_llm import DOC, frame, result

from tidelake.llm import passages
from tidelake.llm.queries import op13_passages

SPAN = 50


def plain(pairs):
    """doc_id, n_words, n_removed, n_spans, kept of each row."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in pairs]
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in docs:
        for p in range(len(w) - SPAN + 1):
            g = tuple(w[p:p + SPAN])
            first[g] = min(first.get(g, float("inf")), key(i))
    out = []
    for i, w in docs:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - SPAN + 1):
            if first[tuple(w[p:p + SPAN])] < key(i):
                gone[p:p + SPAN] = True
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        out.append((i, len(w), int(gone.sum()), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def passage_corpus(seed=3, n=60):
    """Copies, passages of 45 to 200 words in many documents, passages in passages, repeats inside a document, and edge cases."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "ﬁ", "a b", "W1"]
    some = lambda n: r.choices(words, k=n)
    pool = [some(k) for k in (45, 49, 50, 51, 80, 200)]
    out, texts = [], []
    for i in range(n):
        w = some(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            p = r.choice(pool)
            a = r.randint(0, max(0, len(p) - 50))
            w = w + p[a:] + some(r.randint(0, 5))
        if r.random() < 0.2 and texts:
            w = r.choice(texts)[:]
        if r.random() < 0.1:
            w = w + ["same"] * r.randint(40, 130)
        texts.append(w)
        out.append((i * 3, r.choice([" ", "\n", " \t "]).join(w)))
    out += [(5000, None), (5001, ""), (5002, " \t\n "), (None, out[0][1]), (None, None), out[7], (out[7][0], out[7][1]), (5003, " ".join(words * 60))]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("params", [passages.Params(), passages.Params(hot_docs=3, block_bytes=3000, part_bytes=4000),
                                    passages.Params(hot_docs=1 << 30, block_bytes=500, part_bytes=1 << 20)])
def test_passages(spark, params):
    pairs = passage_corpus()
    got = passages.remove_passages(frame(spark, pairs), params)
    assert got.columns == ["doc_id", "n_words", "n_removed", "n_spans", "kept"]
    assert result(got) == plain(pairs)


def test_passages_of_nothing(spark):
    assert passages.remove_passages(spark.createDataFrame([], DOC)).count() == 0


def test_op13_reads_the_whole_table(spark, tmp_path):
    pairs = passage_corpus(seed=8, n=40)
    frame(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, _, t in plain(pairs)], key=str)
    assert result(op13_passages(spark, str(tmp_path))) == want


def test_inner_nodes_are_the_maximal_repeats():
    """Against all pairs of positions: what agrees on SPAN words or more and cannot go on to either side."""
    r = random.Random(2)
    core = [r.randint(1, 9) for _ in range(70)]
    strings = [[1, *core[:60], 2], [3, *core, 4], [5, *core[5:], 4], [r.randint(1, 9) for _ in range(90)]]
    codes, sizes = np.array([c for s in strings for c in s], np.int32), np.array(list(map(len, strings)))
    ids = np.arange(len(strings))
    found = {(tuple(strings[s][a:b])) for part in passages.SuffixTree(codes, sizes).maximal_repeats(ids, ids)
             for s, a, b, _ in zip(*[x.tolist() for x in part])}
    want = set()
    for i, s in enumerate(strings):
        for t in strings[i + 1:]:
            for a in range(len(s)):
                for b in range(len(t)):
                    if a and b and s[a - 1] == t[b - 1]:
                        continue
                    n = 0
                    while a + n < len(s) and b + n < len(t) and s[a + n] == t[b + n]:
                        n += 1
                    if n >= SPAN:
                        want.add(tuple(s[a:a + n]))
    assert want and found == want
