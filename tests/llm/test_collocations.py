"""Phrases against a plain count of everything."""

import random
import re
from collections import Counter

import pytest
from test_llm import DOC, frame, result

from tidelake.llm import collocations
from tidelake.llm.queries import op11_collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least, limit):
    """rows: lang, text."""
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update(tuple(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        dropped = {w[i:i + k] for w, a in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 80 * f[w[i:i + k]]}
        scored = []
        for w, a in often.items():
            if w not in dropped:
                score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), " ".join(w), f[w[:k]], f[w[k:]]))
        out += [(lang, r, w, -a, left, right, n[lang], -s) for r, (s, a, _, w, left, right) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=str)


def texts(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Wörter", "ﬁ", "a b", "x\x1ey", "\x7f"]
    weights = [1 / (k + 1) for k in range(len(words))]
    fixed = [r.choices(words[10:], k=k) for k in (2, 2, 3, 3, 4, 4, 5, 6, 8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 14)):
            p = r.choice(fixed) if r.random() < 0.5 else r.choices(words, weights, k=r.randint(1, 6))
            parts.append(p if r.random() < 0.8 else [x.upper() for x in p])
        out.append("".join(r.choice([" ", " ", "  ", "\t", ". ", "; ", "\n", ",", "\r\n", "\x0b"]).join(p) + r.choice([" ", " ", ". ", "!"]) for p in parts))
    return out + [None, "", " \t ", "...", out[0], out[0], "la la la la la " * 30, " ".join(out[:20])]


def pairs(seed):
    r = random.Random(seed)
    return [(r.choice(["en", "en", "en", "de", None, "und", ""]), t) for t in texts(seed)]


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 0, "row", k) for k, (lang, t) in enumerate(rows)], DOC).repartition(3)


@pytest.mark.parametrize("seed,params", [
    (1, collocations.Params(min_count=3)),
    (2, collocations.Params(min_count=3, limit=12, slack=1, block_bytes=1500)),
    (3, collocations.Params(min_count=2, limit=7, slack=2, block_bytes=400)),
    (4, collocations.Params(min_count=4, limit=20, slack=1, languages=1)),
])
def test_phrases(spark, seed, params):
    rows = pairs(seed)
    got = collocations.best_phrases(docs(spark, rows), params)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, params.min_count, params.limit)
    assert len(want) > 20 and result(got) == want


def test_thresholds_leave_phrases_out_and_go_down(spark):
    """With a small limit fewer phrases are counted, and languages that keep too few go on."""
    rows = [("en", t) for t in texts(6, 300)]
    asked = []
    real = collocations._thresholds

    def spy(pairs_, most, languages):
        asked.append(real(pairs_, most, languages))
        return asked[-1]

    collocations._thresholds = spy
    try:
        got = result(collocations.best_phrases(docs(spark, rows), collocations.Params(min_count=3, limit=25, slack=1)))
    finally:
        collocations._thresholds = real
    assert got == plain(rows, 3, 25)
    assert asked[0]["en"] > 0 and len(asked) > 1 and asked[1].get("en", 0) < asked[0]["en"]


def test_expansion_is_bounded(spark):
    """A block's triples are counted only where their bounds, or what they settle, reach the threshold."""
    made = docs(spark, [("en", t) for t in texts(7, 300)]).coalesce(1).select("lang", "text").mapInArrow(
        collocations.block_rows(1 << 20), collocations.PACKED_SQL).toArrow()
    block = collocations.Block.read(next(collocations.rows_of(made, "M")))
    for size in (1, 2):
        p = collocations.Phrases(block)
        keys, counts = collocations.np.unique(p.key(size)[p.possible(2)] if size == 2 else p.word_keys[block.codes[block.codes > 0] - 1], return_counts=True)
        block.known[size] = keys[counts >= 3], counts[counts >= 3]
    p = collocations.Phrases(block)
    at = [len(p.expanded(3, collocations.Thresholds({}, t), 0.8)) for t in (0, 300_000, 800_000, float("inf"))]
    assert at[0] == len(p.possible(3)) and at[0] > at[1] > at[2] > at[3] == 0


def test_phrases_of_nothing(spark):
    assert collocations.best_phrases(spark.createDataFrame([], DOC)).count() == 0
    assert collocations.best_phrases(frame(spark, [(1, None), (2, "")])).count() == 0


def test_scores_beyond_64_bits():
    """2,000,000 a is taken in Python's integers."""
    np = collocations.np
    b = collocations.Block(0, np.array([1, 2, 0]), [b"x", b"y"], np.array([0, 0], np.uint16), ["en"])
    p = collocations.Phrases(b)
    big = 9 * 10 ** 15
    p.counts = {1: np.array([big + 1, big + 7, 0]), 2: np.array([big, 0, 0])}
    row = collocations.json.loads(collocations.zstandard.decompress(collocations.described(p, np.array([0]), 2)))
    assert row == [["en", "x y", 2, big, big + 1, big + 7, 2_000_000 * big // (2 * big + 8)]]


def test_op11(spark, tmp_path):
    rows = [(lang, t) for lang, t in pairs(11) for _ in range(8)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows, 30, 2000)
    assert want and result(op11_collocations(spark, str(tmp_path))) == want


def test_a_pair_is_sent_in_a_few_bytes():
    """A block's distinct pairs go out as the numbers of their words; hashes and checks took twelve bytes and more."""
    np, r = collocations.np, random.Random(5)
    words = [f"w{k}".encode() for k in range(2000)]
    b = collocations.Block(0, np.array([r.randint(1, 2000) for _ in range(60_000)]), words, np.zeros(2000, np.uint16), ["en"])
    keys = np.sort(collocations.Phrases(b).word_keys)
    b.known[1] = keys, np.full(2000, 30)
    batches = collocations.table_of([b.row()]).to_batches()
    out = [row for part in collocations.string_rows(2, 4)(iter(batches)) for row in part.to_pylist()]
    pairs = len(set(zip(b.codes.tolist(), b.codes[1:].tolist())))
    assert pairs > 50_000 and sum(len(row[x]) for row in out for x in ("tokens", "docs", "extra")) < 4 * pairs


def test_blocks_are_written_three_times(spark):
    """Counting triples and four words reads the blocks, but writes no table of them."""
    real, holding = collocations.materialise, []

    def spy(df, name):
        out = real(df, name)
        if "kind" in out.columns and out.filter("kind = 'M'").count():
            holding.append(name)
        return out

    collocations.materialise = spy
    try:
        got = result(collocations.best_phrases(docs(spark, pairs(9)), collocations.Params(min_count=3, limit=30, slack=2)))
    finally:
        collocations.materialise = real
    assert got == plain(pairs(9), 3, 30) and len(holding) == 3


@pytest.mark.parametrize("bits", [2, 3, 17, 34, 41, 63, 64])
def test_keys_give_their_numbers_back(bits):
    np, r = collocations.np, random.Random(bits)
    numbers = np.unique(np.array([0, 1, (1 << bits) - 1, *(r.getrandbits(bits) for _ in range(500))], np.uint64))
    keys = np.sort(collocations.scrambled(numbers, bits))
    assert len(np.unique(keys)) == len(numbers)
    again = collocations.unsmall_keys(collocations.small_keys(keys, bits), bits)
    assert again.tolist() == keys.tolist() and np.sort(collocations.unscrambled(again, bits)).tolist() == numbers.tolist()


def test_scores_of_longer_phrases(spark):
    """Beyond 64 bits, the first of equal cuts, and none where a part's count is not known."""
    big = 9 * 10 ** 15
    rows = spark.createDataFrame([(1, big, big + 1, big + 7, big + 2, big + 6), (2, 30, 40, 60, 50, 50), (3, 30, 40, 60, None, 50)],
                                 "id long, a long, x long, y long, u long, v long")
    got = collocations._scored(rows, [("x", "y"), ("u", "v")], 3).orderBy("id").select("l", "r", "score", "size").collect()
    assert [tuple(r) for r in got] == [(big + 1, big + 7, 2_000_000 * big // (2 * big + 8), 3), (40, 60, 600_000, 3), (None, None, None, 3)]
