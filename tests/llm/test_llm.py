"""Each operator against a plain version, on small tables with nulls, ties, long texts and clashing columns."""

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tidelake.llm.common import in_file_order, materialise
from tidelake.llm import jaccard, lines, media, mixing, packing, quality, suffix, toxicity, urls, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, size int"
WORDS = [f"w{i}" for i in range(300)]


def corpus(seed=1, n=60):
    """Random documents with copies, near copies, shared lines and passages, nulls, repeated rows and a long text."""
    r = random.Random(seed)
    passage = " ".join(r.choices(WORDS, k=40))
    out, texts = [], []
    for i in range(n):
        kind = r.random()
        words = r.choices(WORDS, k=r.randint(8, 120))
        if kind < 0.2 and texts:
            text = r.choice(texts)
        elif kind < 0.5 and texts:
            words = r.choice(texts).split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            text = " ".join(words)
        elif kind < 0.65:
            text = " ".join(words) + "\n" + passage + "\n" + " Common LINE \n" + r.choice(WORDS)
        else:
            text = "\n".join([" ".join(words), "Common line", "", " ".join(r.choices(WORDS, k=3))])
        texts.append(text)
        out.append((i * 3, text))
    out += [(1000, None), (1001, ""), (1002, " \t\n "), (None, texts[0]), (out[5][0], out[5][1]), (out[5][0], out[5][1]), (1003, "É um\u00a0 two"),
            (1004, "a b c d"), (1005, "A b C d"), (1006, " ".join(WORDS * 40)), (None, None), (7, "   x\r\n\x0b\x0c y  ")]
    r.shuffle(out)
    return out


def frame(spark, pairs, parts=3):
    rows = [(i, t, ["en", "de", None][k % 3], ["s1", "s2", "s3", None, "é"][k % 5], len(t or ""), "row", k) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, DOC).repartition(parts)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- quality

def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls), len(ls) - len(set(ls)), len(covered)


def test_quality_counts(spark):
    pairs = [*corpus(), (2000, "a b c d e f g h a b c d e f g h x"), (2001, "x " * 40), (2002, "# * $%\n&|<>\n&|<>\n"), (2003, "é🙂 " * 9)]
    got = quality.measure(frame(spark, pairs)).select("row.size", *quality.COUNTS, "base_failed").collect()
    assert len(got) == len(pairs)
    for r in got:
        want = plain_counts(pairs[r["size"]][1])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[5] > 30 * want[0])


def test_quality_thresholds(spark):
    rules = quality.Rules(min_rows=10)
    good = [(i, " ".join(f"word{(i * 7 + k) % 97}" for k in range(30))) for i in range(60)]
    bad = [(100 + i, " ".join(f"word{k}###$$$" for k in range(30))) for i in range(4)]
    df = frame(spark, good + bad + [(200, None), (201, "short")])
    kept = {r.doc_id for r in quality.keep_good(df, rules).collect()}
    assert kept == {i for i, _ in good}
    assert quality.keep_good(df, rules).columns == df.columns
    assert quality.keep_good(df.limit(0), rules).count() == 0


def test_sketches_merge(spark):
    df = materialise(quality.measure(frame(spark, corpus())), "measured")
    whole = quality.sketch(df).groupBy("measure", "edge").agg(F.sum("n")).collect()
    parts = [quality.sketch(df.filter(f"row.size % 2 = {k}")) for k in (0, 1)]
    both = parts[0].unionByName(parts[1]).groupBy("measure", "edge").agg(F.sum("n")).collect()
    assert sorted(whole) == sorted(both)
    edges = spark.range(1, 5000).select(F.col("id"), quality._bin(F.col("id")).alias("e")).collect()
    assert all(r.e <= r.id < r.e + max(1, r.e / 32) for r in edges)


def prose(r, n=120):
    """Words of four letters in lines of ten, all different."""
    w = [f"{r.randrange(36 ** 4):04x}"[:4] for _ in range(n)]
    return [" ".join(w[k:k + 10]) for k in range(0, n, 10)]


def test_limits_follow_each_group_and_each_measure_rejects(spark):
    """Two sources of different habits get different limits for each measure, and a row beyond one of them alone goes."""
    r = random.Random(3)
    docs = []
    for i in range(200):  # prose: short words, one document in ten with a few symbols or a repeated line
        t = prose(r)
        t = [*t, t[0]] if i % 10 == 1 else t
        docs.append((i, "\n".join(t) + (" & $" * 4 if i % 10 == 0 else ""), "prose"))
    for i in range(200, 400):  # code: long words, symbols everywhere, many repeated lines
        t = [x.replace(" ", "and") for x in prose(r, 400)]
        t = [y for x in t for y in (x + " $x = # b", "} end %")]
        docs.append((i, "\n".join(t), "code"))
    extra = {1000: ("\n".join(prose(r)) + " #" * 40, "prose"), 1001: ("\n".join([*prose(r), *["the same line again"] * 12]), "prose"),
             1002: (" ".join(x * 4 for x in " ".join(prose(r)).split()), "prose"), 1003: ("\n".join(prose(r)), "prose")}
    rows = [(i, t, "en", s, 0, "row", 0) for i, t, s in docs] + [(i, t, "en", s, 0, "row", 0) for i, (t, s) in extra.items()]
    measured = materialise(quality.measure(spark.createDataFrame(rows, DOC)), "measured")
    limits = quality.thresholds(quality.sketch(measured))
    by = {x.source: x.asDict() for x in limits.collect()}
    for c in ("hi_word_len", "lo_word_len", "hi_symbols", "hi_dup_lines"):
        assert by["prose"][c] != by["code"][c]
    kept = {x["row"].doc_id: x.kept for x in quality.judge(measured, limits).collect()}
    assert [kept[i] for i in extra] == [False, False, False, True]
    assert all(kept[i] for i in range(400))
    value = lambda row, m: 1000 * row[m.top] // row[m.bottom]
    measures = quality.Rules().measures
    for row in measured.filter("row.doc_id in (1000, 1001, 1002)").collect():
        own = by["prose"]
        broken = [x for x, m in measures.items() if value(row, m) > own[f"hi_{x}"] or (m.both and value(row, m) < own[f"lo_{x}"])]
        assert broken == [["symbols"], ["dup_lines"], ["word_len"]][row["row"].doc_id - 1000]


# ---- lines

def plain_lines(pairs, least):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    docs = Counter(k for _, t in pairs for k in {key(x) for x in (t or "").split("\n")} if k)
    for _, t in pairs:
        own = (t or "").split("\n")
        left = [x for x in own if docs[key(x)] < least or not key(x)]
        yield len(own), len(own) - len(left), "\n".join(left)


def test_lines(spark):
    pairs = [*corpus(), (3000, "\n".join(["common line"] * 500)), (3001, "ÉCOLE\n COMMON LINE\t\nx")]
    got = lines.drop_common_lines(frame(spark, pairs), 10).select("row.size", "n_lines", "n_dropped", "kept").collect()
    want = list(plain_lines(pairs, 10))
    assert {r["size"]: tuple(r)[1:] for r in got} == dict(enumerate(want)) and sum(w[1] for w in want) > 500
    out = lines.with_lines_dropped(frame(spark, pairs), 10)
    assert out.columns == frame(spark, pairs).columns
    assert all(r.text == (want[r["size"]][2] if pairs[r["size"]][1] is not None else None) for r in out.collect())
    assert lines.with_lines_dropped(frame(spark, pairs).limit(0)).count() == 0


# ---- Jaccard

def plain_components(pairs):
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(pairs):
        ids = [x for x in least[find(k)] if x is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [jaccard.Params(), jaccard.Params(block_docs=7, frequent=2, open_per_token=0.0)])
def test_jaccard(spark, params):
    pairs = corpus(seed=4, n=120)
    r = random.Random(9)
    base = r.choices(WORDS, k=60)  # a large group of near copies, some of them on the border
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = r.choice(WORDS)
        pairs.append((5000 + i, " ".join(w)))
    got = result(jaccard.components(frame(spark, pairs), params).select("doc_id", "n_shingles", "component_id"))
    assert got == plain_components(pairs)


def test_jaccard_of_common_passages(spark, monkeypatch):
    """Documents made of common passages and yet dissimilar: few of the open pairs, whose number is of the square, are written."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    pool = [" ".join(r.choices(words, k=20)) for _ in range(30)]
    pairs = [(i, " ".join(r.sample(pool, 10))) for i in range(400)]
    pairs += [(400 + i, pairs[i][1] + " and more words") for i in range(0, 40, 2)]
    real, written = jaccard.materialise, {}

    def counted(df, name):
        out = real(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    params = jaccard.Params(open_per_token=0.0, max_rounds=2)
    got = result(jaccard.components(frame(spark, pairs), params).select("doc_id", "n_shingles", "component_id"))
    assert got == plain_components(pairs)
    assert sum(written["open-signed"]) > 0 and sum(written["open-pairs"]) <= 400


def test_jaccard_rounds_after_the_first_read_open_sets_only(spark, monkeypatch):
    """Near copies of two texts in long lists, and documents that are settled by the first round: their sets are not moved again."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    pool = [" ".join(r.choices(words, k=20)) for _ in range(12)]
    pairs = [(i, " ".join(r.sample(pool, 6))) for i in range(40)]
    for i in range(60):
        text = " ".join(r.choices(words, k=60))
        pairs += [(100 + 2 * i, text), (101 + 2 * i, text + " more")]
    real, read = jaccard.similar, []

    def counted(links, classes):
        read.append(classes.count())
        return real(links, classes)

    monkeypatch.setattr(jaccard, "similar", counted)
    got = result(jaccard.components(frame(spark, pairs)).select("doc_id", "n_shingles", "component_id"))
    assert got == plain_components(pairs)
    assert len(read) > 1 and read[0] >= 120 and max(read[1:]) <= 40


def test_signatures_never_differ_more_than_sets(spark):
    r = random.Random(8)
    sets = [[r.randrange(-2**47, 2**47) << 16 for _ in range(r.choice([0, 1, 5, 300, 4000]))] for _ in range(6)]
    sets += [s[r.randrange(1, 40):] + [r.randrange(2**47) << 16] for s in sets if len(s) > 40]
    rows = [(i, len(s) + i % 3, s) for i, s in enumerate(sets)]
    signed = {x.id: x for x in jaccard.signatures(spark.createDataFrame(rows, "id long, n long, shared array<long>")).collect()}
    bits = lambda x: [x[f"s{k}"] & (2**64 - 1) for k in range(jaccard.SIGNATURE)]
    for i, s in enumerate(sets):
        assert signed[i].rest == i % 3
        for j, t in enumerate(sets):
            apart = sum((a ^ b).bit_count() for a, b in zip(bits(signed[i]), bits(signed[j])))
            assert apart <= len(set(s) ^ set(t)) and (apart - len(set(s) ^ set(t))) % 2 == 0


def test_one_of_each(spark):
    pairs = corpus(seed=4)
    df = frame(spark, pairs)
    out = jaccard.one_of_each(df)
    want = plain_components(pairs)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns
    assert sorted(i for i in kept if i is not None) == sorted({i for i, n, c in want if n and c is not None and i == c} | {i for i, n, c in want if not n and i is not None})
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_without_ids_or_with_repeated_ids(spark):
    r = random.Random(11)
    text = lambda: " ".join(r.choices(WORDS, k=40))
    alone = [(None, text()) for _ in range(25)] + [(5, text()), (5, text()), (None, None), (None, ""), (None, " "), (6, ""), (6, "")]
    t, u, v = text(), text(), text()
    pairs = alone + [(None, t), (None, t), (8, u), (None, u), (5, v), (5, v), (9, v)]
    out = jaccard.one_of_each(frame(spark, pairs))
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted(got, key=str) == sorted([*alone, (None, t), (8, u), (5, v)], key=str)


def test_prefix_sizes():
    for n in range(1, 400):
        need = -(-75 * n // 100)
        assert jaccard.prefix_size(n) == n - need + 1


# ---- repeats

def plain_repeats(pairs):
    first = {}
    rows = [(suffix.NO_ID if i is None else i, k, (t or "").encode()) for k, (i, t) in enumerate(pairs)]
    for i, _, b in rows:
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, k, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = len([m for m in re.finditer(b"\1+", bytes(gone))])
        out.append((pairs[k][0], len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [suffix.Params(), suffix.Params(hot_docs=3, block_bytes=3000, part_bytes=500)])
def test_repeats(spark, params):
    pairs = corpus(seed=6, n=90) + [(6000, "ab" * 200), (6001, "x" + "ab" * 60), (6002, "é" * 80), (6003, "é" * 30), (6004, "\0" * 70 + "x"), (6005, "\0" * 60)]
    pairs += [(7000 + i, f"{i} before " * (i % 3) + "a passage that very many documents have in common, word for word" + f" after {i}" * 9) for i in range(30)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(frame(spark, pairs), params).collect()), key=str)
    assert got == plain_repeats(pairs)
    assert suffix.remove_repeats(frame(spark, pairs).limit(0), params).count() == 0


def test_a_long_text_of_few_kinds_of_windows(spark):
    pairs = [(1, "ab" * 100_000), (2, "z" * 300_000 + "q"), (3, "ab" * 30 + "z" * 60)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(frame(spark, pairs)).collect()]
    assert sorted(got) == [(1, 200_000, 0, 0), (2, 300_001, 0, 0), (3, 120, 120, 1)]


def test_a_block_sends_a_passage_once():
    r = random.Random(5)
    passage = bytes(r.choices(b"abcdefgh ", k=150))
    sizes = np.full(200, 150, np.int64)
    block = (7, "M", 7, zstandard.compress(passage * 200), suffix.small(sizes.astype(np.uint64)), suffix.small(np.array([*range(1, 200), suffix.NO_ID])))
    first, count, m = suffix.window_runs(np.frombuffer(passage, np.uint8), np.array([150]))
    anchor = (0, "R", 7, suffix.planes(np.unique(m)), bytes(len(m)), b"")
    sent = suffix.stretches(1)(suffix.table_of([block, anchor]))
    facts = [suffix.unsmall(c[8:], np.int64).reshape(3, -1) for _, _, _, c in suffix.rows_of(sent, "S")]
    assert sum(f.shape[1] for f in facts) == len(first)  # 200 times that before
    marks = suffix.mark_bucket(1 << 20)(sent)
    cut = suffix.cut_block(pa.concat_tables([suffix.table_of([block]), marks])).to_pylist()
    assert [x["n_removed"] for x in cut] == [0] + [150] * 199


def test_runs_cover_all_windows():
    r = random.Random(4)
    texts = [bytes(r.choices(b"abc", k=r.choice([0, 10, 49, 50, 51, 300, 2000]))) for _ in range(60)] + [b"x" * 500]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    whole, suffix.RUN = suffix.RUN, 777
    try:
        first, count, m = suffix.window_runs(data, sizes)
    finally:
        suffix.RUN = whole
    starts = np.cumsum(sizes) - sizes
    want = [a + k for a, n in zip(starts.tolist(), sizes.tolist()) for k in range(n - 49)]
    assert [a + k for a, n in zip(first.tolist(), count.tolist()) for k in range(n)] == want and count.max() <= suffix.LONGEST
    least = suffix.minimizers(data)
    number = {}
    assert all((least[a:a + n] == least[a]).all() and number.setdefault(least[a], x) == x for a, n, x in zip(first, count, m))
    assert len(set(number.values())) == len(number)


def test_run_index():
    r = random.Random(3)
    base = bytes(r.choices(b"abc\0", k=400))
    pick = lambda k: list(dict.fromkeys(base[a:a + n] for a, n in ((r.randrange(300), r.randint(50, 100)) for _ in range(k))))
    strings, owners = pick(60), None
    owners = np.array([r.randrange(50) for _ in strings])
    sizes = lambda x: np.array([len(s) for s in x], np.int64)
    index = suffix.RunIndex(np.frombuffer(b"".join(strings), np.uint8), sizes(strings), owners)
    # strings of the index, others of the same source, changed ones, and bytes that the index does not have
    queries = strings + pick(40) + [bytes(r.choice(b"abcd") if r.random() < 0.05 else c for c in s) for s in pick(60)] + [b"zzz" * 20]
    lengths, found = index.stream(np.frombuffer(b"".join(queries), np.uint8), sizes(queries))
    at = 0
    for q in queries:
        for p in range(len(q)):
            longest = next(n for n in range(min(50, len(q) - p), -1, -1) if any(q[p:p + n] in s for s in strings))
            assert lengths[at] == longest
            assert found[at] == (min(o for s, o in zip(strings, owners) if q[p:p + 50] in s) if longest == 50 else suffix.NO_ID)
            at += 1
    assert len(index.run) < index.rows / 2  # repetitive strings make few runs
    text = b"\1".join(strings)  # the samples are the positions of the suffixes at the run ends
    ends = np.cumsum(sizes(strings) + 1)
    suffixes = sorted((text[p:ends[np.searchsorted(ends, p, "right")] - 1], p) for p in range(len(text) + 1))
    assert index.head.tolist() == [suffixes[k][1] for k in index.run] and index.tail.tolist() == [suffixes[k + n - 1][1] for k, n in zip(index.run, index.size)]


# ---- WARC

def test_warc(spark):
    page = "<p>" + "x" * 1200
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/\r\nb", page), (2, None, page), (9, "http://b", page), (3, "u", None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"),
            (7, "u", inner * 3 + "é" * 900), (8, "u", "WARC/1.1\r\n"), (10, "u", inner + "\r\n\r\n" + inner), (None, "u", page), (11, "u", inner * 3 + "é" * 900),
            (12, "u", "z" * 3000), (12, "u", "z" * 3000)] + [(100 + i, "u", f"{inner}{i}" * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in best and best[b] != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None))
    for size in ("128m", "700"):  # splits inside files
        path = warc.shared_path(spark, "test")
        warc.write_archives(df, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
            assert result(got) == sorted(want, key=str)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.url for r in warc.read_archives(spark, path).collect()} == {"http://a/%0D%0Ab", "http://b", "u", ""}
    path = warc.shared_path(spark, "empty")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archives_are_split_otherwise_in_the_second_read(spark, monkeypatch):
    inner = "WARC/1.1\r\nContent-Length: 9\r\n\r\n"
    rows = [(i, "a\tb", "".join(f"{inner}{i} {k}" + "x" * (i * k % 300) for k in range(i % 6)) + "é" * 3000 * (i % 50 == 0)) for i in range(400)]
    path = warc.shared_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    plain, sizes = warc.candidates, iter(["2000", "3001", "5000"])

    def read(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return plain(*args)

    monkeypatch.setattr(warc, "candidates", read)
    try:
        got = {r.page_id: r.payload_digest for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}


# ---- media

def test_media(spark):
    pairs = [*corpus(n=20), (1, "x" * 64), (2, "y" * 65), (3, "é" * 200_000)]
    df = frame(spark, pairs).select("doc_id", "text", media.to_wav("text").alias("media")).select("*", media.from_wav("media").alias("m"))
    seen = {}
    for r in df.collect():
        b = (r.text or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        with wave.open(io.BytesIO(r.media)) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert bytes(r.m.payload) == payload and len(payload) % 64 == 0
        assert seen.setdefault(payload, (r.m.frames, r.m.times, r.m.codes)) == (r.m.frames, r.m.times, r.m.codes)
    assert frame(spark, pairs).limit(0).select(media.to_wav("text")).count() == 0


def test_media_parts_do_not_change_results(spark, monkeypatch):
    many = [(i, chr(97 + i % 26) * (50_000 + i) if i % 7 else None) for i in range(200)]
    read = lambda: sorted((tuple(x) for x in frame(spark, many).select("doc_id", media.from_wav(media.to_wav("text")).alias("m"))
                           .select("doc_id", F.sha2("m.payload", 256), "m.frames", F.hash("m.times", "m.codes")).collect()), key=str)
    sizes = [sum(map(len, p)) for p in media.parts(pd.Series([t or "" for _, t in many]))]
    assert max(sizes) <= media.PART_BYTES and len(sizes) > 1 and sum(sizes) == sum(len(t or "") for _, t in many)
    assert [len(p) for p in media.parts(pd.Series(["x", None, "y" * (media.PART_BYTES + 1), "z"]))] == [2, 1, 1]
    want = [(i, hashlib.sha256(media.pad((t or "").encode())).hexdigest()) for i, t in many]
    assert [x[:2] for x in read()] == sorted(want, key=str)


def test_fingerprint_finds_a_tone():
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * 32 / media.FRAME * t)).astype(np.uint8)
    best, clear = media.peaks(tone)
    assert (best == 32).all() and clear.all()
    times, codes = media.fingerprint(tone)
    assert (np.diff(times) >= 0).all() and set(codes.tolist()) == {(32 * 129 + 32) * 4 + d for d in (1, 2, 3)}


def test_peaks_against_a_plain_transform():
    k, n = np.arange(media.FRAME // 2 + 1)[:, None], np.arange(media.FRAME)[None, :]
    turn = np.exp(-2j * np.pi * k * n / media.FRAME)
    for text in ["x" * 64, "word " * 77, *(t for _, t in corpus(n=12) if t)]:
        data = media.pad(text.encode())
        best, clear = media.peaks(np.frombuffer(data, np.uint8))
        x = np.frombuffer(data, np.uint8).astype(float) - 128
        starts = range(0, max(1, len(x) - media.FRAME + media.HOP), media.HOP)
        assert len(best) == len(starts) and starts[-1] + media.FRAME >= len(x)
        for i, a in enumerate(starts):
            frame_ = np.concatenate([x[a:a + media.FRAME], np.zeros(max(0, a + media.FRAME - len(x)))])
            power = np.abs(turn @ (frame_ * np.hanning(media.FRAME)))
            top, mean = power[2:].max(), power[2:].mean()
            assert power[best[i]] >= top - 1e-2  # the transform is in single precision
            assert clear[i] == (top > 2 * mean) or abs(top - 2 * mean) < 1e-2


def test_media_query(spark, tmp_path):
    """All columns of op2 over nulls, empty and repeated rows, and columns named like its own."""
    from tidelake.llm import queries

    pairs = [*corpus(n=20), (1, "x" * 64), (2, "y" * 65), (3, "z" * 640)]
    frame(spark, pairs).withColumn("media", F.lit("other")).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in pairs:
        b = (t or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        want.append((i, len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    rows = queries.op2_media(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(want, key=str)
    shapes = {r.payload_sha256: (r.media_bytes, r.media_sha256, r.feature, r.times, r.codes) for r in rows}
    assert all(shapes[r.payload_sha256] == (r.media_bytes, r.media_sha256, r.feature, r.times, r.codes) for r in rows)
    assert all(r.media_bytes == r.payload_bytes + 44 for r in rows) and len({r.media_sha256 for r in rows}) == len(shapes)


# ---- URLs

def test_url_parts_and_rules(spark):
    cases = [("http://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"), ("https://a.net/x", "a.net", "/x", "net/", "block"),
             ("https://a.net", "a.net", "", None, None), ("x://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
             ("x://notexample.com/de/1", "notexample.com", "/de/1", None, None), ("x://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
             ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://h?q/x", "h", "", None, None),
             ("a://É.NET/", "É.net", "/", "net/", "block")]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    out = urls.judge(df, urls.Model((0.0,) * urls.Params().features, -10.0)).select("row.page_id", "host", "path", "rule", "verdict")
    for r in out.collect():
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_url_model_on_held_out_urls(spark):
    r = random.Random(5)
    name = lambda: "".join(r.choices("abcdehinorst", k=8))
    make = lambda bad: f"http://{name()}{r.choice(['casino', 'pills']) if bad else ''}.example.com/en/{r.randrange(999)}"
    data = [(make(y), y) for y in (0, 1) for _ in range(150)]
    train = spark.createDataFrame(data[::2], "url string, label int")
    model = urls.fit(train)
    assert model == urls.fit(train.repartition(5))  # the order of rows does not matter
    test = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(data[1::2])], "page_id long, url string")
    said = {x[0]: x[1] for x in urls.judge(test, model).select("row.page_id", "verdict").collect()}
    right = sum((said[i] == "block") == bool(y) for i, (_, y) in enumerate(data[1::2]))
    assert right >= 0.95 * len(said)
    assert urls.fit(train.filter("label = 0")).bias < 0


def test_url_labels_are_kept_apart_from_pages(spark, tmp_path):
    from tidelake.llm import queries, url_labels

    six = ("casino-win", "cheap-pills", "adult-x", "free-bets", "ads-track", "spam-farm")
    table = url_labels.url_labels()
    assert not any(name in u for u, _ in table for name in six) and {y for _, y in table} == {0, 1}
    model = urls.fit(url_labels.labelled(spark, url_labels.url_labels(lambda k: k % 4)))
    held_out = spark.createDataFrame(url_labels.url_labels(lambda k: k % 4 == 0), "url string, y int")
    n = Counter((r.y, r.verdict) for r in urls.judge(held_out, model, rules=()).select("row.y", "verdict").collect())
    assert n[1, "block"] > 0.5 * (n[1, "block"] + n[1, "allow"]) and n[1, "block"] > 0.6 * (n[1, "block"] + n[0, "block"])
    hosts = ["casino-win", "free-bets", "m.ads-track"] + ["www.gardening-news", "city-library"] * 5
    pages = spark.createDataFrame([(i, f"http://{h}.example.com/en/{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    said = {r.page_id: r.verdict for r in queries.op3_urls(spark, str(tmp_path)).collect()}
    assert [said[i] for i in range(3)] == ["block"] * 3 and all(said[i] == "allow" for i in range(3, len(hosts)))


# ---- mixing

def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    cap, total = {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    full, target = set(), {}
    while True:
        left, open_ = total - sum(cap[s] for s in full), [s for s in names if s not in full]
        target = {s: cap[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > cap[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    pairs = corpus(n=200)
    df = frame(spark, pairs)
    out = mixing.assign_positions(df).select("row.source", "size", "source_size", "target", "passes", "taken", "positions").collect()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r["size"]
    want = plain_targets(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r["size"] * r.passes <= 3 * r["size"] and len(r.positions) == r.passes
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
    biggest = max(r["size"] for r in out)
    assert all(abs(taken[s] - want[s]) <= biggest for s in sizes)
    order = [r.position for r in mixing.in_training_order(df).collect()]
    assert order == sorted(order) and len(order) == sum(r.passes for r in out)
    assert mixing.mixed(df).columns == df.columns
    again = mixing.assign_positions(df.repartition(7)).select("row.doc_id", "taken", "positions")
    assert result(again) == result(mixing.assign_positions(df).select("row.doc_id", "taken", "positions"))
    assert mixing.mixed(df.limit(0)).count() == 0


def test_demand_is_inverted(spark):
    for schedule in mixing.SCHEDULES:
        df = spark.range(0, 101).select((F.col("id") / 100).alias("c")).select("c", mixing.inverse_demand(schedule, F.col("c")).alias("t"))
        for r in df.collect():
            met = sum((min(max(r.t, t0), t1) - t0) * w0 + slope * (min(max(r.t, t0), t1) - t0) ** 2 / 2 for t0, t1, w0, slope, _ in mixing.integrated(schedule))
            assert abs(met - r.c) < 1e-9


def test_small_sources_are_capped(spark):
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 0), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = plain_targets({"a": 1, "b": 100, "c": 0, None: 1000})
    assert got == pytest.approx(want)


# ---- toxicity

def test_toxicity_orders_held_out_documents(spark):
    r = random.Random(2)
    bad = [f"slur{i}" for i in range(12)]
    docs = []
    for i in range(600):
        grade = r.choice([0, 0, 1, 2, 3])
        docs.append((" ".join(r.sample(WORDS, 40) + r.sample(bad, [0, 1, 3, 6][grade])), grade))
    train = spark.createDataFrame(docs[:400], "text string, grade int")
    model = toxicity.fit(train)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    test = spark.createDataFrame([(g, t) for t, g in docs[400:]], "grade int, text string")
    got = test.select("grade", toxicity.expected_severity(F.col("text"), model).alias("s")).collect()
    mean = [np.mean([x.s for x in got if x.grade == g]) for g in range(4)]
    assert mean == sorted(mean) and mean[0] < 0.4 and mean[3] > 2.2
    assert np.mean([(x.s >= 0.5) == (x.grade > 0) for x in got]) > 0.95
    odd = spark.createDataFrame([(None,), ("",), ("x " * 200_000,)], "text string").select(toxicity.expected_severity(F.col("text"), model)).collect()
    assert len(odd) == 3 and all(x[0] is not None for x in odd)
    none = toxicity.fit(train.filter("grade = 0"))
    assert spark.createDataFrame([("a",)], "text string").select(toxicity.expected_severity(F.col("text"), none)).first()[0] == 0


def test_telling_words_against_plain_counts(spark):
    r = random.Random(4)
    docs = [(" ".join(r.sample(WORDS, 30)) + ", Bad!" * (i % 3 == 0), int(i % 3 == 0)) for i in range(150)] + [(None, 1), ("x", None), ("", 0)]
    params = toxicity.Params(max_rows=100)
    sample = toxicity.bounded(spark.createDataFrame(docs, "text string, grade int"), params)
    rows = [(set(x.words), x.grade) for x in sample.collect()]
    n1, n0, want = sum(g > 0 for _, g in rows), sum(g == 0 for _, g in rows), []
    for w in set().union(*(s for s, _ in rows)):
        a, b = sum(w in s for s, g in rows if g), sum(w in s for s, g in rows if not g)
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        if a + b >= params.min_docs:
            want.append((w, odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))))
    got = {w: z for z, w in toxicity.telling(sample, 0.0, params)}
    assert len(rows) == 100 and got == pytest.approx({w: z for w, z in want if z}) and max(got, key=got.get) == "bad"


def test_grades(spark):
    words = ["ugly", "vile", "nasty", "foul"]
    r = random.Random(1)
    rows = [(" ".join(r.sample(WORDS, 20) + words[:1 + i % 4] * (i % 2)), i % 2) for i in range(200)]
    df = toxicity.graded(spark.createDataFrame(rows, "text string, toxic int"))
    assert {x.grade for x in df.collect()} >= {0, 2} and all((x.grade > 0) == any(w in x.text for w in words) for x in df.collect())


def test_toxicity_query(spark, tmp_path, monkeypatch):
    """op5 against plain scores of the model that it fits, over nulls, repeated rows and columns named like its own."""
    from tidelake.llm import queries

    r = random.Random(6)
    bad = ["ugly", "vile", "nasty", "foul"]
    texts = [" ".join(r.sample(WORDS, 25) + bad[:1 + i % 4] * (i % 2)) for i in range(240)]
    docs = [(i, t, "grade", 1) for i, t in enumerate(texts)] + [(None, None, "", 0), (500, "", "", 0), (None, texts[3], "", 0), (3, texts[3], "", 0), (501, "Foul! VILE " * 9000, "", 0)]
    labels = [(i, i % 2) for i in range(200)] + [(200, None), (None, 1), (3, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, grade string, toxic int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    models, plain = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: models.append(plain(*a)) or models[-1])
    got = [(r.doc_id, r.expected_severity, r.grade, r.toxic) for r in queries.op5_toxicity(spark, str(tmp_path)).collect()]
    model, want = models[0], []
    for i, t, *_ in docs:
        words = {w.strip(toxicity.EDGES.decode()) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())}
        x = sum(model.weights.get(w.encode(), 0.0) for w in words)
        want.append((i, sum(1 / (1 + np.exp(c - x)) for c in model.thresholds)))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert len(got) == len(want) and model.weights
    for g, (i, s) in zip(sorted(got, key=order), sorted(want, key=order)):
        assert g[0] == i and g[1] == pytest.approx(s, abs=2e-6) and g[2:] == (round(s), s >= 0.5)
    toxic = {g[0]: g[3] for g in got}
    assert all(toxic[i] == bool(i % 2) for i in range(200, 240)) and toxic[501] and not toxic[500]
    empty = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert queries.op5_toxicity(spark, str(empty)).count() == 0


# ---- packing

def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    pairs = [(k, t) for k, (_, t) in enumerate(corpus())] + [
        (500, "two  spaces"), (501, " lead"), (502, "trail "), (503, "a\n b\t c"), (504, "it's 12 don't"), (505, "naïve\u00a0 x\u2003y"), (506, "<|endoftext|> x"), (507, "Ġ Ġ x"),
        (508, "one, two., x²! (three) ... 'tis don't. 中文. end?!"), (509, "\n\na\n\nb\n"), (510, "a\nb c.\n<|endoftext|>"), (511, "It's.\nIt's, it's"), (512, "\x1c a\x1c b\x85c")]
    pieces = packing.pack(frame(spark, pairs), packing.Packing(tokenizer=path)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in pairs:
        want = plain.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]]))
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == want and {p.doc_tokens for p in own} == {len(want)}
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == list(np.cumsum([0] + [p.length for p in s[:-1]]))
        n = sum(p.length for p in s)
        assert n == s[0].sequence_length <= 2048 and n & (n - 1) == 0
    assert packing.pack(frame(spark, pairs).limit(0), packing.Packing(tokenizer=path)).count() == 0
    steps = Counter()
    for s in by_sequence.values():
        steps[s[0].step_id] += s[0].sequence_length
    size = packing.Packing(path).step_tokens
    assert max(steps.values()) <= size
    open_steps = Counter(s >> 33 for s, n in steps.items() if n < size)
    assert max(open_steps.values()) <= 2  # groups that are not full, by task


def test_token_cache_is_bounded():
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    tokens, small = packing.Tokens(path, 10**6), packing.Tokens(path, 50)
    texts = [t for _, t in corpus(n=40)]
    for i in range(0, len(texts), 7):
        assert tokens.batch(texts[i:i + 7]) == small.batch(texts[i:i + 7])


def test_packing_query(spark, tmp_path):
    """op9 over rows without ids and with repeated ones: all ids of all texts, each in one place."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tidelake.llm import queries

    plain = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    pairs = corpus(n=30)
    frame(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = queries.op9_packing(spark, str(tmp_path)).collect()
    texts = defaultdict(list)
    for i, t in pairs:
        texts[i].append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(p.length for p in pieces) == sum(len(t) for x in texts.values() for t in x)
    assert sum(p.start == 0 for p in pieces) == len(pairs)
    for p in pieces:
        assert any(len(t) == p.doc_tokens and p.ids_crc32 == zlib.crc32(np.array(t[p.start:p.start + p.length], "<u4").tobytes()) for t in texts[p.doc_id])


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    r = random.Random(8)
    good = [(i, " ".join(r.choices(WORDS, k=50)) + "\nCommon line\n" + " ".join(r.choices(WORDS, k=9))) for i in range(80)]
    pairs = good + [(100 + i, t + " more") for i, (_, t) in enumerate(good[:10])] + [(200, "short"), (201, None)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in pairs]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.select("doc_id").distinct().count())
    assert sizes[:3] == [90, 90, 80] and 40 < sizes[3] <= 80 and sizes[4] == sizes[3]
    assert "Common line" not in "".join(x.text for x in spark.read.parquet(f"{tmp_path}/1").collect())
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()
    # the curriculum's order: ranges of the mixed files are packed by tasks in turn
    order = in_file_order(spark.read.parquet(f"{tmp_path}/3"), ["doc_id"]).collect()
    place = {}
    for k, x in enumerate(order):
        place.setdefault(x.doc_id, k)
    tasks = sorted((place[x.doc_id], x.sequence_id >> 33) for x in docs.collect() if [y.doc_id for y in order].count(x.doc_id) == 1)
    assert [t for _, t in tasks] == sorted(t for _, t in tasks)


def test_pipeline_stages_on_hard_tables(spark, tmp_path):
    """No rows; no ids, repeated ids and rows, nulls, and a column named like an operator's own."""
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    r = random.Random(18)
    text = lambda: " ".join(r.choices(WORDS, k=60))
    t, u = text(), text()
    rows = [(None, text(), "en", None, 1, 7) for _ in range(20)] + [(5, t, "en", "s", 1, 7), (5, t, "en", "s", 1, 7), (5, u, None, "s", 1, 7), (6, t, "en", "s", 1, 8)]
    rows += [(9, None, None, None, None, None), (9, "", "en", "s", 0, 1), (8, " ".join(r.choices(WORDS, k=30_000)), "en", "s", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int"
    for k, data in enumerate(([], rows)):
        docs = spark.createDataFrame(data, schema)
        for j, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert j == 4 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}-{j}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{j}")
        kept = spark.read.parquet(f"{tmp_path}/{k}-2").select("doc_id", "text").collect()
        assert len(kept) == (0 if not data else 23) and Counter(x.doc_id for x in kept) == (Counter({None: 20, 5: 2, 8: 1}) if data else Counter())
