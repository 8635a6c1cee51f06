"""Hard negatives for anchors, by angular triangle filtering.

A row's vector is the floor of Params.scale times its components; scores are integer inner products.
An anchor's positives are its best rows of the same label; for each positive, the negatives are the
best rows of another label whose score lies in a window of the positive's.

1. Reference directions are chosen by farthest-first from a sample of Params.sample rows, by hash.
   They only steer the filter; every row is in the result's reach.
2. Each row is stored with its norm and its angles to the references, in blocks of rows that lie near
   each other. By the triangle inequality the angle between an anchor and a row lies between the
   largest difference and the smallest sum of their angles to a reference; the cosines of these two,
   times the norms, widened for rounding, bound the score.
3. Blocks of anchors meet the blocks of rows that their bounds allow. A block of rows stays where it
   is and is read once for each Params.anchor_group blocks of anchors.
4. Positives: among rows of the label, those whose upper bound reaches the fifth-best lower bound are
   scored. The best of each block meet in a window function for each anchor.
5. Negatives: rows of other labels whose bounds overlap one of the anchor's windows are scored, and the
   best inside each window are kept, by block and then by anchor and positive.

Scores are exact: products are taken in doubles where no sum can pass 2^53, else in 64-bit integers or
Python's. Scores are ranked in 38 digits and returned as the nearest 64-bit number; those beyond
count as the last number that fits.

Rows with a null label, a null vector, or a null or non-finite component take no part. A null id is
last among equal scores. Vectors of different lengths: missing components are 0; an empty one scores
0 with all. Rows are told apart by a number of their own, so repeated rows are rows like others and
an anchor is no positive of itself, but its copy is. Ties go to the smaller id. No anchor, or an empty
table, gives an empty result. Columns other than those named do not come along.
"""

from __future__ import annotations

from ast import literal_eval
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_tables, materialise

NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Params:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    #: A negative's score lies between these percentages of the positive's.
    low: int = 50
    high: int = 95
    references: int = 8
    sample: int = 256
    block_rows: int = 16384
    anchor_rows: int = 256
    #: Blocks of anchors that one task takes in.
    anchor_group: int = 256


#: Rounding of stored angles, in radians, and of bounds, as a share of the norms' product.
ANGLE_SLACK, SCORE_SLACK = 4e-6, 4e-6
#: Components beyond this have no bounds and are scored in all cases.
LARGE = 2.0 ** 40


def packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpacked(b: bytes, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind).reshape(*shape) if shape else np.frombuffer(zstandard.decompress(b), kind)


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles, shorter ones filled with 0."""
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def lists(a: np.ndarray) -> pa.Array:
    """The rows of a as lists."""
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel()))


# ---- stored angles

def farthest_first(v: np.ndarray, n: int) -> np.ndarray:
    """Up to n directions of the rows of v, each the farthest from those before."""
    size = np.linalg.norm(v, axis=1)
    v = v[(size > 0) & np.isfinite(size)]
    if not len(v):
        return v
    v = v / np.linalg.norm(v, axis=1)[:, None]
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(n, len(v)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, v @ v[k])
    return v[chosen]


def angles_to(v: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references (0 for a vector without direction)."""
    dim = max(v.shape[1], references.shape[1])
    v, r = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (v, references))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((v * v).sum(axis=1))
        cos = (v @ r.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(np.nan_to_num(cos), -1, 1)).astype(np.float32)


ANGLED_SQL = "key long, id long, label long, is_anchor boolean, vector array<double>, norm double, angles array<float>, cell int, near float"


def angled(references: np.ndarray, scale: int) -> Callable:
    """Rows with floored vectors, norms, angles, and the nearest reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(matrix(part.column(4)) * scale), -1.7e308, 1.7e308)
                norm, angle = angles_to(v, references)
                cell = angle.argmin(axis=1) if angle.shape[1] else np.zeros(len(v), np.int64)
                near = angle[np.arange(len(v)), cell] if angle.shape[1] else np.zeros(len(v), np.float32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(4)], lists(v), pa.array(norm), lists(angle), pa.array(cell, pa.int32()), pa.array(near)],
                    ["key", "id", "label", "is_anchor", "vector", "norm", "angles", "cell", "near"])

    return run


# ---- blocks

BLOCK_SQL = ("block long, n int, keys binary, ids binary, labels binary, vectors binary, norms binary, angles binary, wanted binary, "
             "kinds array<long>, low array<float>, high array<float>, norm double, least double")
BLOCK_NAMES = [c.split()[0] for c in BLOCK_SQL.split(", ")]


@dataclass
class Block:
    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    #: Of each row the positives' ids and scores, if they are known.
    wanted: list


def block_rows(most: int) -> Callable:
    """Rows (as angled, then perhaps the positives' ids and scores) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            column = lambda c: table[c].combine_chunks()
            keys, labels = column("key").to_numpy(), column("label").to_numpy()
            ids = column("id").fill_null(NO_ID).to_numpy()
            v, norm, angle = matrix(column("vector")), column("norm").to_numpy(), matrix(column("angles")).astype(np.float32)
            whole = np.int32 if not v.size or np.abs(v).max() < 2 ** 31 else np.float64
            wanted, least = [], -np.inf
            if "positives" in table.column_names:
                wanted = [([NO_ID if i is None else i for i in p], s) for p, s in zip(table["positives"].to_pylist(), table["scores"].to_pylist())]
                least = min([float(s) for _, row in wanted for s in row if int(s) >= 0], default=np.inf)
            row = [int(keys[0]), len(keys), packed(keys), packed(ids), packed(labels), (b"i" if whole is np.int32 else b"f") + packed(v.astype(whole)), packed(norm),
                   packed(angle), repr(wanted).encode(), sorted(set(labels.tolist())), angle.min(axis=0).tolist(), angle.max(axis=0).tolist(),
                   float(norm.max()), least]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7, pa.list_(pa.int64()), *[pa.list_(pa.float32())] * 2, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], BLOCK_NAMES)

        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == most:
                    yield emit(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield emit(pa.Table.from_batches(held))

    return run


def opened(row: dict) -> Block:
    n, v = row["n"], row["vectors"]
    return Block(unpacked(row["keys"], np.int64), unpacked(row["ids"], np.int64), unpacked(row["labels"], np.int64),
                 unpacked(v[1:], np.int32 if v[:1] == b"i" else np.float64, n, -1).astype(np.float64),
                 unpacked(row["norms"], np.float64), unpacked(row["angles"], np.float32, n, len(row["low"])), literal_eval(row["wanted"].decode()))


# ---- bounds and scores

def bounds(a: Block, i: np.ndarray, v: Block, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above which the scores of a's rows i and v's rows j cannot be."""
    least, most = np.zeros((len(i), len(j)), np.float32), np.full((len(i), len(j)), np.pi, np.float32)
    for k in range(a.angles.shape[1]):
        x, y = a.angles[i, k][:, None], v.angles[j, k][None, :]
        np.maximum(least, np.abs(x - y), out=least)
        both = x + y
        np.minimum(most, np.minimum(both, np.float32(2 * np.pi) - both), out=most)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = a.norms[i][:, None] * v.norms[j][None, :]
        slack = norms * SCORE_SLACK + 1e-3
        high = norms * np.cos(np.maximum(least - np.float32(ANGLE_SLACK), 0)) + slack
        low = norms * np.cos(np.minimum(most + np.float32(ANGLE_SLACK), np.float32(np.pi))) - slack
    odd = ~np.isfinite(norms) | (a.norms[i] >= LARGE)[:, None] | (v.norms[j] >= LARGE)[None, :]
    low[odd], high[odd] = -np.inf, np.inf
    return low, high


def scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of v: 64-bit, or Python's integers where they need more."""
    dim = min(a.shape[1], v.shape[1])  # what one side lacks is 0
    a, v = a[:, :dim], v[:, :dim]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dim, 1)
    if top < 2.0 ** 53:
        return np.rint(a @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    if top < 2.0 ** 62:
        return a.astype(np.int64) @ v.astype(np.int64).T
    return whole(a) @ whole(v).T


def best(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by falling score, then rising id."""
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(-score[by_id], kind="stable")]


PAIR_SQL = "anchor long, anchor_id long, turn int, other_id long, wanted_id long, wanted_score decimal(38,0), score decimal(38,0)"
PAIR = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("turn", pa.int32()), ("other_id", pa.int64()), ("wanted_id", pa.int64()),
                  ("wanted_score", pa.decimal128(38, 0)), ("score", pa.decimal128(38, 0))])
#: Scores in the result of a task are held in 38 digits.
WIDE = 10 ** 38 - 1


def pairs_table(rows: list[tuple]) -> pa.Table:
    clear = lambda i: None if i == NO_ID else i
    fit = lambda s: None if s is None else Decimal(max(-WIDE, min(WIDE, int(s))))
    out = [(k, clear(i), t, clear(o), clear(w), fit(ws), fit(s)) for k, i, t, o, w, ws, s in rows]
    columns = list(zip(*out)) if out else [[]] * len(PAIR)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIR)], schema=PAIR)


#: Rows of a block that are bounded at once.
TILE = 4096


def best_positives(k: int) -> Callable:
    """The k best rows of a block for each anchor, among those of its label."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for v in map(opened, rows.to_pylist()):
            for batch in anchors.to_batches(max_chunksize=1):
                for a in map(opened, batch.to_pylist()):
                    for label in np.intersect1d(a.labels, v.labels).tolist():
                        i, every = np.flatnonzero(a.labels == label), np.flatnonzero(v.labels == label)
                        for at in range(0, len(every), TILE):
                            j = every[at:at + TILE]
                            low, high = bounds(a, i, v, j)
                            own = a.keys[i][:, None] == v.keys[j][None, :]
                            low[own], high[own] = -np.inf, -np.inf
                            limit = np.partition(low, -k, axis=1)[:, -k] if len(j) > k else np.full(len(i), -np.inf)
                            near = (high >= limit[:, None]) & ~own
                            some = np.flatnonzero(near.any(axis=0))
                            exact = scores(a.vectors[i], v.vectors[j[some]])
                            for x, row in enumerate(i.tolist()):
                                c = np.flatnonzero(near[x, some])
                                s, ids = exact[x, c], v.ids[j[some[c]]]
                                if len(c) > 4 * k and s.dtype != object:
                                    keep = s >= np.partition(s, -k)[-k]
                                    s, ids = s[keep], ids[keep]
                                for t in best(s, ids)[:k].tolist():
                                    found.append((int(a.keys[row]), int(a.ids[row]), 0, int(ids[t]), None, None, s[t]))
        return pairs_table(found)

    return run


def best_negatives(k: int, lowest: int, highest: int) -> Callable:
    """The k best rows of a block in each of an anchor's windows, among those of other labels."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for v in map(opened, rows.to_pylist()):
            for batch in anchors.to_batches(max_chunksize=1):
                for a in map(opened, batch.to_pylist()):
                    windows = [[(-(-lowest * int(s) // 100), highest * int(s) // 100) for s in w[1]] for w in a.wanted]
                    i = np.array([x for x, w in enumerate(windows) if any(lo <= hi for lo, hi in w)], np.int64)
                    if not len(i):
                        continue
                    bottom = np.array([float(min(lo for lo, hi in windows[x] if lo <= hi)) for x in i.tolist()])[:, None]
                    top = np.array([float(max(hi for lo, hi in windows[x] if lo <= hi)) for x in i.tolist()])[:, None]
                    for at in range(0, len(v.keys), TILE):
                        j = np.arange(at, min(at + TILE, len(v.keys)))
                        low, high = bounds(a, i, v, j)
                        near = (a.labels[i][:, None] != v.labels[j][None, :]) & (high >= bottom) & (low <= top)
                        some = np.flatnonzero(near.any(axis=0))
                        if not len(some):
                            continue
                        exact = scores(a.vectors[i], v.vectors[j[some]])
                        near = near[:, some]
                        if exact.dtype != object:
                            near &= (exact >= bottom - 1 - abs(bottom) * 1e-12) & (exact <= top + 1 + abs(top) * 1e-12)
                        for x, row in enumerate(i.tolist()):
                            c = np.flatnonzero(near[x])
                            if not len(c):
                                continue
                            s, ids = exact[x, c], v.ids[j[some[c]]]
                            order = best(s, ids)
                            s, ids = s[order], ids[order]
                            rising = s[::-1]
                            for turn, ((lo, hi), wanted, score) in enumerate(zip(windows[row], *a.wanted[row])):
                                if lo <= hi:
                                    if s.dtype != object:
                                        lo, hi = max(lo, -NO_ID), min(hi, NO_ID)
                                    first = len(s) - int(np.searchsorted(rising, hi, "right"))
                                    last = min(first + k, len(s) - int(np.searchsorted(rising, lo, "left")))
                                    for t in range(first, last):
                                        found.append((int(a.keys[row]), int(a.ids[row]), turn, int(ids[t]), wanted, score, s[t]))
        return pairs_table(found)

    return run


# ---- the whole

def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows near each other, in stored blocks. More partitions than blocks are taken while blocks are small."""
    n = rows.count()
    parts = max(1, -(-n // most), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 2048))
    near = rows.repartitionByRange(parts, "cell", "near", "key").sortWithinPartitions("cell", "near", "key")
    return materialise(near.mapInArrow(block_rows(most), BLOCK_SQL), name)


def _meet(rows: DataFrame, anchors: DataFrame, allowed: Column, group: int, best_of: Callable) -> DataFrame:
    """best_of on each block of rows and the blocks of anchors that are allowed to meet it."""
    places = max(1, anchors.count())  # one for each block of anchors; some hold none or a few
    a = anchors.select(F.struct("*").alias("a"), F.pmod(F.xxhash64("block"), F.lit(places)).alias("place"))
    facts = rows.select(F.struct("block", "kinds", "low", "high", "norm").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))).alias("place"))
    met = facts.join(a, "place").filter(allowed).select(F.col("v.block").alias("at"), F.floor(F.col("place") / group).alias("share"), "a.*")
    own = rows.select(F.col("block").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((places - 1) // group).cast("long"))).alias("share"), "*")
    return own.groupBy("at", "share").cogroup(met.groupBy("at", "share")).applyInArrow(best_of, PAIR_SQL)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and turn, numbered from 1."""
    order = Window.partitionBy("anchor", "turn").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """vectors: id, label, embedding, is_anchor. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    numbered = materialise(sound.select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long"), F.col("label").cast("long"), "is_anchor",
                                        F.col("embedding").cast("array<double>").alias("vector")), "vectors")
    sample = numbered.select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(params.sample).toArrow()
    directions = farthest_first(matrix(sample["vector"].combine_chunks()), params.references)
    if not directions.size:
        directions = np.ones((1, 1))
    rows = materialise(numbered.mapInArrow(angled(directions, params.scale), ANGLED_SQL), "angles")
    drop_tables(numbered)
    blocks = _blocks(rows, params.block_rows, "row-blocks")
    anchors = rows.filter("is_anchor")
    first = _blocks(anchors, params.anchor_rows, "anchor-blocks")
    same = F.arrays_overlap("v.kinds", "a.kinds")
    positives = materialise(_top(_meet(blocks, first, same, params.anchor_group, best_positives(params.positives)), params.positives)
                            .groupBy(F.col("anchor").alias("key"))
                            .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("other_id"), "score"))).alias("p"))
                            .select("key", F.col("p.other_id").alias("positives"), F.transform("p.score", lambda s: s.cast("string")).alias("scores")), "positives")
    wanting = materialise(anchors.join(positives, "key"), "wanting")
    second = _blocks(wanting, params.anchor_rows, "wanting-blocks")
    # the block's widest reach against the lowest window: cos falls with the angle, so the gap of the angles bounds the score
    gap = F.array_max(F.zip_with(F.zip_with("v.low", "a.high", lambda x, y: x - y), F.zip_with("a.low", "v.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    reach = F.col("v.norm") * F.col("a.norm") * (F.greatest(F.cos(F.greatest(gap - 2 * ANGLE_SLACK, F.lit(0.0))), F.lit(0.0)) + SCORE_SLACK) + 1
    allowed = (F.col("v.norm") >= LARGE) | (F.col("a.norm") >= LARGE) | (reach >= F.col("a.least") * params.low / 100)
    found = materialise(_top(_meet(blocks, second, allowed, params.anchor_group, best_negatives(params.negatives, params.low, params.high)), params.negatives), "negatives")
    drop_tables(rows, blocks, first, positives, wanting, second)
    most = 9223372036854775807
    fit = lambda c: F.least(F.greatest(F.col(c), F.lit(-most)), F.lit(most)).cast("long")
    return found.select("anchor_id", F.col("wanted_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
                        fit("wanted_score").alias("positive_score"), fit("score").alias("negative_score"))
