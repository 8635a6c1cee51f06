"""Removal of word passages that occur in an earlier document, by prefix-partitioned suffix trees.

A word goes if a run of SPAN words that covers it also starts in a document with a smaller doc_id.

1. Blocks. Texts are stored once as compressed blocks.
2. Prefixes. A suffix is split off by a prefix of variable length: up to and with its anchor, the
   GRAM-word string of least hash among its first SPAN words, so by 8 to 50 words. Suffixes that
   agree on SPAN words have the same anchor. Anchors are counted over all documents; where one
   document only has an anchor, its suffixes have no deep inner node and are left out. Where
   Params.hot_docs documents or more have it, the prefix is lengthened to all SPAN words, so that
   what surrounds a very common passage is spread over all groups.
3. Groups. Suffixes that follow each other share their anchor, so a run of them travels as one
   string (of 50 to 112 words, once from a block, with its least and largest doc_id) to the group of
   its prefix. Groups are parts of hash buckets that hold Params.part_bytes of strings, so a group's
   tree fits in memory whatever the input.
4. Trees. A group's suffix tree is held as its sorted suffixes and the number of words that
   neighbours share; inner nodes are the ranges that share more than their surroundings. A node of
   SPAN words or more whose leaves do not all follow the same word is a maximal repeat: in each leaf
   of a document larger than the node's least one, as many words as the node is deep are marked.
   Nodes whose leaves all follow one word lie inside a repeat that begins further left in the same
   group. A string that two documents have is itself such a repeat.
5. Marks return to the blocks and drop the words of all occurrences in larger documents.

Blocks, prefixes and marks are stored, and read again if an executor is lost.

Nulls: a null or empty text has no words; a null doc_id counts as larger than all others. Rows with
equal doc_ids do not remove each other's words. An empty table gives an empty result. Texts are
processed whole; one that is longer than a block is a block of its own. Other columns do not come
along, whatever their names. Anchors tell words apart by 64-bit hashes, trees by the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, drop_tables, materialise, release
from .jaccard import MULTIPLY, PACKED_SQL, kept_words, small, unplanes, unsmall
from .suffix import (BLOCK_BYTES, NO_ID, PART_BYTES, SPAN, anchor_rows, block_rows, by_bucket, count_anchors, cut_at, extremes, opened,
                     rows_of, table_of, window_runs)

GRAM = 8
#: Bytes of the stored blocks for each bucket.
BUCKET_BYTES = 1 << 23


@dataclass(frozen=True)
class Params:
    #: Where so many documents have an anchor, its suffixes are dealt by all SPAN words.
    hot_docs: int = 1024
    block_bytes: int = BLOCK_BYTES
    part_bytes: int = PART_BYTES


# ---- words

def split_block(row: tuple) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each document of a block, and the documents' ids."""
    data, sizes, ids = opened(row)
    raw, ends = data.tobytes(), np.cumsum(sizes).tolist()
    return [raw[b - n:b].split() for b, n in zip(ends, sizes.tolist())], ids  # on bytes: ASCII white space only


def hashed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words of each document."""
    known = kept_words().__getitem__
    sizes = np.array([len(w) for w in words], np.int64)
    return np.fromiter((h for w in words for h in map(known, w)), np.uint64, int(sizes.sum())), sizes


def word_symbols(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, ids = split_block(row)
    return *hashed(words), ids


def joined(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each position, from hashes of single words."""
    width = 1
    while width * 2 <= size:
        h = (h[:-width] * MULTIPLY) ^ (h[width:] >> np.uint64(23)) ^ (h[width:] << np.uint64(41))
        width *= 2
    rest = size - width
    if rest:
        h = (h[:-rest] * MULTIPLY) ^ (h[rest:] >> np.uint64(23)) ^ (h[rest:] << np.uint64(41))
    h = (h ^ (h >> np.uint64(31))) * MULTIPLY
    return h ^ (h >> np.uint64(29))


def anchors(h: np.ndarray) -> np.ndarray:
    """For each window of SPAN words the least hash of its GRAM-word strings."""
    m, width, reach = joined(h, GRAM), SPAN - GRAM + 1, 1
    while reach * 2 <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(m[:-rest], m[rest:])


# ---- groups

def strings_of(buckets: int) -> Callable:
    """A block's distinct runs of suffixes with a shared prefix (S), by bucket: texts; size, least and largest id; place in the
    bucket; the first one's number. One row of their occurrences (O): how many each has, in the order of numbers, and where."""

    def run(table: pa.Table) -> pa.Table:
        parts = [(unplanes(a), b) for _, a, b, _ in rows_of(table, "R")]
        if not parts:
            return table_of([])
        shared = np.concatenate([a for a, _ in parts])
        hot = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(a)).astype(bool) for a, b in parts])
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        row = next(rows_of(table, "M"))
        words, ids = split_block(row)
        h, sizes = hashed(words)
        first, count, m = window_runs(h, sizes, anchors)
        at = np.minimum(np.searchsorted(shared, m), len(shared) - 1)
        hit = shared[at] == m
        first, count, m, hot = first[hit], count[hit], m[hit], hot[at[hit]]
        # suffixes of hot anchors one by one, by all their SPAN words
        n = count[hot]
        each = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = joined(h, SPAN)[each] if len(each) else m[:0]
        first, count, m = np.concatenate([first[~hot], each]), np.concatenate([count[~hot], np.ones(len(each), np.int64)]), np.concatenate([m[~hot], own])
        if not len(m):
            return table_of([])
        size = count + SPAN - 1
        flat = [x for w in words for x in w]
        raw, known = h.tobytes(), {}
        number = np.fromiter((known.setdefault(raw[8 * a:8 * (a + k)], len(known)) for a, k in zip(first.tolist(), size.tolist())), np.int64, len(size))
        n_strings = len(known)
        del raw, known
        owner = ids[np.searchsorted(np.cumsum(sizes), first, "right")]
        lo, hi = extremes(number, n_strings, owner, owner)
        place = np.empty(n_strings, np.int64)
        place[number[::-1]] = np.arange(len(number))[::-1]  # of the first occurrence
        bucket, part = by_bucket(m[place], buckets)
        order = np.lexsort((part, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = place[order]
        bucket, part, lo, hi, size, begin = bucket[order], part[order], lo[order], hi[order], size[place], first[place]
        out = []
        for a, b in cut_at(bucket):
            text = b"\n".join(b" ".join(flat[x:x + k]) for x, k in zip(begin[a:b].tolist(), size[a:b].tolist()))
            out.append((int(bucket[a]), "S", row[0], zstandard.compress(text, 3), small(part[a:b]),
                        a.to_bytes(8, "little") + small(np.stack([lo[a:b], hi[a:b]]).ravel())))
        number = rank[number]
        order = np.argsort(number, kind="stable")
        out.append((row[0] % buckets, "O", row[0], small(first[order].astype(np.uint64)), small(np.bincount(number).astype(np.uint32)), b""))
        return table_of(out)

    return run


# ---- trees

class Codes(dict):
    """Words to numbers from 1."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) + 1
        return value


class SuffixTree:
    """The suffixes of SPAN words or more of some strings, sorted, with the number of words that each shares with the one before."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        """codes: the words' numbers, from 1, of strings of the given sizes, one after the other."""
        total, ends = len(codes), np.cumsum(sizes)
        self.codes, self.begin = codes, ends - sizes
        self.string = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        left = ends[self.string] - np.arange(total)  # words to the end of the string
        longest = int(sizes.max()) if len(sizes) else 0
        ranks, h = [codes], 1
        while h < longest:  # ranks by the first h words, then by twice as many; what ends is less than what goes on
            key = ranks[-1].astype(np.int64) * (total + 1)
            far = np.flatnonzero(left > h)
            key[far] += ranks[-1][far + h]
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(total, np.int32)
            rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
            ranks.append(rank)
            h *= 2
        leaves = np.flatnonzero(left >= SPAN)
        self.leaves = leaves[np.argsort(ranks[-1][leaves], kind="stable")]
        a, b = self.leaves[:-1], self.leaves[1:]
        common, most = np.zeros(len(a), np.int64), np.minimum(left[a], left[b])
        for level in range(len(ranks) - 1, -1, -1):
            fits = np.flatnonzero(most - common >= 1 << level)
            fits = fits[ranks[level][(a + common)[fits]] == ranks[level][(b + common)[fits]]]
            common[fits] += 1 << level
        self.shared = np.concatenate([[-1], common])[:len(self.leaves)]

    def maximal_repeats(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """String, from, to and least id of each leaf of a deep inner node, if a larger document has it and the node's leaves do not
        all follow one word. lo, hi: the least and largest id of each string. Nodes are taken by depth; what shares less than
        the depth with both neighbours has no deeper node."""
        at, shared = self.leaves, self.shared
        before = np.where(at == self.begin[self.string[at]], 0, self.codes[at - 1])
        for depth in np.unique(shared[shared >= SPAN]).tolist():
            first = np.flatnonzero(shared < depth)
            size = np.diff(np.append(first, len(at)))
            inside = np.repeat(size > 1, size)
            at, shared, before = at[inside], shared[inside], before[inside]
            size = size[size > 1]
            first = np.cumsum(size) - size
            of = self.string[at]
            least = np.minimum.reduceat(lo[of], first)
            left, right = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
            node = np.maximum.reduceat(shared, first) >= depth
            node &= np.logical_or.reduceat(shared == depth, first)
            node &= (least < np.maximum.reduceat(hi[of], first)) & ((left == 0) | (left != right))
            hit = np.repeat(node, size) & (hi[of] > np.repeat(least, size))
            if hit.any():
                start = at[hit] - self.begin[of[hit]]
                yield of[hit], start, start + depth, np.repeat(least, size)[hit]


def group_marks(strings: list[bytes], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """String, from, to (in words) and least id of what maximal repeats cover in larger documents; strings are distinct."""
    code = Codes()
    split = [s.split(b" ") for s in strings]
    sizes = np.array([len(s) for s in split], np.int64)
    codes = np.fromiter((c for s in split for c in map(code.__getitem__, s)), np.int32, int(sizes.sum()))
    twice = np.flatnonzero(lo < hi)
    found = [(twice, np.zeros(len(twice), np.int64), sizes[twice], lo[twice]), *SuffixTree(codes, sizes).maximal_repeats(lo, hi)]
    return np.stack([np.concatenate([np.asarray(f[k], np.int64) for f in found]) for k in range(4)])


def mark_bucket(part_bytes: int) -> Callable:
    """Marks (P) of the strings of a bucket, for the blocks: number of the string, from, to, and the least id. O rows pass."""

    def run(table: pa.Table) -> pa.Table:
        parts, total = [], 0
        for block, text, place, extra in rows_of(table, "S"):
            raw = zstandard.decompress(text)
            total += len(raw)
            parts.append((block, int.from_bytes(extra[:8], "little"), raw.split(b"\n"), unsmall(place, np.uint16),
                          unsmall(extra[8:], np.int64).reshape(2, -1)))
        step = max(1, (1 << 16) // (1 << max(0, (total // part_bytes).bit_length())))
        found: list[list] = [[] for _ in parts]
        for low in range(0, 1 << 16, step):
            known: dict[bytes, int] = {}
            number, least, largest, part, entry = [], [], [], [], []
            for k, (_, _, texts, place, facts) in enumerate(parts):
                a, b = np.searchsorted(place, [low, low + step])
                if a == b:
                    continue
                number += [known.setdefault(s, len(known)) for s in texts[a:b]]
                least.append(facts[0, a:b])
                largest.append(facts[1, a:b])
                part.append(np.full(b - a, k, np.int32))
                entry.append(np.arange(a, b))
            if not number:
                continue
            least, largest, part, entry = map(np.concatenate, (least, largest, part, entry))
            number = np.array(number)
            lo, hi = extremes(number, len(known), least, largest)
            string, start, stop, first = group_marks(list(known), lo, hi)
            # back from strings to the blocks' entries
            order = np.argsort(number, kind="stable")
            many = np.bincount(number, minlength=len(known))
            begin = (np.cumsum(many) - many)[string]
            n = many[string]
            e = order[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            start, stop, first = np.repeat(start, n), np.repeat(stop, n), np.repeat(first, n)
            hit = np.flatnonzero(first < largest[e])
            hit = hit[np.argsort(part[e[hit]], kind="stable")]
            e = e[hit]
            marks = np.stack([entry[e], start[hit], stop[hit], first[hit]])
            home = part[e]
            for u, v in cut_at(home):
                found[home[u]].append(marks[:, u:v])
        out = [(0, "O", *row) for row in rows_of(table, "O")]
        for (block, base, *_), marks in zip(parts, found):
            if marks:
                marks = np.concatenate(marks, axis=1)
                marks[0] += base
                out.append((0, "P", block, b"", b"", small(marks.ravel())))
        return table_of(out)

    return run


# ---- cut

CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])
CUT_SQL = "doc_id long, n_words long, n_removed long, n_spans long, kept string"


def cut_block(table: pa.Table) -> pa.Table:
    """A block's documents without the marked words."""
    words, ids = split_block(next(rows_of(table, "M")))
    sizes = np.array([len(w) for w in words], np.int64)
    ends, total = np.cumsum(sizes), int(sizes.sum())
    change = np.zeros(total + 1, np.int32)
    marks = [unsmall(c, np.int64).reshape(4, -1) for _, _, _, c in rows_of(table, "P")]
    if marks:
        _, where, counts, _ = next(rows_of(table, "O"))
        where, counts = unsmall(where, np.uint64).astype(np.int64), unsmall(counts, np.uint32).astype(np.int64)
        begin = np.cumsum(counts) - counts
        for number, start, stop, least in marks:
            n = counts[number]
            at = where[np.repeat(begin[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            hit = np.repeat(least, n) < ids[np.searchsorted(ends, at, "right")]
            np.add.at(change, (at + np.repeat(start, n))[hit], 1)
            np.add.at(change, (at + np.repeat(stop, n))[hit], -1)
    gone = np.cumsum(change, dtype=np.int32)[:total] > 0
    out: list[list] = [[] for _ in CUT]
    for w, a, i in zip(words, (ends - sizes).tolist(), ids.tolist()):
        g = gone[a:a + len(w)]
        n = int(g.sum())
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
        kept = [x for x, out_ in zip(w, g.tolist()) if not out_] if n else w
        for column, value in zip(out, (None if i == NO_ID else i, len(w), n, spans, b" ".join(kept).decode())):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, CUT)], schema=CUT)


def remove_passages(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs), kept (text, words joined by a space): one row for each row of docs."""
    spark = docs.sparkSession
    blocks = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(block_rows(params.block_bytes), PACKED_SQL), "word-blocks")
    buckets = buckets_for(blocks, BUCKET_BYTES)
    # no step's DataFrame is kept when it is stored, so that its shuffle files can go
    shared = materialise(blocks.mapInArrow(anchor_rows(buckets, word_symbols, anchors), PACKED_SQL).repartition(buckets, "route")
                         .groupBy("route").applyInArrow(count_anchors(params.hot_docs), PACKED_SQL), "shared-prefixes")
    release(spark)
    strings = shared.unionByName(blocks).repartition(buckets, "block").groupBy("block").applyInArrow(strings_of(buckets), PACKED_SQL)
    marks = materialise(strings.repartition(buckets, "route").groupBy("route").applyInArrow(mark_bucket(params.part_bytes), PACKED_SQL), "word-marks")
    del strings
    drop_tables(shared)
    release(spark)
    return marks.unionByName(blocks).repartition(buckets, "block").groupBy("block").applyInArrow(cut_block, CUT_SQL)
