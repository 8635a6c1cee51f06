"""Removal of passages that occur in an earlier document, by a run-length compressed index.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller doc_id.

1. Blocks. Texts are stored once as compressed blocks of BLOCK_BYTES, or of one longer text.
2. Anchors. Every SPAN-byte window has a minimizer, the least hash of its GRAM-byte strings; equal
   windows have equal minimizers. Minimizers are counted over all documents in hash buckets, and
   those of one document only are out.
3. Stretches. A run of windows around a shared minimizer goes, as bytes, to the minimizer's bucket:
   from a block each distinct stretch once, with its least and largest doc_id. The windows of a
   minimizer of Params.hot_docs documents or more go one by one, each to the bucket of its own hash,
   so what surrounds a very common passage is spread over all buckets.
4. Index. In a bucket, equal windows are in one part of it by further bits of that hash, and parts
   are taken in turn, so memory does not depend on the bucket. Stretches without a window that two
   documents have (by hash) drop out. Those that hold some window's first document are the reference:
   their Burrows-Wheeler transform is kept as runs, with the suffix array sampled at both run ends.
   All stretches are streamed against it, from their last byte to their first: where the transform
   does not go on with the next byte, the nearest run that does is taken up or down, whichever agrees
   longer with the match so far, which the samples tell. Where the match is SPAN bytes or longer, the
   rows that agree on SPAN bytes give the least doc_id; if that is smaller than the stretch's largest,
   the window is marked.
5. Marks return to the blocks and cut the bytes of all occurrences in documents with a larger doc_id.

There are as many buckets as the input needs. A bucket receives a string once from a block, not from
each document. Blocks, shared minimizers and marks are stored, and read again if an executor is lost.

Nulls: a null text is empty; a null doc_id counts as larger than all others. Rows with equal doc_ids
do not remove each other's bytes. An empty table gives an empty result. Texts are processed whole.
Other columns do not come along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, drop_tables, materialise, release, slices
from .jaccard import PACKED, PACKED_SQL, planes, small, unplanes, unsmall

SPAN = 50
GRAM = 16
#: Text in a block.
BLOCK_BYTES = 1 << 21
#: Windows in a stretch at most, so that it has 112 bytes: ranks by 7 bytes, doubled four times, sort its suffixes.
LONGEST = 63
#: Of these ranks, those by HALF bytes tell which windows are equal.
HALF = 28
#: Positions that are hashed at once.
RUN = 1 << 17
#: Bytes of the stored blocks for each bucket.
BUCKET_BYTES = 1 << 23
#: Bytes of stretches in a part of a bucket.
PART_BYTES = 1 << 21
NO_ID = np.iinfo(np.int64).max
PRIMES = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))


@dataclass(frozen=True)
class Params:
    #: Minimizers of so many documents have their windows dealt one by one.
    hot_docs: int = 1024
    block_bytes: int = BLOCK_BYTES
    part_bytes: int = PART_BYTES


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; bytes 0 follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    return np.ascontiguousarray(view).view(np.uint64).ravel()


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the string of the given size (8 or more) at each position, a run of positions at a time."""
    n = max(0, len(data) - size + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, RUN):
        m = min(RUN, n - a)
        u = eights(data[a:a + m + size - 1])
        h = u[:m] * PRIMES[0]
        for j, o in enumerate(range(8, size, 8)):
            o = min(o, size - 8)
            h ^= h >> np.uint64(29)
            h += u[o:o + m]
            h *= PRIMES[(j + 1) % 3]
        h ^= h >> np.uint64(32)
        out[a:a + m] = h
    return out


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each window of SPAN bytes the least hash of its GRAM-byte strings."""
    m, width, reach = string_hashes(data, GRAM), SPAN - GRAM + 1, 1
    while reach * 2 <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def window_runs(data: np.ndarray, sizes: np.ndarray, least: Callable = minimizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows of one minimizer inside one document: first window, number of windows (LONGEST at most), and a
    number for the minimizer that is spread evenly, as least hashes are not.

    data: documents of the given sizes, one after the other; least gives the minimizer of each window of SPAN symbols.
    """
    ends = np.cumsum(sizes)
    bad_from, found = np.maximum(ends - sizes, ends - SPAN + 1), []
    for a in range(0, len(data) - SPAN + 1, RUN):
        m = least(data[a:a + RUN + SPAN - 1])
        n = len(m)
        k = slice(*np.searchsorted(ends, [a, a + n + SPAN], "right"))  # documents that end here
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, np.clip(bad_from[k] - a, 0, n), 1)
        np.add.at(change, np.clip(ends[k] - a, 0, n), -1)
        good = np.cumsum(change[:n]) == 0
        first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (good[1:] != good[:-1])]))
        size = np.diff(np.append(first, n))
        keep = good[first]
        first, size = first[keep], size[keep]
        parts = (size + LONGEST - 1) // LONGEST
        if (parts > 1).any():
            turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, size = np.repeat(first, parts) + turn * LONGEST, np.minimum(np.repeat(size, parts) - turn * LONGEST, LONGEST)
        found.append((first + a, size, m[first]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    first, size, m = (np.concatenate(x) for x in zip(*found))
    m = (m ^ (m >> np.uint64(31))) * PRIMES[1]
    return first, size, m ^ (m >> np.uint64(29))


def table_of(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(PACKED)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED)], schema=PACKED)


def rows_of(table: pa.Table, kind: str) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    for k, block, a, b, c in zip(*[table[x] for x in ("kind", "block", "tokens", "docs", "extra")]):
        if k.as_py() == kind:
            yield block.as_py(), a.as_py(), b.as_py(), c.as_py()


# ---- 1: blocks

def block_rows(block_bytes: int) -> Callable:
    """docs: id, text. Rows M of the blocks: compressed texts, sizes, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, [[], []]

        def emit() -> pa.RecordBatch:
            nonlocal block, held
            sizes = np.array([len(t) for t in held[1]], np.uint64)
            ids = np.array([NO_ID if i is None else i for i in held[0]], np.int64)
            rows = [(block, "M", block, zstandard.compress(b"".join(held[1]), 6), small(sizes), small(ids))]
            block, held = block + 1, [[], []]
            return table_of(rows).to_batches()[0]

        size = 0
        for batch in batches:
            for part in slices(batch, 1, block_bytes):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                more = sum(map(len, texts))
                if held[0] and size + more > block_bytes:
                    yield emit()
                    size = 0
                held[0] += part.column(0).to_pylist()
                held[1] += texts
                size += more
        if held[0]:
            yield emit()

    return run


def opened(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sizes and ids of a block."""
    _, text, sizes, ids = row
    return np.frombuffer(zstandard.decompress(text), np.uint8), unsmall(sizes, np.uint64).astype(np.int64), unsmall(ids, np.int64)


# ---- 2: anchors

def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash, and the 16 bits that follow."""
    at = (h >> np.uint64(32)) * np.uint64(buckets)
    return (at >> np.uint64(32)).astype(np.int64), ((at >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def cut_at(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal numbers."""
    if not len(sorted_):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])).tolist()
    return list(zip(cuts, cuts[1:]))


def anchor_rows(buckets: int, symbols: Callable = opened, least: Callable = minimizers) -> Callable:
    """Each block's distinct minimizers with the number of documents that have them (T), by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(pa.Table.from_batches([batch]), "M"):
                data, sizes, _ = symbols(row)
                first, _, m = window_runs(data, sizes, least)
                doc = np.searchsorted(np.cumsum(sizes), first, "right")
                order = np.lexsort((doc, m))
                m, doc = m[order], doc[order]
                once = np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]) if len(m) else np.empty(0, bool)
                m = m[once]
                starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.empty(0, np.int64)
                counts = np.diff(np.append(starts, len(m))).astype(np.uint32)
                m = m[starts]
                bucket, _ = by_bucket(m, buckets)
                yield from table_of([(int(bucket[a]), "T", row[0], planes(m[a:b]), small(counts[a:b]), b"")
                                     for a, b in cut_at(bucket)]).to_batches()

    return run


def count_anchors(hot_docs: int) -> Callable:
    """The minimizers of each block that two or more documents have (R), and whether they are hot."""

    def run(table: pa.Table) -> pa.Table:
        parts = [(block, unplanes(a), unsmall(b, np.uint32)) for block, a, b, _ in rows_of(table, "T")]
        m, counts = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.argsort(m, kind="stable")
        ranked = m[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        docs = np.empty(len(m), np.int64)
        docs[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), starts), np.diff(np.append(starts, len(m))))
        out, at = [], 0
        for block, x, _ in parts:
            n = docs[at:at + len(x)]
            at += len(x)
            if (n > 1).any():
                out.append((0, "R", block, planes(x[n > 1]), np.packbits(n[n > 1] >= hot_docs).tobytes(), b""))
        return table_of(out)

    return run


# ---- 3: stretches

def stretches(buckets: int) -> Callable:
    """A block's distinct stretches (S), by bucket: bytes; size, least and largest id; place in the bucket; the first one's
    number. One row of their occurrences (O), by way of any bucket: how many each has, in the order of numbers, and where."""

    def run(table: pa.Table) -> pa.Table:
        anchors = [(unplanes(a), b) for _, a, b, _ in rows_of(table, "R")]
        if not anchors:
            return table_of([])
        shared = np.concatenate([a for a, _ in anchors])
        hot = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(a)).astype(bool) for a, b in anchors])
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        row = next(rows_of(table, "M"))
        data, sizes, ids = opened(row)
        first, count, m = window_runs(data, sizes)
        at = np.minimum(np.searchsorted(shared, m), len(shared) - 1)
        hit = shared[at] == m
        first, count, m, hot = first[hit], count[hit], m[hit], hot[at[hit]]
        # the windows of hot minimizers one by one, by their own hashes
        n = count[hot]
        each = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.concatenate([string_hashes(data[a:a + SPAN + int(b) - 1], SPAN) for a, b in zip(first[hot], n)]) if hot.any() else m[:0]
        first, count, m = np.concatenate([first[~hot], each]), np.concatenate([count[~hot], np.ones(len(each), np.int64)]), np.concatenate([m[~hot], own])
        if not len(m):
            return table_of([])
        size = count + SPAN - 1
        raw, known = data.tobytes(), {}
        number = np.fromiter((known.setdefault(raw[a:a + k], len(known)) for a, k in zip(first.tolist(), size.tolist())), np.int64, len(size))
        strings = list(known)
        del raw, known
        owner = ids[np.searchsorted(np.cumsum(sizes), first, "right")]
        lo, hi = extremes(number, len(strings), owner, owner)
        place = np.empty(len(strings), np.int64)
        place[number[::-1]] = np.arange(len(number))[::-1]  # of the first occurrence
        bucket, part = by_bucket(m[place], buckets)
        order = np.lexsort((part, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bucket, part, lo, hi, size = bucket[order], part[order], lo[order], hi[order], size[place][order]
        out = []
        for a, b in cut_at(bucket):
            facts = np.stack([size[a:b], lo[a:b], hi[a:b]])
            out.append((int(bucket[a]), "S", row[0], zstandard.compress(b"".join(strings[k] for k in order[a:b].tolist()), 3),
                        small(part[a:b]), a.to_bytes(8, "little") + small(facts.ravel())))
        number = rank[number]
        order = np.argsort(number, kind="stable")
        out.append((row[0] % buckets, "O", row[0], small(first[order].astype(np.uint64)), small(np.bincount(number).astype(np.uint32)), b""))
        return table_of(out)

    return run


def extremes(number: np.ndarray, n: int, least: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.full(n, NO_ID, np.int64), np.full(n, np.iinfo(np.int64).min, np.int64)
    np.minimum.at(lo, number, least)
    np.maximum.at(hi, number, largest)
    return lo, hi


# ---- 4: index

class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of a collection of strings.

    Rows are sorted suffixes, equal ones in the order of their strings; the first rows are the empty
    suffixes. least: the smallest owner of the rows whose suffixes agree on SPAN bytes.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, owners: np.ndarray):
        n = len(sizes)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        total = int(ends[-1]) if n else 0
        text = np.zeros(total + 8, np.uint8)
        string = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
        at = np.arange(total, dtype=np.int32)
        left = (ends[string] - 1 - at).astype(np.int32)  # bytes to the end of the string
        text[:total][left > 0] = data
        # rank by the first 7 bytes and how many there are; what lies beyond a string's end counts as 0
        u = np.minimum(left, 7).astype(np.uint64)
        for k in range(7):
            u |= np.where(left > k, text[k:k + total], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
        order = np.argsort(u)  # equal keys get equal ranks, so their order does not matter
        u = u[order]
        rank = np.empty(total, np.int32)
        rank[order] = np.cumsum(np.concatenate([[True], u[1:] != u[:-1]])) if total else 0
        longest, h = int(sizes.max()) if n else 0, 7
        half = rank
        while h < max(longest, SPAN):
            after = np.zeros(total, np.int64)
            far = left >= h
            after[far] = rank[at[far] + h]
            after += rank.astype(np.int64) * (total + 1)
            order = np.argsort(after)
            after = after[order]
            rank = np.empty(total, np.int32)
            rank[order] = np.cumsum(np.concatenate([[True], after[1:] != after[:-1]])) if total else 0
            h *= 2
            if h == HALF:
                half = rank
        rows = np.argsort(rank.astype(np.int64) * total + at).astype(np.int32)
        # rows that agree on SPAN bytes: on HALF at both ends of the window
        full = left >= SPAN
        window = np.full(total, -1, np.int64)
        window[full] = half[at[full]].astype(np.int64) * (total + 1) + half[at[full] + SPAN - HALF]
        w = window[rows]
        self.interval = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if total else np.empty(0, np.int64)
        owner = np.where(full, owners[string], NO_ID)[rows]
        self.least = np.minimum.reduceat(owner, self.interval) if total else owner
        # 0 where a string begins, else 1 + the byte before the suffix
        before = np.where(at[rows] == starts[string[rows]], 0, text[rows - 1].astype(np.int32) + 1)
        self.run = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if total else np.empty(0, np.int64)
        self.size = np.diff(np.append(self.run, total))
        self.byte = before[self.run]
        by_byte = np.argsort(self.byte, kind="stable")
        self.to = np.empty(len(self.run), np.int64)  # where a run's first row leads
        self.to[by_byte] = np.cumsum(self.size[by_byte]) - self.size[by_byte]
        self.by_byte, self.keys = by_byte, self.byte[by_byte].astype(np.int64) * len(self.run) + by_byte
        self.head, self.tail = rows[self.run], rows[self.run + self.size - 1]  # the samples: positions at the run ends
        self.left, self.eight, self.rows = left, eights(text[:total]), total

    def agree(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """On how many bytes, most at most, the suffixes at the positions p and q agree."""
        most = np.minimum(most, self.left[q])
        out, open_ = np.zeros(len(p), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            a, b = p[open_] + out[open_], q[open_] + out[open_]
            x = self.eight[a] ^ self.eight[b]
            same = x == 0
            low = x & (~x + np.uint64(1))
            out[open_] += np.where(same, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            open_ = open_[same & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def stream(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of each string, in order, the length of the longest match that starts there, SPAN at most, and
        where it is SPAN the least owner of an equal window, else NO_ID. All strings go back a byte in a step."""
        n, stops = int(sizes.sum()), np.cumsum(sizes)
        lengths, owners = np.zeros(n, np.int64), np.full(n, NO_ID, np.int64)
        if not self.rows:
            return lengths, owners
        lanes = np.argsort(-sizes, kind="stable")
        row, place = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.head[0], np.int64)
        length, step, runs = np.zeros(len(lanes), np.int64), 0, len(self.run)
        while True:
            step += 1
            n = np.searchsorted(-sizes[lanes], -step, "right")
            if not n:
                return lengths, owners
            lanes, row, place, length = lanes[:n], row[:n], place[:n], length[:n]
            at = stops[lanes] - step
            c = data[at].astype(np.int64) + 1
            r = np.searchsorted(self.run, row, "right") - 1
            away = np.flatnonzero(self.byte[r] != c)
            new = self.to[r] + row - self.run[r]
            if len(away):
                key = c[away] * runs + r[away]
                j = np.searchsorted(self.keys, key)
                up, down = self.by_byte[np.maximum(j - 1, 0)], self.by_byte[np.minimum(j, runs - 1)]
                has_up, has_down = (j > 0) & (self.byte[up] == c[away]), (j < runs) & (self.byte[down] == c[away])
                p, most = place[away], length[away]
                common = self.agree(np.concatenate([p, p]), np.concatenate([self.tail[up], self.head[down]]),
                                    np.concatenate([np.where(has_up, most, 0), np.where(has_down, most, 0)]))
                above, below = np.where(has_up, common[:len(p)], -1), np.where(has_down, common[len(p):], -1)
                rise = above >= below
                new[away] = np.where(rise, self.to[up] + self.size[up] - 1, self.to[down])
                place[away] = np.where(rise, self.tail[up], self.head[down])
                length[away] = np.maximum(above, below)
                none = away[~has_up & ~has_down]  # a byte that the index does not have: start anew
                new[none], place[none], length[none] = 0, self.head[0] + 1, -1
            row, place, length = new, place - 1, np.minimum(length + 1, SPAN)
            lengths[at] = length
            whole = np.flatnonzero(length == SPAN)
            owners[at[whole]] = self.least[np.searchsorted(self.interval, row[whole], "right") - 1]


def part_marks(strings: list[bytes], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct strings with the extremes of their ids: those that share a window with another document, the number of
    windows of each, and the least id of each window (NO_ID: only in strings that dropped out)."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    windows = sizes - SPAN + 1
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), windows)
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    h = string_hashes(data, SPAN)[at]
    order = np.argsort(h)
    h, of = h[order], of[order]
    group = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.diff(np.append(group, len(h)))
    first = np.minimum.reduceat(lo[of], group)
    several = np.repeat(first < np.maximum.reduceat(hi[of], group), many)
    shares, holds_first = np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
    shares[of[several]] = True
    holds_first[of[several & (lo[of] == np.repeat(first, many))]] = True
    chosen, reference = np.flatnonzero(shares), np.flatnonzero(holds_first)
    if not len(chosen):
        return chosen, chosen, chosen
    joined = lambda which: np.frombuffer(b"".join(strings[k] for k in which.tolist()), np.uint8)
    index = RunIndex(joined(reference), sizes[reference], lo[reference])
    _, owners = index.stream(joined(chosen), sizes[chosen])
    windows = windows[chosen]
    begin = np.cumsum(sizes[chosen]) - sizes[chosen]
    return chosen, windows, owners[np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))]


def mark_bucket(part_bytes: int) -> Callable:
    """Marks (P) of the stretches of a bucket, for the blocks: number of the stretch, from, to, and the least id. O rows pass."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for block, text, place, extra in rows_of(table, "S"):
            facts = unsmall(extra[8:], np.int64).reshape(3, -1)
            parts.append((block, int.from_bytes(extra[:8], "little"), zstandard.decompress(text), unsmall(place, np.uint16), facts,
                          np.concatenate([[0], np.cumsum(facts[0])])))
        total = sum(len(p[2]) for p in parts)
        step = max(1, (1 << 16) // (1 << max(0, (total // part_bytes).bit_length())))
        found: list[list] = [[] for _ in parts]
        for low in range(0, 1 << 16, step):
            known: dict[bytes, int] = {}
            number, least, largest, part, entry = [], [], [], [], []
            for k, (_, _, raw, place, facts, cuts) in enumerate(parts):
                a, b = np.searchsorted(place, [low, low + step])
                if a == b:
                    continue
                c = cuts[a:b + 1].tolist()
                number += [known.setdefault(raw[x:y], len(known)) for x, y in zip(c, c[1:])]
                least.append(facts[1, a:b])
                largest.append(facts[2, a:b])
                part.append(np.full(b - a, k, np.int32))
                entry.append(np.arange(a, b))
            if not number:
                continue
            least, largest, part, entry = map(np.concatenate, (least, largest, part, entry))
            number = np.array(number)
            lo, hi = extremes(number, len(known), least, largest)
            chosen, windows, owners = part_marks(list(known), lo, hi)
            if not len(chosen):
                continue
            # back from strings to the blocks' stretches
            string = np.full(len(known), -1, np.int64)
            string[chosen] = np.arange(len(chosen))
            mine = np.flatnonzero(string[number] >= 0)
            n = windows[string[number[mine]]]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            e = np.repeat(mine, n)
            first = owners[np.repeat((np.cumsum(windows) - windows)[string[number[mine]]], n) + offset]
            hit = first < largest[e]
            e, offset, first = e[hit], offset[hit], first[hit]
            if not len(e):
                continue
            a = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (offset[1:] != offset[:-1] + 1) | (first[1:] != first[:-1])]))
            b = np.append(a[1:], len(e)) - 1
            marks = np.stack([entry[e[a]], offset[a], offset[b] + SPAN, first[a]])
            home = part[e[a]]
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


# ---- 5: cut

CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
CUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cut_block(table: pa.Table) -> pa.Table:
    """A block's documents without the marked bytes."""
    data, sizes, ids = opened(next(rows_of(table, "M")))
    ends = np.cumsum(sizes)
    gone = np.zeros(len(data), bool)
    marks = [unsmall(c, np.int64).reshape(4, -1) for _, _, _, c in rows_of(table, "P")]
    if marks:
        _, where, counts, _ = next(rows_of(table, "O"))
        where, counts = unsmall(where, np.uint64).astype(np.int64), unsmall(counts, np.uint32).astype(np.int64)
        begin = np.cumsum(counts) - counts
        change = np.zeros(len(data) + 1, np.int32)
        for number, start, stop, least in marks:
            n = counts[number]
            k = np.repeat(begin[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at = where[k]
            hit = np.repeat(least, n) < ids[np.searchsorted(ends, at, "right")]
            np.add.at(change, (at + np.repeat(start, n))[hit], 1)
            np.add.at(change, (at + np.repeat(stop, n))[hit], -1)
        gone = np.cumsum(change, dtype=np.int32)[:len(data)] > 0
    out: list[list] = [[] for _ in CUT]
    for a, b, i in zip((ends - sizes).tolist(), ends.tolist(), ids.tolist()):
        g = gone[a:b]
        n = int(g.sum())
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
        kept = data[a:b][~g].tobytes() if n else data[a:b].tobytes()
        for column, value in zip(out, (None if i == NO_ID else i, b - a, n, spans, kept)):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, CUT)], schema=CUT)


def remove_repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes): one row for each row of docs."""
    spark = docs.sparkSession
    blocks = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(block_rows(params.block_bytes), PACKED_SQL), "text-blocks")
    buckets = buckets_for(blocks, BUCKET_BYTES)
    # no step's DataFrame is kept when it is stored, so that its shuffle files can go
    shared = materialise(blocks.mapInArrow(anchor_rows(buckets), PACKED_SQL).repartition(buckets, "route").groupBy("route").applyInArrow(
        count_anchors(params.hot_docs), PACKED_SQL), "shared-anchors")
    release(spark)
    found = shared.unionByName(blocks).repartition(buckets, "block").groupBy("block").applyInArrow(stretches(buckets), PACKED_SQL)
    marks = materialise(found.repartition(buckets, "route").groupBy("route").applyInArrow(mark_bucket(params.part_bytes), PACKED_SQL), "marks")
    del found
    drop_tables(shared)
    release(spark)
    return marks.unionByName(blocks).repartition(buckets, "block").groupBy("block").applyInArrow(cut_block, CUT_SQL)
