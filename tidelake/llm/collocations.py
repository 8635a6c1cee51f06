"""Phrases whose words keep together, by best-first branch-and-bound growth from prefixes.

A candidate is a phrase of two to LONGEST words that occurs Params.min_count times or more. Its
score is the least, over all cuts in two, of floor(2,000,000 a / (l + r)), where a, l and r count the
phrase and its two parts. A candidate that lies inside a longer one with 80 % of its count is dropped.

1. Blocks hold the words of the texts as numbers, by language. In all that follows a block sends each
   bucket of the hash space its distinct strings with their counts, and learns which of them are
   frequent everywhere; no string reaches a bucket more than once from a block, and no vocabulary is
   broadcast. Words that are not frequent end all phrases and leave the blocks. Frequent words and pairs
   get a number from their bucket, and a longer string is sent as the numbers of two parts: what is
   sent follows the count of distinct strings, at a few bytes each. Blocks move three times; which
   pairs make up a frequent triple or four words is read from its number, and their counts are joined.
2. All pairs of frequent words are counted. Longer phrases are grown from the frontier: since a is at
   most the count m of any part, a phrase that begins with p and ends with s scores at most
   2,000,000 m / (m + count of its first word), and likewise with its last word. A prefix (or ending)
   is expanded while this bound reaches the language's threshold, the best bounds first: the first
   threshold is the score that Params.slack times Params.limit pairs have.
3. What can drop a candidate is grown as well: a phrase that contains a pair or triple whose score
   reaches the threshold, while its parts have 80 % of that one's count.
4. So all candidates that reach the threshold are known, and what drops them. A language with
   Params.limit survivors at or above it is settled, ties included; the others go on with a threshold
   that Params.slack (2 at least) times as many pairs have, and with none in the end.

Whether a phrase is expanded depends on counts over all documents only, so every occurrence of it is
counted. Bounds are taken in doubles and widened; scores and comparisons are exact in integers.

Nulls: a null text is empty; a null language is "und", together with that word itself. Repeated rows
count as often as they occur. Languages with few candidates return all. An empty table gives an empty
result. Texts are taken whole; one that is longer than a block is a block of its own. Other columns do
not come along. Words are told apart by 96 bits of hashes while they are counted, phrases exactly.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets_for, drop_tables, materialise, release, slices
from .jaccard import MULTIPLY, PACKED_SQL, small, unsmall
from .suffix import by_bucket, cut_at, rows_of, table_of

TWICE = 2_000_000
LONGEST = 4
SHARES = 64
BLOCK_BYTES = 1 << 22
#: Bytes of the stored blocks for each bucket.
BUCKET_BYTES = 1 << 22
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
#: Ends a piece: no byte of UTF-8.
STOP = b"\xff"
STOPS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", STOP * 10)


@dataclass(frozen=True)
class Params:
    min_count: int = 30
    limit: int = 2000
    #: A phrase is dropped for a longer one with so many percent of its count.
    drop_percent: int = 80
    #: How many times the limit of pairs the threshold is lowered to.
    slack: int = 4
    #: So many languages can have a threshold; others are expanded at once and in full.
    languages: int = 4096
    block_bytes: int = BLOCK_BYTES


# ---- blocks

class Codes(dict):
    """The words of a language to numbers that all languages of a block share."""

    def __init__(self, words: list[bytes]):
        super().__init__({STOP: 0})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        value = self[word] = len(self.words)
        return value


def tokens(text: str | None) -> list[bytes]:
    """Words, and STOP between pieces."""
    return (text or "").encode().lower().translate(STOPS).replace(STOP, b" \xff ").split()  # on bytes: A-Z, space and tab only


@dataclass
class Block:
    number: int
    #: Of each word: 0 is the end of a piece, a text, or a stretch without frequent words.
    codes: np.ndarray
    #: From number 1.
    words: list[bytes]
    language: np.ndarray
    languages: list[str]
    #: By number of words: sorted keys of frequent phrases, and their counts.
    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: The numbers of the words and of known[2], from 1, and how many bits they have; the block's own if there are no others.
    ids: np.ndarray | None = None
    word_bits: int | None = None
    pairs: np.ndarray | None = None
    pair_bits: int | None = None

    def row(self, route: int = 0) -> tuple:
        known = {n: (small_keys(k, self.bits(n)), small(f)) for n, (k, f) in self.known.items()}
        ids = [None if a is None else small(a.astype(np.uint64)) for a in (self.ids, self.pairs)]
        rest = small(self.language.astype(np.uint16)), self.languages, known, ids, self.word_bits, self.pair_bits
        return (route, "M", self.number, small(self.codes.astype(np.uint32)), zstandard.compress(b"\n".join(self.words), 3), pickle.dumps(rest))

    @classmethod
    def read(cls, row: tuple) -> Block:
        number, codes, words, rest = row
        language, languages, known, ids, word_bits, pair_bits = pickle.loads(rest)
        text = zstandard.decompress(words)
        ids, pairs = (None if a is None else unsmall(a, np.uint64) for a in ids)
        b = cls(number, unsmall(codes, np.uint32).astype(np.int64), text.split(b"\n") if text else [], unsmall(language, np.uint16), languages,
                {}, ids, word_bits, pairs, pair_bits)
        b.known = {n: (unsmall_keys(k, b.bits(n)), unsmall(f, np.int64)) for n, (k, f) in known.items()}
        return b

    def bits(self, size: int) -> int:
        """Of the keys of so many words."""
        word = self.word_bits or max(1, len(self.words).bit_length())
        pair = self.pair_bits or max(1, len(self.known.get(2, ((),))[0]).bit_length())
        return bits_of(size, word, pair)


def bits_of(size: int, word: int, pair: int) -> int:
    """A pair is two words, a triple a pair and a word, four words are two pairs. A word alone: its number."""
    bits = {1: 64, 2: 2 * word, 3: pair + word, 4: 2 * pair}[size]
    if bits > 64:
        raise ValueError(f"phrases of {size} words need {bits} bits")
    return bits


INVERSE = {x: np.uint64(pow(int(x), -1, 1 << 64)) for x in (MULTIPLY, OTHER)}


def mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def scrambled(number: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits as keys that are spread over 64 bits, one to one."""
    x = (number * MULTIPLY) & mask(bits)
    x ^= x >> np.uint64((bits + 1) // 2)
    return ((x * OTHER) & mask(bits)) << np.uint64(64 - bits)


def unscrambled(key: np.ndarray, bits: int) -> np.ndarray:
    x = ((key >> np.uint64(64 - bits)) * INVERSE[OTHER]) & mask(bits)
    x ^= x >> np.uint64((bits + 1) // 2)
    return (x * INVERSE[MULTIPLY]) & mask(bits)


def small_keys(sorted_: np.ndarray, bits: int) -> bytes:
    """Sorted keys of so many bits as their differences."""
    return small(np.diff(sorted_ >> np.uint64(64 - bits), prepend=np.uint64(0)))


def unsmall_keys(b: bytes, bits: int) -> np.ndarray:
    return np.cumsum(unsmall(b, np.uint64), dtype=np.uint64) << np.uint64(64 - bits)


def block_rows(block_bytes: int) -> Callable:
    """docs: lang, text. Rows M."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        words: list[bytes] = []
        codes: dict[str, Codes] = {}
        held: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            nonlocal number, size, words, codes, held
            language = np.zeros(len(words), np.uint16)
            for k, own in enumerate(codes.values()):
                language[np.fromiter(own.values(), np.int64, len(own))[1:] - 1] = k
            at = np.concatenate(held)
            order = np.argsort(-np.bincount(at, minlength=len(words) + 1)[1:], kind="stable")  # frequent words get small numbers, which compress better
            new = np.zeros(len(words) + 1, np.int64)
            new[order + 1] = np.arange(1, len(words) + 1)
            out = table_of([Block(number, new[at], [words[k] for k in order.tolist()], language[order], list(codes)).row()]).to_batches()[0]
            number, size, words, codes, held = number + 1, 0, [], {}, []
            return out

        for batch in batches:
            for part in slices(batch, 1, block_bytes):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if held and (size + len(text or "") > block_bytes or len(codes) == 60_000):
                        yield emit()
                    size += len(text or "")
                    own = codes.setdefault("und" if lang is None else lang, Codes(words))
                    held.append(np.array([*map(own.__getitem__, tokens(text)), 0], np.int64))
        if held:
            yield emit()

    return run


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of each language in a block."""
    for batch in batches:
        for row in rows_of(pa.Table.from_batches([batch]), "M"):
            b = Block.read(row)
            n = np.bincount(b.language[b.codes[b.codes > 0] - 1], minlength=len(b.languages))
            yield pa.RecordBatch.from_arrays([pa.array(b.languages, pa.string()), pa.array(n, pa.int64())], ["lang", "n"])


# ---- phrases in a block

@dataclass(frozen=True)
class Thresholds:
    """By language; default for the others."""

    by: dict[str, int]
    default: float

    def of(self, languages: list[str]) -> np.ndarray:
        return np.array([self.by.get(x, self.default) for x in languages], np.float64)


class Phrases:
    """The phrases at each position of a block: keys and, where they are known and frequent, counts."""

    def __init__(self, block: Block):
        self.block, self.n = block, len(block.codes)
        self.word_keys = np.arange(1, len(block.words) + 1, dtype=np.uint64) if block.ids is None else block.ids
        self.keys = {1: np.concatenate([[np.uint64(0)], self.word_keys])[block.codes]}
        self.counts: dict[int, np.ndarray] = {}
        if 1 in block.known:
            count = np.zeros(len(self.word_keys) + 1, np.int64)
            count[1:] = self.look(1, self.word_keys)
            self.counts[1] = count[block.codes]
            for size in range(2, LONGEST + 1):
                if size in block.known:
                    self.counts[size] = np.zeros(self.n, np.int64)
                    at = self.possible(size)
                    self.counts[size][at] = self.look(size, self.key(size)[at])

    def look(self, size: int, keys: np.ndarray) -> np.ndarray:
        known, counts = self.block.known[size]
        if not len(known):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, counts[at], 0)

    def ahead(self, a: np.ndarray, k: int) -> np.ndarray:
        """a of the position k further, 0 beyond the end."""
        return np.concatenate([a[k:], np.zeros(min(k, len(a)), a.dtype)])

    def key(self, size: int) -> np.ndarray:
        if size not in self.keys:
            word, pair = (np.uint64(self.block.bits(n) // 2) for n in (2, 4))
            first, second = (self.keys[1], self.keys[1]) if size == 2 else (self.pair(), self.keys[1] if size == 3 else self.pair())
            number = (first << (pair if size == 4 else word)) | self.ahead(second, 1 if size == 2 else 2)
            self.keys[size] = scrambled(number, self.block.bits(size))
        return self.keys[size]

    def pair(self) -> np.ndarray:
        """The numbers of the pairs, 0 where they are not frequent."""
        known = self.block.known[2][0]
        out, at = np.zeros(self.n, np.uint64), np.flatnonzero(self.counts[2])
        place = np.searchsorted(known, self.key(2)[at])
        out[at] = place + 1 if self.block.pairs is None else self.block.pairs[place]
        return out

    def possible(self, size: int) -> np.ndarray:
        """The positions whose pairs (for a pair: whose words) are frequent."""
        part, n = (self.counts[1], 2) if size == 2 else (self.counts[2], size - 1)
        ok = part > 0
        for k in range(1, n):
            ok &= self.ahead(part, k) > 0
        return np.flatnonzero(ok)

    def score(self, size: int) -> np.ndarray:
        """Scores as doubles, 0 where the phrase or a part is not known as frequent."""
        a, out = self.counts[size].astype(np.float64), np.full(self.n, np.inf)
        for k in range(1, size):
            left, right = self.counts[k], self.ahead(self.counts[size - k], k)
            out = np.minimum(out, np.where((left > 0) & (right > 0), TWICE * a / np.maximum(left + right, 1), 0))
        return out

    def expanded(self, size: int, thresholds: Thresholds, keep: float) -> np.ndarray:
        """The positions whose phrases of so many words have to be counted."""
        at = self.possible(size)
        if not len(at):
            return at
        b = self.block
        t = thresholds.of(b.languages)[b.language[b.codes[at] - 1]] * (1 - 1e-9)
        f = lambda n, k=0: self.ahead(self.counts[n], k)[at].astype(np.float64)
        most = np.minimum(f(2), f(2, 1))
        if size == 3:
            first, last = f(1), f(1, 2)
            reach = np.maximum(most / (most + first), most / (most + last)) * TWICE >= t  # as a prefix, or as an ending
        else:
            most = np.minimum(most, f(2, 2))
            reach = np.ones(len(at), bool)
            expanded = np.zeros(self.n, bool)
            expanded[self.expanded(3, thresholds, keep)] = True
            for k in (0, 1):
                count = f(3, k)
                known = self.ahead(expanded, k)[at]
                reach &= ~known | (count > 0)  # counted, and not frequent
                most = np.where(known, np.minimum(most, count), most)
            possible = reach.copy()
            bound = np.minimum(most / (most + f(1)), most / (most + f(1, 3)))
            bound = np.minimum(bound, most / (f(2) + f(2, 2)))
            reach &= bound * TWICE >= t
        for n in range(2, size):
            score = self.score(n)
            for k in range(size - n + 1):
                settles = (self.ahead(score, k)[at] >= t) & (most >= keep * f(n, k) * (1 - 1e-9)) & (f(n, k) > 0)
                reach |= settles & (t < np.inf) & (True if size == 3 else possible)
        return at[reach & (t < np.inf)]


def strings(b: Block, size: int, thresholds: Thresholds | None = None, keep: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words or phrases that have to be counted: sorted keys and counts; for words the words, and their checks by word."""
    if size == 1:
        seeds = [xxhash.xxh3_64_intdigest(x) for x in b.languages]
        of = [seeds[k] for k in b.language.tolist()]
        key, check = (np.array([*map(f, b.words, of)], np.uint64) for f in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest))
        order = np.argsort(key)
        return key[order], np.bincount(b.codes, minlength=len(key) + 1)[1:][order], order, (check[order] >> np.uint64(32)).astype(np.uint32)
    p = Phrases(b)
    key = np.sort(p.key(size)[p.possible(2) if size == 2 else p.expanded(size, thresholds, keep)])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def sent(b: Block, size: int, buckets: int, thresholds: Thresholds | None = None, keep: float = 0.8) -> Iterator[tuple]:
    """Rows T: strings() by bucket."""
    key, counts, *rest = strings(b, size, thresholds, keep)
    bucket, _ = by_bucket(key, buckets)
    for i, j in cut_at(bucket):
        yield int(bucket[i]), "T", b.number, small_keys(key[i:j], b.bits(size)), small(counts[i:j].astype(np.uint32)), small(rest[1][i:j]) if rest else b""


def string_rows(size: int, buckets: int, thresholds: Thresholds | None = None, keep: float = 0.8) -> Callable:
    """A block's distinct words or phrases with their counts (T), by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(pa.Table.from_batches([batch]), "M"):
                yield from table_of(list(sent(Block.read(row), size, buckets, thresholds, keep))).to_batches()

    return run


def count_strings(size: int, buckets: int, bits: int, min_count: int) -> Callable:
    """What is frequent over all blocks of a bucket (F): the largest number given, keys and counts; and to each block that has some of
    it (R): which of its strings, their numbers and counts, and which of them this block describes; each is described once."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["route"][0].as_py()
        parts = [(block, unsmall_keys(a, bits), unsmall(b, np.uint32), unsmall(c, np.uint32) if c else None) for block, a, b, c in rows_of(table, "T")]
        key, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        check = np.concatenate([p[3] for p in parts]) if size == 1 else None
        order = np.argsort(key, kind="stable") if size > 1 else np.lexsort((check, key))
        sorted_ = key[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        if size == 1:
            new[1:] |= check[order[1:]] != check[order[:-1]]
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[order].astype(np.int64), first)
        often = total >= min_count
        number = np.where(often, (np.cumsum(often) - 1) * buckets + bucket + 1, 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        speaks = np.zeros(len(order), bool)
        speaks[order[first]] = True
        out, at = [(bucket, "F", int(number.max()), small_keys(sorted_[first[often]], bits), small(total[often]), b"")] if often.any() else [], 0
        for block, keys, *_ in parts if size < LONGEST else []:
            mine = slice(at, at + len(keys))
            at += len(keys)
            of = group[mine]
            here = often[of]
            if here.any():
                of = of[here]
                extra = np.packbits(here).tobytes(), small(number[of]) if size < 3 else b"", np.packbits(speaks[mine][here]).tobytes() if size == 2 else b""
                out.append((bucket, "R", block, extra[0], small(total[of]), pickle.dumps(extra[1:])))
        return table_of(out)

    return run


def learnt(size: int, buckets: int, bits: int, thresholds: Thresholds | None = None, keep: float = 0.8) -> Callable:
    """A block with the counts of its frequent phrases of so many words (M). With pairs, those that it describes (D); with triples,
    the strings of four words (T) instead. bits: of the numbers of words or pairs."""

    def run(table: pa.Table) -> pa.Table:
        b = Block.read(next(rows_of(table, "M")))
        key, _, *rest = strings(b, size, thresholds, keep)
        bucket, _ = by_bucket(key, buckets)
        ranges = {int(bucket[i]): (i, j) for i, j in cut_at(bucket)}
        often, speaks = np.zeros(len(key), bool), np.zeros(len(key), bool)
        count, ids = np.zeros(len(key), np.int64), np.zeros(len(key), np.uint64)
        answers = table.filter(pc.equal(table["kind"], "R"))
        for route, which, counts, extra in zip(*[answers[x].to_pylist() for x in ("route", "tokens", "docs", "extra")]):
            i, j = ranges[route]
            at = i + np.flatnonzero(np.unpackbits(np.frombuffer(which, np.uint8), count=j - i))
            often[at], count[at] = True, unsmall(counts, np.int64)
            number, said = pickle.loads(extra)
            if number:
                ids[at] = unsmall(number, np.uint64)
            if said:
                speaks[at] = np.unpackbits(np.frombuffer(said, np.uint8), count=len(at)).astype(bool)
        if size == 1:
            order = rest[0]
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            return table_of([without_rare(b, often[back], count[back], ids[back], bits).row()])
        b.known[size] = key[often], count[often]
        if size == 3:
            return table_of(list(sent(b, 4, buckets, thresholds, keep)))
        b.pairs, b.pair_bits = ids[often], bits
        p = Phrases(b)
        keys, place = np.unique(p.key(2)[at := np.flatnonzero(p.counts[2])], return_index=True)
        said = at[place[speaks[often]]]
        numbers = np.stack([p.keys[1][said], p.keys[1][said + 1]]) if len(said) else np.empty(0, np.uint64)
        told = (0, "D", b.number, small(b.pairs[speaks[often]]), small(numbers.ravel()), described(p, said, 2))
        b.words = []
        return table_of([b.row(), told])

    return run


def without_rare(b: Block, often: np.ndarray, count: np.ndarray, ids: np.ndarray, bits: int) -> Block:
    """The block without words that are not frequent; stretches of them become one 0. Of each word: whether it is, its count and number."""
    new = np.concatenate([[0], np.where(often, np.cumsum(often), 0)])
    codes = new[b.codes]
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])] if len(codes) else codes
    kept = np.flatnonzero(often)
    order = np.argsort(ids[kept])
    known = {1: (ids[kept][order], count[kept][order])}
    return Block(b.number, codes, [b.words[k] for k in kept.tolist()], b.language[kept], b.languages, known, ids[kept], bits)


def described(p: Phrases, at: np.ndarray, size: int) -> bytes:
    """Language, phrase, number of words, count, the counts of the parts at the lowest cut, and score, null where a part's count
    is not known, which is so only below the threshold."""
    words, codes, b = p.block.words, p.block.codes, p.block
    rows = []
    for i in at.tolist():
        c = codes[i:i + size].tolist()
        a, cuts = int(p.counts[size][i]), []
        for k in range(1, size):
            left, right = int(p.counts[k][i]), int(p.counts[size - k][i + k])
            cuts.append((TWICE * a // (left + right), k, left, right) if left and right else None)
        score, _, left, right = min(cuts) if all(cuts) else (None,) * 4
        rows.append((b.languages[b.language[c[0] - 1]], b" ".join(words[x - 1] for x in c).decode(), size, a, left, right, score))
    return zstandard.compress(json.dumps(rows).encode(), 3)


PHRASE_SQL = "lang string, phrase string, size long, a long, l long, r long, score long"
PAIR_SQL = f"{PHRASE_SQL}, id long, first long, last long"
FOUND_SQL = "left long, right long, a long"


def pair_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows D: phrases with the numbers of the pair and of its words."""
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
    for batch in batches:
        for ids, words, text in zip(*[batch.column(x) for x in ("tokens", "docs", "extra")]):
            rows = json.loads(zstandard.decompress(text.as_py()))
            columns = list(zip(*rows)) if rows else [[]] * 7
            numbers = [unsmall(ids.as_py(), np.int64), *unsmall(words.as_py(), np.int64).reshape(2, -1)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], *map(pa.array, numbers)],
                                             [c.split()[0] for c in PAIR_SQL.split(", ")])


def found_columns(bits: int, last: int) -> Callable:
    """Rows F: the numbers of the two parts of each frequent string, the second of so many bits, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("tokens"), batch.column("docs")):
                number = unscrambled(unsmall_keys(keys.as_py(), bits), bits)
                parts = (number >> np.uint64(last)).astype(np.int64), (number & mask(last)).astype(np.int64), unsmall(counts.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, parts)], [c.split()[0] for c in FOUND_SQL.split(", ")])

    return run


# ---- the whole

def _counted(strings_: DataFrame, buckets: int, size: int, bits: int, min_count: int) -> DataFrame:
    return materialise(strings_.repartition(buckets, "route").groupBy("route").applyInArrow(
        count_strings(size, buckets, bits, min_count), PACKED_SQL), f"frequent-{size}")


def _met(blocks: DataFrame, frequent: DataFrame, buckets: int, step: Callable) -> DataFrame:
    both = blocks.filter("kind = 'M'").unionByName(frequent.filter("kind = 'R'"))
    return both.repartition(buckets, "block").groupBy("block").applyInArrow(step, PACKED_SQL)


def _bits(frequent: DataFrame) -> int:
    """Of the largest number that a bucket gave."""
    return max(1, (frequent.filter("kind = 'F'").agg(F.max("block")).first()[0] or 0).bit_length())


def _scored(rows: DataFrame, cuts: list[tuple[str, str]], size: int) -> DataFrame:
    """l, r and score of the lowest cut, of the first if there are several; null where a part's count is null. Exact beyond 64 bits."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    each = [f"named_struct('score', ({TWICE} * {wide('a')}) div ({wide(x)} + {wide(y)}), 'k', {k}, 'l', {x}, 'r', {y})" for k, (x, y) in enumerate(cuts)]
    known = " and ".join(f"{x} is not null" for cut in cuts for x in cut)
    return (rows.withColumn("size", F.lit(size).cast("long")).withColumn("cut", F.expr(f"if({known}, least({', '.join(each)}), null)"))
            .withColumns({x: F.col(f"cut.{x}").cast("long") for x in ("l", "r", "score")}).drop("cut"))


def _triples(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """found: pair, word, a. The triples with their words' numbers of pair and word."""
    x = pairs.selectExpr("id as left", "lang", "phrase as x", "last as middle", "a as fx", "l as f1")
    y = pairs.selectExpr("first as middle", "last as right", "phrase as y", "a as fy", "r as f3", "id as second")
    rows = found.join(x, "left").join(y, ["middle", "right"]).withColumn("phrase", F.expr("concat(x, ' ', substring_index(y, ' ', -1))"))
    return _scored(rows, [("f1", "fy"), ("fx", "f3")], 3).select(*[c.split()[0] for c in PHRASE_SQL.split(", ")], "left", "right")


def _fours(found: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """found: pair, pair, a. A triple that is not known has no count, nor have the four words a score then."""
    x = pairs.selectExpr("id as left", "lang", "phrase as x", "last as w2", "a as fx", "l as f1")
    z = pairs.selectExpr("id as right", "phrase as z", "first as w3", "last as w4", "a as fz", "r as f4")
    y = pairs.selectExpr("first as w2", "last as w3", "id as middle")
    front = triples.selectExpr("left", "right as w3", "a as front")
    back = triples.selectExpr("left as middle", "right as w4", "a as back")
    rows = found.join(x, "left").join(z, "right").join(y, ["w2", "w3"]).join(front, ["left", "w3"], "left").join(back, ["middle", "w4"], "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", "x", "z"))
    return _scored(rows, [("f1", "back"), ("fx", "fz"), ("front", "f4")], 4).select(*[c.split()[0] for c in PHRASE_SQL.split(", ")])


def _thresholds(pairs: DataFrame, most: int, languages: int) -> dict[str, int]:
    """For languages with more than so many pairs, a score that so many reach; from counts of a thousand ranges of scores."""
    steps = pairs.groupBy("lang", F.expr("score div 1000").alias("step")).count()
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    upto = steps.withColumns({"upto": F.sum("count").over(down), "total": F.sum("count").over(Window.partitionBy("lang"))})
    found = (upto.filter((F.col("total") > most) & (F.col("upto") >= most)).groupBy("lang", "total").agg(F.max("step").alias("step"))
             .filter("step > 0").orderBy(F.desc("total"), "lang").limit(languages))
    return {r["lang"]: 1000 * r["step"] for r in found.collect()}


def _floor(thresholds: dict[str, int], default: float) -> Column:
    """The threshold of a row's language; null for those that are settled."""
    other = F.lit(0 if default == 0 else None).cast("long")
    if not thresholds:
        return other
    return F.coalesce(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("lang")].cast("long"), other)


def _survivors(candidates: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """The candidates that lie in no longer phrase with so many percent of their count."""
    words = longer.filter("size > 2").select("lang", F.col("a").alias("longest"), "size", F.split("phrase", " ").alias("w"))
    sizes = words.select("lang", "longest", "w", "size", F.explode(F.sequence(F.lit(2).cast("long"), F.col("size") - 1)).alias("n"))
    parts = sizes.select("lang", "longest", "w", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - F.col("n") + 1)).alias("i"))
    inside = (parts.select("lang", "longest", F.array_join(F.slice("w", F.col("i").cast("int"), F.col("n").cast("int")), " ").alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longest").alias("longest")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * percent)).drop("longest")


def best_phrases(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs: lang, text. lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    keep, order = params.drop_percent / 100, (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # ranked by shares of a language first, so that a language's last ranking has SHARES times limit rows at most
    shares, best = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order), Window.partitionBy("lang").orderBy(*order)
    blocks = materialise(docs.select("lang", "text").mapInArrow(block_rows(params.block_bytes), PACKED_SQL), "phrase-blocks")
    n = materialise(blocks.mapInArrow(totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    buckets = buckets_for(blocks, BUCKET_BYTES)
    given: list[int] = []
    for size in (1, 2):
        frequent = _counted(blocks.filter("kind = 'M'").mapInArrow(string_rows(size, buckets), PACKED_SQL), buckets, size,
                            64 if size == 1 else 2 * given[0], params.min_count)
        given.append(_bits(frequent))
        release(docs.sparkSession)
        before, blocks = blocks, materialise(_met(blocks, frequent, buckets, learnt(size, buckets, given[-1])), f"phrases-{size}")
        drop_tables(before, frequent)
        release(docs.sparkSession)
    word, pair = given
    pairs = materialise(blocks.filter("kind = 'D'").mapInArrow(pair_columns, PAIR_SQL), "pairs")
    done, most, default = [], params.slack * params.limit, 0.0
    thresholds = _thresholds(pairs, most, params.languages)
    while True:
        limits = Thresholds(thresholds, default)
        asked = blocks.filter("kind = 'M'").mapInArrow(string_rows(3, buckets, limits, keep), PACKED_SQL)
        three = _counted(asked, buckets, 3, bits_of(3, word, pair), params.min_count)
        four = _counted(_met(blocks, three, buckets, learnt(3, buckets, pair, limits, keep)), buckets, 4, bits_of(4, word, pair), params.min_count)
        parts = [df.filter("kind = 'F'").mapInArrow(found_columns(bits_of(n, word, pair), last), FOUND_SQL) for df, n, last in ((three, 3, word), (four, 4, pair))]
        triples = materialise(_triples(parts[0], pairs), "triples")
        fours = materialise(_fours(parts[1], pairs, triples), "fours")
        used = [three, four, triples, fours]
        found = pairs.drop("id", "first", "last").unionByName(triples.drop("left", "right")).unionByName(fours)
        reached = found.filter(F.col("score") >= _floor(thresholds, default))
        survivors = _survivors(reached, found, params.drop_percent)
        for window in (shares, best):
            survivors = survivors.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= params.limit)
        round_ = materialise(survivors, "survivors")
        drop_tables(*used)
        short = []
        if thresholds:
            enough = {r["lang"]: r["count"] for r in round_.filter(F.col("lang").isin(list(thresholds))).groupBy("lang").count().collect()}
            short = [x for x in thresholds if enough.get(x, 0) < params.limit]
        done.append(round_.filter(~F.col("lang").isin(short)) if short else round_)
        if not short:
            break
        release(docs.sparkSession)
        most *= max(2, params.slack)
        lower = _thresholds(pairs.filter(F.col("lang").isin(short)), most, params.languages)
        thresholds, default = {x: min(lower.get(x, 0), thresholds[x] - 1) for x in short}, np.inf
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
