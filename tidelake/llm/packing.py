"""Hierarchical packing of documents into training sequences.

A document is routed to the smallest context tier that holds it; what is longer than the longest
tier is first cut into whole windows of it. Each tier packs whole pieces while they fit; the gap
that remains is filled with pieces of shorter tiers and then by a cut, so that every window is
exactly full and needs no padding. A task's last tokens go into windows of falling powers of two.
Windows are dealt into step groups of step_tokens tokens each; a task's last groups hold what is left.

It is one pass over a table's partitions, without a shuffle and with a bounded buffer for each tier,
so the sequences depend on the partitions of the input; a task that runs again makes the same ones.
Nulls: a null text is an empty document, of one token (the end token); a null doc_id is kept.
Repeated rows are packed each. An empty table gives an empty result. Texts are tokenized whole, one
longer than a slice (2 MB) by itself. Other columns do not come along.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

END_ID = 1
#: What is tokenized apart from the letter or digit before it.
PUNCTUATION = ".,;:!?"
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long, tier long, step_id long")


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    tiers: tuple[int, ...] = (2048, 1024, 512, 256)
    #: Windows' worth of tokens that a tier gathers before it packs.
    lookahead: int = 4
    step_tokens: int = 32768
    #: Words in each of the two generations of a worker's cache.
    cache: int = 300_000


class Words(dict):
    """Word to token ids (bytes). A word that is not there yet gets an empty box, to be filled before it is read, and is listed in new."""

    def __init__(self) -> None:
        self.old: dict[str, bytes] = {}
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytes | bytearray:
        if not word or word != word.strip():  # white space beside white space
            raise KeyError(word)
        ids = self.old.get(word)
        if ids is None:
            ids = bytearray()
            self.new.append(word)
        self[word] = ids
        return ids

    def age(self, limit: int) -> None:
        """What was not asked for since the last call but one of the calls that found it full is forgotten."""
        if len(self) > limit:
            self.old = dict(self)
            self.clear()


class Tokens:
    """Token ids of whole texts by the tokenizer's file, with a cache of words.

    The tokenizer's first step (its pattern) starts a new unit at each white space that follows
    another character, and between a letter or digit and punctuation. So the ids of a word with the
    space before it, or of a word that starts a line, do not depend on what is around it, and those
    of a line end between two words are always the same. Texts in which white space meets white
    space, or that hold one of the tokenizer's added tokens, are given to the tokenizer whole.
    """

    def __init__(self, path: str, cache: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        starts = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            starts[i] = word.startswith("Ġ")  # how byte-level vocabularies write a space
        self.starts, self.cache = starts, cache
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self.whole("\n")
        self.spaced, self.bare = Words(), Words()
        self.ends: dict[str, bytes] = {}  # punctuation that ends a word

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def row(self, text: str) -> list:
        """The ids of the text's parts, some of which are boxes still."""
        if any(x in text for x in self.added):
            return [self.whole(text).tobytes()]
        out, end, spaced = [], self.line_end.tobytes(), self.spaced.__getitem__
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(self.bare[first])
                out.extend(map(spaced, rest))
                out.append(end)
        except KeyError:
            return [self.whole(text).tobytes()]
        return out[:-1]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        self.spaced.age(self.cache)
        self.bare.age(self.cache // 4)
        rows = [self.row(text) if text else [] for text in texts]
        self.learn(self.spaced, " ", self.starts)
        self.learn(self.bare, "\n", None)
        return [b"".join(r) for r in rows]

    def learn(self, words: Words, lead: str, starts: np.ndarray | None) -> None:
        """Fills the boxes of new words: from what is known of the word without punctuation at its end, or by the tokenizer."""
        plain, joined, new = [], [], words.new
        words.new = []
        for w in new:
            base = w.rstrip(PUNCTUATION)
            if base != w and base and base[-1].isalnum() and base[-1] < "\u0250":
                joined.append((w, base, words[base]))
            else:
                plain.append(w)
        plain += words.new
        words.new = []
        for i in range(0, len(plain), 4000):
            part = plain[i:i + 4000]
            ids = self.whole(lead + lead.join(part))
            at = np.flatnonzero(starts[ids]) if starts is not None else np.flatnonzero(ids == self.line_end[0])
            if len(at) != len(part):
                raise ValueError("the tokenizer does not start a unit at each white space")
            skip = 0 if starts is not None else 4
            data, cuts = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
            for k, w in enumerate(part):
                self.fill(words, w, data[cuts[k] + skip:cuts[k + 1]])
        for w, base, ids in joined:
            end = w[len(base):]
            if end not in self.ends:
                self.ends[end] = self.whole(end).tobytes()
            self.fill(words, w, bytes(ids) + self.ends[end])

    @staticmethod
    def fill(words: Words, word: str, ids: bytes) -> None:
        box = words[word]
        box += ids
        words[word] = ids


#: One for each tokenizer in a worker process, so that later tasks find the words of earlier ones.
_TOKENS: dict[tuple[str, int], Tokens] = {}


def tokens_of(packing: Packing) -> Tokens:
    key = (packing.tokenizer, packing.cache)
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(*key)
    return _TOKENS[key]


class Packer:
    """Packs the documents of one task. Pieces are (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, packing: Packing, base: int):
        self.p, self.base = packing, base
        self.queues = {t: deque() for t in packing.tiers}
        self.held = dict.fromkeys(packing.tiers, 0)
        self.windows = 0
        self.steps: list[list[int]] = []  # open step groups: id, room
        self.n_steps = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, longest = len(ids) // 4, self.p.tiers[0]
        at = 0
        while n - at >= longest:
            self.emit([(doc_id, at, ids[at * 4:(at + longest) * 4], n)], longest, longest)
            at += longest
        if at < n:
            tier = min(t for t in self.p.tiers if t >= n - at)
            self.queues[tier].append((doc_id, at, ids[at * 4:], n))
            self.held[tier] += n - at
            while self.held[tier] >= tier * self.p.lookahead:
                self.pack(tier)

    def take(self, tier: int) -> tuple:
        piece = self.queues[tier].popleft()
        self.held[tier] -= len(piece[2]) // 4
        return piece

    def cut(self, tier: int, size: int) -> tuple:
        """The first size tokens of the tier's first piece; the rest stays in its place."""
        doc_id, start, ids, n = self.queues[tier][0]
        if len(ids) <= size * 4:
            return self.take(tier)
        self.queues[tier][0] = (doc_id, start + size, ids[size * 4:], n)
        self.held[tier] -= size
        return doc_id, start, ids[:size * 4], n

    def pack(self, tier: int) -> None:
        """One full window of the tier, which holds that many tokens."""
        room, pieces = tier, []
        while self.queues[tier] and len(self.queues[tier][0][2]) <= room * 4:
            pieces.append(self.take(tier))
            room -= len(pieces[-1][2]) // 4
        for shorter in (t for t in self.p.tiers if t < tier):
            while room and self.queues[shorter] and len(self.queues[shorter][0][2]) <= room * 4:
                pieces.append(self.take(shorter))
                room -= len(pieces[-1][2]) // 4
        while room:
            pieces.append(self.cut(tier, room))
            room -= len(pieces[-1][2]) // 4
        self.emit(pieces, tier, tier)

    def flush(self) -> None:
        for tier in self.p.tiers:
            while self.held[tier] >= tier:
                self.pack(tier)
        rest = [x for t in self.p.tiers for x in self.queues[t]]
        total = sum(len(x[2]) for x in rest) // 4
        last = self.p.tiers[0]
        self.queues[last], self.held[last] = deque(rest), total
        while total:
            size = min(last, 1 << (total.bit_length() - 1))
            room, pieces = size, []
            while room:
                pieces.append(self.cut(last, room))
                room -= len(pieces[-1][2]) // 4
            self.emit(pieces, size, size)
            total -= size

    def step(self, size: int) -> int:
        for s in self.steps:
            if s[1] >= size:
                break
        else:
            s = [self.base + self.n_steps, self.p.step_tokens]
            self.n_steps += 1
            self.steps.append(s)
        s[1] -= size
        if not s[1]:
            self.steps.remove(s)
        return s[0]

    def emit(self, pieces: list[tuple], size: int, tier: int) -> None:
        sequence, step, offset = self.base + self.windows, self.step(size), 0
        self.windows += 1
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, n, sequence, offset, size, tier, step))
            offset += len(ids) // 4

    def drain(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(docs: DataFrame, packing: Packing) -> DataFrame:
    """docs: doc_id, text. One row for each piece of a document; ids are little-endian 32-bit numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        *[(c, pa.int64()) for c in ("doc_tokens", "sequence_id", "offset", "sequence_length", "tier", "step_id")]])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(packing, TaskContext.get().partitionId() << 33)
        tokens = tokens_of(packing)
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.batch(part.column(1).to_pylist())):
                    packer.add(doc_id, ids + end)
                if len(packer.rows) > 1000:
                    yield packer.drain(schema)
        packer.flush()
        if packer.rows:
            yield packer.drain(schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
