"""Self-join of documents whose five-word shingle sets have a Jaccard similarity of 0.75 or more.

Candidates must share a prefix token under each of three global token orders: rarity (document
frequency, ties by hash) and two hash orders. The rarity order finds the pairs, the other two thin
them before any set is moved, and exact set intersection decides. How it scales:

* Documents are shingled once, in blocks. A block sends each bucket of the hash space its tokens,
  packed as bytes; tokens that are frequent in the block go as one count, so no bucket receives a
  frequent token more than once from a block. Tokens that occur in one document only cannot be
  shared: they fill the front of the rarity prefix unseen, and most documents need no more than that.
* Equal sets are one class, whatever their number.
* A posting (class, prefix token) knows the largest partner that the token's place in the rarity
  order allows: the overlap cannot exceed what follows it. Both sides have to allow each other.
* In a list of classes that share a prefix token, pairs are not enumerated. In each round the list
  has one pivot, each class is compared with the pivots it shares most tokens with, and classes that
  are linked get one label. Lists of one label are closed, and so are postings without a possible
  partner; only open ones are kept for the next round, with the sets of their classes. When few pairs are
  open after a round (Params.open_per_token), when a round joins nothing, or after Params.max_rounds, the
  open pairs are all compared. No pair that could join two components is left out.
* The last two cases leave lists of any length, such as those of a corpus made of common passages. There
  postings carry a signature of their set (see signatures), and a pair whose signatures differ by more
  than similar sets can is dropped where it is met, before it is written or shuffled. So what is written
  follows the pairs that are nearly similar; looking at signatures still takes the square of a list's
  length, in an equality join that is split by token and, if skewed, by Spark. Signatures tell sets of up
  to some 1,700 shingles apart; pairs of longer ones go on to the next filters.
* Labels are joined by alternating large-star and small-star steps on the graph of labels.

Nulls: a null or empty text, and one without words, has an empty set and is linked with nothing; a
null doc_id takes part, and is a component's id only if it has no other. Rows are documents of their
own, so repeated rows are linked. Fewer than five words are one shingle. An empty table gives an
empty result. A text of any length is one set; a block holds BLOCK_BYTES of text or one longer text.
Columns other than doc_id and text do not come along in components(); one_of_each() keeps them all,
whatever their names. Sets are counted and told apart by 64-bit hashes of shingles, and compared by
the first 48 bits of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, drop_tables, key128, materialise, release, slices, text_or_empty

SHINGLE = 5
#: Similar: PERCENT of the union or more is shared.
PERCENT = 75
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
ORDERS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
MARK = 0xFFFF
#: What of a token is sent and compared.
KEPT_BITS = np.uint64(0xFFFFFFFFFFFF0000)
BLOCK_BYTES = 1 << 23
#: 64-bit words of a signature.
SIGNATURE = 16


@dataclass(frozen=True)
class Params:
    block_docs: int = 1024
    #: Tokens of at least so many documents of a block are sent as one count.
    frequent: int = 64
    max_rounds: int = 6
    #: In a round a class is compared with the pivots that it shares most tokens with, so many at most; the rest stay open.
    pivots: int = 4
    #: After the first round, open pairs are enumerated when there are at most so many for each posting of that round (a pair
    #: counts for each token that it shares).
    open_per_token: float = 4.0


class Words(dict):
    """Word hashes, kept for the words that come back."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: A worker process keeps its words from task to task.
_WORDS = Words()


def kept_words() -> Words:
    return _WORDS


def shingle_set(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    w = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    n = len(w)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=1)] if w else [], np.uint64)
    a = np.fromiter(map(words.__getitem__, w), np.uint64, n)
    h = a[:n - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h *= MULTIPLY
        h += a[k:n - SHINGLE + 1 + k]
    h ^= h >> np.uint64(31)
    h *= MULTIPLY
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def prefix_size(n):
    """How many tokens of a set of n a similar set cannot miss all of."""
    return n - (n * PERCENT + 99) // 100 + 1


def planes(a: np.ndarray) -> bytes:
    """The bytes of sorted numbers by place, which compress where neighbours agree."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def small(a: np.ndarray) -> bytes:
    """Numbers by place, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def unsmall(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


PACKED = pa.schema([("route", pa.int64()), ("kind", pa.string()), ("block", pa.int64()),
                    ("tokens", pa.binary()), ("docs", pa.binary()), ("extra", pa.binary())])
PACKED_SQL = "route long, kind string, block long, tokens binary, docs binary, extra binary"


def shingle_blocks(docs: DataFrame, buckets: int, params: Params) -> DataFrame:
    """docs: doc_id, k1, k2, text. Rows by kind: tokens for a bucket (T), a block's frequent tokens (H), its documents (M)."""

    def block_rows(ids: list, keys: list, texts: list, block: int, words: Words) -> Iterator[tuple]:
        sets = [shingle_set(t, words) for t in texts]
        n = np.array([len(s) for s in sets], np.int64)
        meta = np.zeros((len(sets), 8), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                p, t = prefix_size(len(s)), s & KEPT_BITS
                meta[i, 4:6] = [np.partition(t * o, p - 1)[p - 1] for o in ORDERS]
                x = s * ORDERS[0]
                meta[i, 2:4] = s.sum(), np.bitwise_xor.reduce(x ^ (x >> np.uint64(33)))
        meta[:, 0] = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
        meta[:, 1] = n
        meta[:, 6:] = np.array(keys, np.int64).reshape(-1, 2).view(np.uint64)
        null = np.array([i is None for i in ids], np.uint8)
        home = block % buckets
        yield home, "M", block, meta.tobytes(), null.tobytes(), b""
        tokens = np.concatenate(sets) & KEPT_BITS
        if not len(tokens):
            return
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(starts, len(tokens)))
        often = counts >= params.frequent
        if often.any():
            mine = np.repeat(often, counts)
            yield home, "H", block, planes(tokens[mine]), small(owner[mine]), b""
            first = np.zeros(len(tokens), bool)
            first[starts] = True
            keep = ~mine | first
            owner = np.where(mine, np.uint16(MARK), owner)[keep]
            tokens = tokens[keep]
            weights = counts[often].astype(np.uint32)
        else:
            weights = np.empty(0, np.uint32)
        bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        marks = np.concatenate([[0], np.cumsum(owner == MARK)])
        for b in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[b], cuts[b + 1]
            yield int(b), "T", block, planes(tokens[i:j]), small(owner[i:j]), weights[marks[i]:marks[j]].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = kept_words(), TaskContext.get().partitionId() << 32
        held: list[list] = [[], [], [], []]
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, size
            ids, k1, k2, texts = held
            rows = list(zip(*block_rows(ids, list(zip(k1, k2)), texts, block, words)))
            block, held, size = block + 1, [[], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, PACKED)], schema=PACKED)

        for batch in batches:
            for part in slices(batch, 3, BLOCK_BYTES, params.block_docs):
                if held[0] and (size + part.nbytes > BLOCK_BYTES or len(held[0]) + part.num_rows > params.block_docs):
                    yield from emit()
                for column, values in zip(held, part.columns):
                    column.extend(values.to_pylist())
                size += part.nbytes
        if held[0]:
            yield from emit()

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, PACKED_SQL)


def count_bucket(table: pa.Table) -> pa.Table:
    """Replaces a bucket's tokens by those of two or more documents, with their document frequencies (R)."""
    own = table.filter(pc.equal(table["kind"], "T"))
    rest = table.filter(pc.not_equal(table["kind"], "T"))
    if not own.num_rows:
        return rest
    rows = [(unplanes(t.as_py()), unsmall(d.as_py(), np.uint16), np.frombuffer(e.as_py(), np.uint32))
            for t, d, e in zip(own["tokens"], own["docs"], own["extra"])]
    tokens = np.concatenate([r[0] for r in rows])
    owner = np.concatenate([r[1] for r in rows])
    part = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weight = np.ones(len(tokens), np.int64)
    weight[owner == MARK] = np.concatenate([r[2] for r in rows])
    order = np.argsort(tokens, kind="stable")
    sorted_tokens = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]]))
    total = np.add.reduceat(weight[order], starts)
    df = np.empty(len(tokens), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(starts, len(tokens))))
    keep = df > 1
    tokens, owner, part, df = tokens[keep], owner[keep], part[keep], np.minimum(df[keep], 2**32 - 1).astype(np.uint32)
    cuts = np.searchsorted(part, np.arange(len(rows) + 1))
    block = own["block"].to_pylist()
    out = [(0, "R", block[i], planes(tokens[a:b]), small(owner[a:b]), small(df[a:b]))
           for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    if not out:
        return rest
    found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PACKED)], schema=PACKED)
    return pa.concat_tables([rest.cast(PACKED), found])


PROFILE = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("key", pa.binary()),
                     ("shared", pa.list_(pa.int64())), ("p1", pa.int32()), ("p2", pa.list_(pa.int32())), ("p3", pa.list_(pa.int32()))])
PROFILE_SQL = ("doc_id long, k1 long, k2 long, n long, key binary, shared array<long>, p1 int, "
               "p2 array<int>, p3 array<int>")


def profile_block(table: pa.Table) -> pa.Table:
    """A block's documents: n, key (of the set), and for those that can be similar to another their shared
    tokens by rarity, of which the first p1 are the rarity prefix, and the first 32 bits of the other two prefixes'
    shared tokens."""
    kinds = np.array(table["kind"].to_pylist())
    get = lambda c, k: [table[c][int(i)].as_py() for i in np.flatnonzero(kinds == k)]
    meta = np.frombuffer(get("tokens", "M")[0], np.uint64).reshape(-1, 8)
    null = np.frombuffer(get("docs", "M")[0], np.uint8).astype(bool)
    n = meta[:, 1].astype(np.int64)
    none = (np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.uint32))
    rows = [none] + [(unplanes(t), unsmall(d, np.uint16), unsmall(e, np.uint32))
                     for t, d, e in zip(get("tokens", "R"), get("docs", "R"), get("extra", "R"))]
    tokens, owner, df = (np.concatenate(x) for x in zip(*rows))
    marked = owner == MARK
    if marked.any():
        order = np.argsort(tokens[marked])
        known, known_df = tokens[marked][order], df[marked][order]
        hot = [unplanes(t) for t in get("tokens", "H")]
        hot_docs = [unsmall(d, np.uint16) for d in get("docs", "H")]
        h = np.concatenate(hot)
        tokens = np.concatenate([tokens[~marked], h])
        owner = np.concatenate([owner[~marked], *hot_docs])
        df = np.concatenate([df[~marked], known_df[np.searchsorted(known, h)]])
    own = np.bincount(owner, minlength=len(n))[:len(n)]
    room = prefix_size(n) - (n - own)  # places of the rarity prefix that shared tokens take
    can = (room > 0) & (n > 0)
    keep = can[owner] if len(owner) else np.empty(0, bool)
    tokens, owner, df = tokens[keep], owner[keep], df[keep]
    order = np.lexsort((tokens, df, owner))
    tokens, owner = tokens[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(n) + 1))
    lists: list[list] = [[], [], []]
    for i in range(len(n)):
        t = tokens[cuts[i]:cuts[i + 1]] if can[i] else None
        lists[0].append(None if t is None else t.view(np.int64))
        for k, o in enumerate(ORDERS):
            lists[k + 1].append(None if t is None else (t[t * o <= meta[i, 4 + k]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
    key = [k.tobytes() for k in np.ascontiguousarray(meta[:, 1:4])]
    column = lambda j: meta[:, j].view(np.int64) if meta[:, j].flags.c_contiguous else np.ascontiguousarray(meta[:, j]).view(np.int64)
    return pa.Table.from_arrays([
        pa.array(column(0), mask=null), pa.array(column(6)), pa.array(column(7)), pa.array(n), pa.array(key, pa.binary()),
        pa.array(lists[0], pa.list_(pa.int64())), pa.array(np.maximum(room, 0).astype(np.int32)),
        pa.array(lists[1], pa.list_(pa.int32())), pa.array(lists[2], pa.list_(pa.int32()))], schema=PROFILE)


def profiles(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row for each row of docs (doc_id, text); see profile_block."""
    buckets = buckets_for(docs, 1 << 24)
    k1, k2 = key128(text_or_empty("text"))
    rows = shingle_blocks(docs.select(F.col("doc_id").cast("long"), k1.alias("k1"), k2.alias("k2"), "text"), buckets, params)
    counted = rows.repartition(buckets, "route").groupBy("route").applyInArrow(count_bucket, PACKED_SQL)
    return counted.repartition(buckets, "block").groupBy("block").applyInArrow(profile_block, PROFILE_SQL)


def similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, those that share prefix tokens under the other orders too, and are similar.

    The two filters come first, on the prefixes alone; sets are moved for what is left.
    """
    side = lambda s, *c: classes.select(F.col("id").alias(s), F.struct(*c).alias(f"{s}_"))
    both = pairs.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b")
    both = both.filter(F.arrays_overlap("a_.p2", "b_.p2") & F.arrays_overlap("a_.p3", "b_.p3")).select("a", "b")
    both = both.join(side("a", "n", "shared"), "a").join(side("b", "n", "shared"), "b")
    common = F.size(F.array_intersect("a_.shared", "b_.shared"))
    return (both.select("a", "b", common.alias("i"), (F.col("a_.n") + F.col("b_.n")).alias("n"))
            .filter(100 * F.col("i") >= PERCENT * (F.col("n") - F.col("i"))).select("a", "b"))


def allowed(n: str, most: str, other_n: str, other_most: str):
    """Whether two postings of a token allow each other: sizes that similar sets can have, and the token not too late in either."""
    n, most, other_n, other_most = map(F.col, (n, most, other_n, other_most))
    return ((n * 100 >= other_n * PERCENT) & (other_n * 100 >= n * PERCENT) & (other_n <= most) & (n <= other_most))


def signatures(classes: DataFrame) -> DataFrame:
    """id, rest, s0, s1, ...: parities of how many shared tokens fall in each of 64 * SIGNATURE groups, by hash.

    Two sets differ in at least as many tokens as their signatures in bits, and in the rest as well: the number of
    their tokens that no other document has.
    """
    schema = ", ".join(["id long", "rest long", *(f"s{k} long" for k in range(SIGNATURE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, lists = batch.columns
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            group = tokens >> np.uint64(16)  # the lowest bits are not kept
            sums = np.zeros((batch.num_rows, SIGNATURE), np.uint64)
            np.bitwise_xor.at(sums, (np.repeat(np.arange(batch.num_rows), size), (group >> np.uint64(6)) % np.uint64(SIGNATURE)),
                              np.uint64(1) << (group & np.uint64(63)))
            columns = [ids, pa.array(n.to_numpy() - size), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in sums.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "rest", *(f"s{k}" for k in range(SIGNATURE))])

    return classes.select("id", "n", "shared").mapInArrow(run, schema)


def open_pairs(postings: DataFrame, signed: bool) -> DataFrame:
    """a, b: pairs of a class outside the label of its list's pivot with any class of another label in the list.

    signed: postings have signatures, and pairs that differ too much by them are left out.
    """
    facts = ["id", "n", "most", "label", *(["rest", *(f"s{k}" for k in range(SIGNATURE))] if signed else [])]
    side = lambda df, s: df.select("token", *(F.col(c).alias(f"{s}_{c}") for c in facts))
    both = side(postings.filter("label <> pivot.label"), "a").join(side(postings, "b"), "token")
    both = both.filter((F.col("a_label") != F.col("b_label")) & allowed("a_n", "a_most", "b_n", "b_most"))
    if signed:
        apart = F.col("a_rest") + F.col("b_rest")
        for k in range(SIGNATURE):
            apart = apart + F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}")))
        # of N = n + n tokens similar sets share 2 * PERCENT * N / (100 + PERCENT) or more
        both = both.filter((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("a_n") + F.col("b_n")))
    return both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """x, y: each node of the graph of edges (x, y), x <> y, that is not its component's least, with the least.

    Large-star and small-star steps in turn, until every component is a star. Minima are taken where edges are
    read, so a node of many edges is not gathered.
    """
    down = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    spent = None
    while True:
        down = materialise(down, "stars")
        drop_tables(spent)
        spent = down
        open_ = down.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1").limit(1)
        if open_.isEmpty() and down.join(down.select(F.col("x").alias("y")), "y", "left_semi").limit(1).isEmpty():
            return down
        both = down.unionByName(down.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = materialise(large, "stars")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        down = (large.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
                .unionByName(least.select("x", F.col("m").alias("y"))).distinct())


def merge(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """labels (id, label) after all links (a, b); whether any joined two labels."""
    of = lambda s: labels.select(F.col("id").alias(s), F.col("label").alias(f"{s}_label"))
    cross = (links.join(of("a"), "a").join(of("b"), "b").filter("a_label <> b_label")
             .select(F.col("a_label").alias("x"), F.col("b_label").alias("y")))
    cross = materialise(cross, "label-links")
    if cross.isEmpty():
        return labels, False
    down = stars(cross)
    new = (labels.join(down.select(F.col("x").alias("label"), "y"), "label", "left")
           .select("id", F.coalesce("y", "label").alias("label")))
    new = materialise(new, "labels")
    drop_tables(labels, cross, down)
    return new, True


def linked_classes(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """key, label: of the classes (distinct sets) that are linked with others; those of one component have one label.

    rows: what profiles() returns, stored.
    """
    spark = rows.sparkSession
    profile = rows.filter("shared is not null").select("key", "n", "shared", "p1", "p2", "p3")
    classes = materialise(profile.dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()), "shingle-classes")
    # the token at place i of s shared ones leaves an overlap of s - i + 1 at most, and so bounds the partner's size
    most = F.floor((F.size("shared") - F.col("i")) * F.lit(100 + PERCENT) / PERCENT).cast("long") - F.col("n")
    open_ = (classes.select("id", "n", "shared", F.posexplode(F.slice("shared", F.lit(1), F.col("p1"))).alias("i", "token"))
             .select("id", "n", "token", most.alias("most"), F.col("id").alias("label")))
    labels = materialise(classes.select("id", F.col("id").alias("label")), "labels")
    release(spark)
    n_open, moved, sets = None, True, classes
    for turn in range(params.max_rounds + 1):
        # at first the class that allows the largest partners, next to which the others have changed most; then any
        score = F.col("most") - F.col("n") if turn == 0 else F.lit(0)
        lists = open_.groupBy("token").agg(
            F.count("*").alias("c"), F.min("n").alias("least_n"), F.max("most").alias("largest"),
            F.max(F.struct(score.alias("score"), F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "most", "label")).alias("pivot"),
            (F.min("label") < F.max("label")).alias("open")).filter("open and c > 1").drop("open")
        now = (open_.join(lists, "token").filter("most >= least_n and n <= largest")
               .select("token", "id", "n", "most", "label", "c", "pivot"))
        now = materialise(now, "open-lists")
        drop_tables(open_)
        facts = now.agg(F.count("*").alias("postings"), F.sum(F.when(F.col("label") != F.col("pivot.label"), F.col("c"))).alias("pairs")).first()
        if not facts["pairs"]:
            break
        n_open = n_open or facts["postings"]
        # a round comes first, so that tables of all sizes take the same steps
        few = turn > 0 and facts["pairs"] <= params.open_per_token * n_open
        if turn == 1:  # what the first round leaves open is little as a rule; later ones read and move the sets of that alone
            ids = materialise(now.select(F.explode(F.array("id", "pivot.id")).alias("id")).distinct(), "open-ids")
            sets = materialise(classes.join(ids, "id", "left_semi"), "open-classes")
            drop_tables(ids)
        last = few or turn == params.max_rounds or not moved
        if last:
            postings = now if few else materialise(now.join(signatures(sets), "id"), "open-signed")
            pairs = materialise(open_pairs(postings, not few), "open-pairs")
            drop_tables(*[postings] * (not few))
        else:
            best = (now.filter((F.col("label") != F.col("pivot.label")) & allowed("n", "most", "pivot.n", "pivot.most"))
                    .groupBy("id", F.col("pivot.id").alias("b")).agg(F.count("*").alias("c")))
            # a class has no more pivots than prefix tokens, so this list is bounded
            most_shared = F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), asc=False), 1, params.pivots)
            pairs = (best.groupBy("id").agg(most_shared.alias("m")).select(F.col("id").alias("a"), F.explode("m").alias("m"))
                     .select("a", F.col("m.b").alias("b")))
        links = materialise(similar(pairs, sets), "links")
        labels, moved = merge(labels, links)
        drop_tables(links, *[pairs] * last)
        if last:
            break
        # written, as the lists and their postings are both made of it
        open_ = materialise(now.drop("label", "c", "pivot").join(labels, "id"), "open-postings")
        drop_tables(now)
    found = materialise(classes.select("id", "key").join(labels, "id").select("key", "label"), "class-labels")
    drop_tables(now, classes, sets, labels)
    return found


def components(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, k1, k2 (128-bit key of the text), n_shingles, component_id: one row for each row of docs."""
    rows = materialise(profiles(docs.select("doc_id", "text"), params), "shingle-profiles")
    release(rows.sparkSession)
    labels = linked_classes(rows, params)
    full = rows.filter("n > 0").select("doc_id", "k1", "k2", "n", "key")
    ids = materialise(full.groupBy("key").agg(F.min("doc_id").alias("least")).join(labels, "key", "left"), "class-ids")
    named = ids.filter("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
    found = ids.join(named, "label", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    none = rows.filter("n = 0").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(found, "key").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id").unionByName(none)


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents, with one of each component: that with the smallest doc_id, nulls last, then by the text's key.

    Of rows with that doc_id and text the least is kept. Components count by their label, so documents that are
    similar to nothing stay whatever their doc_id, and so do those without words. Columns stay as they are.
    """
    rows = materialise(profiles(docs.select("doc_id", "text"), params), "shingle-profiles")
    release(rows.sparkSession)
    labels = linked_classes(rows, params)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    full = rows.filter("n > 0").select("key", place.alias("place"))
    classes = full.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("c")).join(labels, "key", "left")
    classes = materialise(classes, "class-ids")
    several = classes.filter("label is not null").groupBy("label").agg(F.min("first").alias("kept"))
    groups = classes.join(several, "label", "left").select("key", F.coalesce("kept", "first").alias("kept"), "label", "c")
    members = full.join(groups.filter("c > 1 or label is not null").select("key", "kept"), "key")
    members = materialise(members.select("place.doc_id", "place.k1", "place.k2", (F.col("place") == F.col("kept")).alias("stays")), "components")
    gone = materialise(members.filter("not stays").select("doc_id", "k1", "k2").distinct(), "duplicates")
    twice = members.filter("stays").groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    twice = materialise(twice, "repeated-rows")
    k1, k2 = key128(text_or_empty("row.text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k1"] == b["k1"]) & (a["k2"] == b["k2"])
    rest = rows.join(gone, same(rows, gone), "left_anti")
    if not twice.isEmpty():  # rows that repeat the kept doc_id and text
        again = rest.join(twice, same(rest, twice), "left_semi")
        once = again.groupBy("doc_id", "k1", "k2").agg(F.min("row").alias("row"))
        rest = rest.join(twice, same(rest, twice), "left_anti").select("row").unionByName(once.select("row"))
    return rest.select("row.*")
