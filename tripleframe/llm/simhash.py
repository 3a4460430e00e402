"""SimHash near-dedup: 128-bit signatures, self-joined along binary tries."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import SLICE_BYTES, apart, column, hash64, like, mix, partitions, pick, private, slices, words, written
from tripleframe.runtime import cut

BITS, WORDS = 128, 2
BUDGET = 15
#: rows of a trie node that is not taken apart further
LEAF = 160
STEP = 1 << 15
#: rows that subtrees have on average before another error-free block is asked for
ROOMY = 1 << 12
#: rows of one subtree in a task; a larger one is joined in cells
HOT = 1 << 16
TASK_ROWS = 1 << 20
SMALL = 1 << 18
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SIGNED = "doc_id long, s0 long, s1 long"
SEED = 0x5EED
#: one for each bit
KEYS = mix(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(SEED)).astype(np.uint32)


def feature(word: str) -> str:
    """A token without outer punctuation, in lower case; a token of punctuation alone is its own feature."""
    return word.strip(PUNCTUATION).lower() or word


def projection(low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """What each feature adds to the bit's sum: a sign, times a number u**-3 for u uniform in (0, 1)."""
    x = low ^ KEYS[bit]
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x ^= high
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    u = (x >> np.uint32(8)).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2**-24)
    out = u * u
    out *= u
    np.divide(np.float32(1), out, out=out)
    out.view(np.uint32)[:] |= x << np.uint32(31)  # the sign
    return out


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of the distinct features of each text, and how many it has."""
    at, distinct, code = words(texts)
    size = np.diff(at)
    ids = hash64([feature(w) for w in distinct])
    known, number = np.unique(ids, return_inverse=True)
    # each document's distinct features, in the order of their hashes: equal sets have equal sums
    pair = np.repeat(np.arange(len(size), dtype=np.int64), size) * max(len(known), 1) + number[code]
    pair.sort()
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
    doc, number = pair // max(len(known), 1), pair % max(len(known), 1)
    size = np.bincount(doc, minlength=len(size))
    bits = np.zeros((len(size), BITS), bool)
    some = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[some]
    low, high = known.astype(np.uint32), (known >> np.uint64(32)).astype(np.uint32)
    for bit in range(BITS if len(some) else 0):
        bits[some, bit] = np.add.reduceat(projection(low, high, bit)[number], first) > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), size


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES // 2):
            sign, size = signatures(part.column("text"))
            some = pa.array(size > 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(some), *[pa.array(sign[size > 0, k].view(np.int64)) for k in range(WORDS)]], ["doc_id", "s0", "s1"])


def plan(n: int, budget: int) -> int:
    """How many error-free blocks the subtrees of n signatures' tries have: cost alone, the pairs are the same."""
    free = 1
    while free < 4 and (n >> (free * BITS // (budget + free))) > ROOMY and budget + free < BITS:
        free += 1
    return free


@cache
def tries(budget: int, free: int) -> list[tuple[int, np.ndarray]]:
    """For each trie: how many levels allow no error, and its order of the bits, those levels' first.

    Of budget + free blocks of bits, two signatures within the budget differ in at most `budget`, so at least `free`
    blocks are equal: for every choice of `free` blocks there is a trie that begins with them.
    """
    if not 0 <= budget <= BITS - free:
        raise ValueError(f"the budget must be from 0 to {BITS - free}")
    bounds = np.arange(budget + free + 1) * BITS // (budget + free)
    blocks = [np.arange(a, b) for a, b in zip(bounds, bounds[1:])]
    out = []
    for chosen in itertools.combinations(range(len(blocks)), free):
        head = np.concatenate([blocks[i] for i in chosen])
        out.append((len(head), np.concatenate([head, np.setdiff1d(np.arange(BITS), head)])))
    return out


def heads(sign: np.ndarray, budget: int, free: int) -> Iterator[np.ndarray]:
    """For each trie, the number of the subtree that each signature is in: the trie's and its error-free bits."""
    bits = np.unpackbits(sign.view(np.uint8).reshape(len(sign), -1), axis=1, bitorder="little")
    for t, (depth, order) in enumerate(tries(budget, free)):
        head = bits[:, order[:depth]].astype(np.uint64) @ (np.uint64(1) << np.arange(depth, dtype=np.uint64))
        yield (head | np.uint64(t) << np.uint64(44)).view(np.int64)


def _signs(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(f"s{k}").to_numpy() for k in range(WORDS)], 1)


def _subtrees(budget: int, free: int):
    """Each signature once for each trie, keyed by its subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                for key in heads(_signs(part), budget, free):
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column("doc_id"), part.column("s0"), part.column("s1")], ["key", "doc_id", "s0", "s1"])

    return run


def _sizes(budget: int, free: int):
    """How many signatures of a batch each subtree has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in heads(_signs(batch), budget, free):
                own, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["key", "n"])

    return run


def trie_pairs(words_: np.ndarray, cuts: np.ndarray, depth: int, budget: int, top: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs within `budget` differing bits, in each of the forest's subtrees.

    `words_`: signatures in the trie's order of bits, highest first, each subtree's sorted; subtree i is rows cuts[i] to
    cuts[i + 1], its root at level `depth`. A node is a run of rows and a level. Node pairs go down one level at a time:
    the four pairs of their children, each with the differing bits so far, those over budget dropped. Pairs of nodes
    with LEAF rows or fewer are finished by counting all bits.

    With `top`, the rows' components so far (which the caller updates), node pairs inside one component are dropped.
    """
    some = np.diff(cuts) > 1
    lo, hi = cuts[:-1][some], cuts[1:][some]
    todo = [(lo, hi, lo, hi, depth, np.zeros(len(lo), np.int64))] if len(lo) else []
    while todo:
        a0, a1, b0, b1, level, off = todo.pop()
        if len(a0) > STEP:
            todo += [(*(x[i : i + STEP] for x in (a0, a1, b0, b1)), level, off[i : i + STEP]) for i in range(0, len(a0), STEP)]
            continue
        if top is not None:
            new = np.cumsum(top[1:] != top[:-1])
            new = np.concatenate([[0], new])
            one = (new[a0] == new[a1 - 1]) & (new[b0] == new[b1 - 1]) & (top[a0] == top[b0])
            a0, a1, b0, b1, off = (x[~one] for x in (a0, a1, b0, b1, off))
        leaf = (a1 - a0 <= LEAF) & (b1 - b0 <= LEAF) if level < BITS else np.ones(len(a0), bool)
        yield from _leaves(words_, *(x[leaf] for x in (a0, a1, b0, b1)), budget)
        a0, a1, b0, b1, off = (x[~leaf] for x in (a0, a1, b0, b1, off))
        if not len(a0):
            continue
        word, shift = divmod(level, 64)
        ones = np.concatenate([[0], np.cumsum((words_[:, word] >> np.uint64(63 - shift)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        down = []
        for x0, x1, y0, y1, more, which in (
            (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same), (a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None),
        ):
            alive = (x1 > x0) & (y1 > y0) & (off + more <= budget)
            alive &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 < 2))
            alive = alive if which is None else alive & which
            down.append((x0[alive], x1[alive], y0[alive], y1[alive], off[alive] + more))
        a0, a1, b0, b1, off = (np.concatenate(x) for x in zip(*down))
        if len(a0):
            todo.append((a0, a1, b0, b1, level + 1, off))


def _leaves(words_: np.ndarray, a0, a1, b0, b1, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    w = [np.ascontiguousarray(words_[:, k]) for k in range(WORDS)]
    found, held = [], 0
    for p, q, r, s in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()):
        d = np.bitwise_count(w[0][p:q, None] ^ w[0][None, r:s])
        for x in w[1:]:
            d += np.bitwise_count(x[p:q, None] ^ x[None, r:s])
        i, j = np.nonzero(d <= budget)
        if len(i) > (q - p) * (p == r):  # a node with itself has its diagonal
            ok = i + p < j + r
            i, j = i[ok], j[ok]
            found.append((i + p, j + r, d[i, j].astype(np.int64)))
            held += len(i)
            if held > STEP:
                yield tuple(np.concatenate(x) for x in zip(*found))
                found, held = [], 0
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found))


def connect(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`top`, each node's least node of its component so far, with the edges a-b added; it is changed in place."""
    while True:
        x, y = top[a], top[b]
        differ = x != y
        if not differ.any():
            return top
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top[:] = top[top]


def _join(budget: int, free: int, forest: bool):
    """Edges of the subtrees in a partition: all pairs with their distance, or of each component a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key, cell, ids = (table.column(c).to_numpy() for c in ("key", "cell", "doc_id"))
        packed, trie = _signs(table), key >> 44
        for t in np.unique(trie).tolist():
            own = np.flatnonzero(trie == t)
            own = own[np.lexsort((cell[own], key[own]))]
            new = (key[own][1:] != key[own][:-1]) | (cell[own][1:] != cell[own][:-1])
            group = np.concatenate([[0], np.cumsum(new)])
            ok = np.bincount(group)[group] > 1  # a subtree of one signature has no pair
            own, group = own[ok], group[ok]
            if not len(own):
                continue
            depth, order = tries(budget, free)[t]
            bits = np.unpackbits(packed[own].view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")[:, order]
            words_ = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").astype(np.uint64)
            sort = np.lexsort((*words_.T[::-1], group))
            own, group, words_ = own[sort], group[sort], words_[sort]
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            if forest:
                top = np.arange(len(own))
                for a, b, _ in trie_pairs(words_, cuts, depth, budget, top):
                    connect(top, a, b)
                b = np.flatnonzero(top != np.arange(len(own)))
                pairs = [(top[b], b, np.zeros(len(b), np.int64))]
            else:
                pairs = trie_pairs(words_, cuts, depth, budget)
            for a, b, d in pairs:
                x, y = ids[own[a]], ids[own[b]]
                ok = x != y
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[ok]), pa.array(np.maximum(x, y)[ok]), pa.array(d[ok].astype(np.int32))], ["a", "b", "bits"])

    return run


def _edges(distinct: DataFrame, budget: int, forest: bool, hot: int | None = None, free: int | None = None) -> DataFrame:
    n = distinct.count()
    free, hot = free or plan(n, budget), hot or HOT
    source = distinct.select("doc_id", "s0", "s1")
    rows = source.mapInArrow(_subtrees(budget, free), f"key long, {SIGNED}")
    large = written(source.mapInArrow(_sizes(budget, free), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot), "hot")
    many = large.count()
    if many:
        # chunks of a large subtree meet in pairs, each pair in a cell; a row is in one cell for each other chunk
        parts = F.ceil(F.col("n") / (hot // 2 or 1)).cast("int")
        rows = rows.join(F.broadcast(large) if many <= SMALL else large, "key", "left").withColumn("parts", parts)
        own = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own"))
        cells = F.transform(others, lambda j: F.least(j, F.col("own")).cast("long") * F.lit(1 << 31) + F.greatest(j, F.col("own")))
        rows = rows.withColumn("own", own).withColumn("cell", F.explode(F.when(F.col("parts") > 1, cells).otherwise(F.array(F.lit(-1).cast("long"))))).select("key", "cell", "doc_id", "s0", "s1")
    else:
        rows = rows.withColumn("cell", F.lit(-1).cast("long"))
    tasks = max(partitions(distinct.sparkSession), n * len(tries(budget, free)) // TASK_ROWS)
    return rows.repartition(tasks, "key", "cell").mapInArrow(_join(budget, free, forest), "a long, b long, bits int").distinct()


def signed(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").where("doc_id is not null and text is not null").mapInArrow(_sign, SIGNED)


def near_pairs(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b, bits): all pairs of documents, a < b, with different signatures of which at most `budget` bits differ.

    Of documents with equal signatures the one with the least doc_id stands for all. See near_duplicates.
    """
    same = signed(docs).groupBy("s0", "s1").agg(F.min("doc_id").alias("doc_id"))
    return _edges(written(same, "signatures"), budget, False)


def components(edges: DataFrame) -> DataFrame:
    """(node, top): the least node of each node's component, for nodes with an edge."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("top")).select(F.col("a").alias("node"), "top"))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("top").alias("least"))
        step = label.join(near, F.col("a") == F.col("node")).select("node", "top", F.least("top", "least").alias("next"))
        jump = label.select(F.col("node").alias("n2"), F.col("top").alias("t2"))
        step = step.join(jump, F.col("next") == F.col("n2"), "left").select("node", "top", F.least("next", F.coalesce("t2", "next")).alias("next"))
        step = cut(step)
        if step.where("next <> top").isEmpty():
            return step.select("node", "top")
        label = step.select("node", F.col("next").alias("top"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, kept_doc_id): each document that repeats another one, and the one of its group that stays.

    Groups are the connected components of all pairs whose 128-bit SimHash signatures differ in at most `budget` bits;
    the least doc_id stays. Features are the distinct tokens, without outer punctuation and in lower case. A bit is the
    sign of their projection, whose numbers are heavy-tailed (sign stable projections): the chance that a bit differs
    then follows half the share of features that two texts do not have in common, where with numbers of one size it
    follows that share's root; copies with some words replaced come within a budget that can be joined exactly.

    Equal signatures are one first. The others are joined along binary tries: traverse pairs of nodes together, add up
    differing bits, prune over budget. To distribute it without losing a pair, the bits are cut into more blocks than
    the budget, and each signature is in a trie for every block (or every choice of several, in large tables), which
    allows no error there (see `tries`). The subtrees below are spread over the cluster, and the join in them is exact.
    One with over HOT signatures is joined in cells, each pair of its chunks in one. In subtrees, node pairs of one
    component are skipped; each partition returns a spanning star of what it joined, and the stars are connected.

    Rows without doc_id or without any token take no part. Rows that share a doc_id are one document, whose groups
    join. Texts are signed whole, whatever their length. Other columns are ignored; of two that differ in case only,
    the last counts.
    """
    each = written(signed(docs), "signatures")
    by = ["s0", "s1"]
    first = written(each.groupBy(*by).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")), "distinct")
    differ = _edges(first, budget, True).select("a", "b")
    equal = each.join(first.where("last > doc_id").select(*by, F.col("doc_id").alias("a")), by).where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    return components(differ.union(equal)).where("node <> top").select(F.col("node").alias("doc_id"), F.col("top").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """`docs` without the documents that near_duplicates returns; all columns are kept.

    Rows that repeat a doc_id of a document that stays, stay. Rows without doc_id or token stay.
    """
    own = apart(docs)
    name = private(own, "tf_gone")
    gone = near_duplicates(own, budget).select(F.col("doc_id").alias(name))
    return like(docs, own.join(gone, own[column(own, "doc_id")].cast("long") == gone[name], "left_anti"))
