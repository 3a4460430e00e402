"""Mixing sources to target weights: packed token blocks, multinomial shards, index permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.llm.common import mix, pick, slices, written
from tripleframe.llm.tokencount import split_safely
from tripleframe.llm.vocabulary import FOLDER, TIKTOKEN, encoder, end_of

BLOCK = 2048
SHARD = 1024
SEED = 20240607
#: tokens of a bucket of documents, which are packed together
BUCKET = 1 << 21
#: sources whose bucket counts are sent to all tasks; those of more are joined
SOURCES = 1 << 16
#: shards whose draws are summed together
GROUP = 16
#: the queries' target weights: sources that are not named get OTHERS
TARGETS = {"src0": 4.0, "src1": 3.0, "src2": 2.0}
OTHERS = 1.0
ENCODED = "source string, doc_id long, h long, n long, tokens binary"
FILLED = "shard long, slot int, source string, epoch int, block long, n_tokens int, doc_ids array<long>, tokens binary"


def kind(path: str) -> str:
    """Numbers of two bytes where all tokens and END fit, else of four."""
    return "<u2" if end_of(path) < 1 << 16 else "<u4"


def encode(text: str, path: str) -> np.ndarray:
    """The text's tokens and END."""
    e = encoder(path)
    return np.concatenate([*[e.encode_to_numpy(x, disallowed_special=()).astype(kind(path)) for x in split_safely(text)], np.array([end_of(path)], kind(path))])


def unpack(tokens: bytes, n: int | None = None, path: str = f"{FOLDER}/{TIKTOKEN}") -> list[int]:
    """The first `n` tokens, or all with the padding."""
    return np.frombuffer(tokens, kind(path))[:n].tolist()


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                tokens = [encode(t, path) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("source"), part.column("doc_id"), part.column("h"), pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary()),
                ], ["source", "doc_id", "h", "n", "tokens"])

    return run


def bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "h"), buckets)


class Bucket:
    """The tokens of a bucket's documents, one after another."""

    def __init__(self, tokens: list[bytes], ids: list[int | None], block: int, path: str):
        arrays = [np.frombuffer(t, kind(path)) for t in tokens]
        self.ends, self.ids, self.block = np.cumsum([len(a) for a in arrays]), ids, block
        size = int(self.ends[-1]) if len(arrays) else 0
        self.tokens = np.concatenate([*arrays, np.full(-size % block, end_of(path), kind(path))]) if arrays else np.zeros(0, kind(path))

    def cut(self, k: int) -> tuple[int, list[int], bytes]:
        """Block k: how many tokens it has before padding, its documents, and its tokens, padded with END."""
        a, b = k * self.block, min((k + 1) * self.block, int(self.ends[-1]))
        first, last = np.searchsorted(self.ends, [a, b - 1], "right")
        return b - a, [i for i in self.ids[first : last + 1] if i is not None], self.tokens[a : (k + 1) * self.block].tobytes()


def _fill(block: int, path: str):
    """Partitions are sorted by bucket, a bucket's documents before its slots, so one bucket is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, ids, made = None, [], [], None
        for batch in batches:
            rows, of = batch.column("kind").to_numpy(), list(zip(batch.column("source").to_pylist(), batch.column("bucket").to_pylist()))
            # runs of rows of one bucket and kind
            cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1] or rows[i] != rows[i - 1]), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if of[a] != now:
                    now, tokens, ids, made = of[a], [], [], None
                part = batch.slice(a, b - a)
                if rows[a] == 0:
                    tokens += part.column("tokens").to_pylist()
                    ids += part.column("doc_id").to_pylist()
                    continue
                made = made or Bucket(tokens, ids, block, path)
                for c in range(0, part.num_rows, 1024):
                    own = part.slice(c, 1024)
                    n, docs, data = zip(*map(made.cut, own.column("seq").to_pylist()))
                    yield pa.RecordBatch.from_arrays(
                        [*[own.column(x) for x in ("shard", "slot", "source", "epoch", "block")], pa.array(n, pa.int32()), pa.array(docs, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                        ["shard", "slot", "source", "epoch", "block", "n_tokens", "doc_ids", "tokens"],
                    )

    return run


def permuted(index: np.ndarray, n: np.ndarray | int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at each index: four Feistel rounds over the least even number of bits that
    holds n, walked on until below n."""
    n = np.broadcast_to(np.asarray(n, np.int64), index.shape)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw(shard: int, size: int, weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard: how many blocks of each source, and the order of its slots."""
    g = np.random.Generator(np.random.Philox(key=[seed, shard]))
    return g.multinomial(size, weights), g.permutation(size)


def key_of(seed: int, source: str, epoch: int) -> int:
    """The key of a source's permutation in an epoch."""
    return xxhash.xxh3_64_intdigest(f"{seed} {epoch} {source}")


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, others: float = 0.0, block: int = BLOCK, shard_blocks: int = SHARD, shards: int | None = None, seed: int = SEED,
    vocabulary: str = f"{FOLDER}/{TIKTOKEN}",
) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, doc_ids, tokens): training shards with sources at target weights.

    Each document's tokens, and END after them, are packed into blocks of `block` tokens. A source's documents are in
    buckets of about BUCKET tokens by a hash of doc_id and text, ordered by doc_id and the text's hash, so the blocks
    are the same however the input is split into files and tasks. No token is lost: the last block of a bucket has
    `n_tokens` tokens and is padded with END. Blocks of a source are numbered 0..n-1, bucket after bucket.

    Each shard of `shard_blocks` slots draws how many slots each source gets from a multinomial with the target weights.
    The k-th slot of a source over all shards takes block permutation(k mod n) of epoch k div n, by a permutation of its
    own for each source and epoch, so that an epoch uses every block once. Blocks join by index: the slots go to the
    blocks' buckets, where documents are packed as the slots stream past.

    `weights` are relative, those of sources they don't name are `others`; without weights all sources get the same. A
    negative weight is an error. Default `shards`: as many as hold the number of blocks there are. `tokens` are numbers
    of two bytes, or four for vocabularies of over 65,535, see `unpack`; `doc_ids` those of the block's documents in
    order. The sources are few enough for the driver to hold a number for each.

    A null source is "". Null texts are left out, an empty text is END alone, long texts go on over blocks. Null doc_ids
    are not in doc_ids. Rows given twice are packed twice. Empty tables, or weights of only absent sources, give no rows.
    Other columns are ignored; of two that differ in case only, the last counts.
    """
    if not all(0 <= w < math.inf for w in [others, *(weights or {}).values()]):
        raise ValueError("weights must be numbers from 0 on")
    spark = docs.sparkSession
    source = pick(docs, doc_id="long", text="string", source="string").where("text is not null").na.fill("", ["source"]).withColumn("h", F.xxhash64("text"))
    encoded = written(source.mapInArrow(_encoded(vocabulary), ENCODED), "encoded")
    totals = [tuple(r) for r in encoded.groupBy("source").agg(F.sum("n")).collect()]
    counts = spark.createDataFrame([(s, -(-n // BUCKET)) for s, n in totals], "source string, buckets long")
    inside = encoded.join(F.broadcast(counts) if len(totals) <= SOURCES else counts, "source").withColumn("bucket", bucket(F.col("buckets")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    packed = inside.groupBy("source", "bucket").agg(F.ceil(F.sum("n") / block).cast("long").alias("blocks"))
    packed = written(packed.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))), "buckets")
    sizes = dict(map(tuple, packed.groupBy("source").agg(F.sum("blocks")).collect()))
    target = {s: 1.0 if weights is None else float(weights.get(s, others)) for s in sorted(sizes)}
    names = [s for s, w in target.items() if w > 0]
    share = np.array([target[s] for s in names])
    share = share / share.sum() if len(share) else share
    if shards is None:
        shards = -(-sum(sizes.values()) // shard_blocks)
    if not names:
        shards = 0

    def shards_of(group: int) -> range:
        return range(group * GROUP, min((group + 1) * GROUP, shards))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                many = sum((draw(i, shard_blocks, share, seed)[0] for i in shards_of(g)), np.zeros(len(names), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), g)), pa.array(np.arange(len(names), dtype=np.int32)), pa.array(many)], ["g", "s", "n"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, first in zip(*(batch.column(c).to_pylist() for c in ("g", "first"))):
                used = np.array([x["first"] for x in sorted(first, key=lambda x: x["s"])])
                for shard in shards_of(g):
                    many, order = draw(shard, shard_blocks, share, seed)
                    at = 0
                    for s in np.flatnonzero(many).tolist():
                        n, size = int(many[s]), sizes[names[s]]
                        rank = used[s] + np.arange(n)
                        epoch = rank // size
                        index = np.concatenate([permuted(rank[epoch == e] % size, size, key_of(seed, names[s], int(e))) for e in np.unique(epoch)])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(n, shard)), pa.array(order[at : at + n].astype(np.int32)), pa.array([names[s]] * n), pa.array(epoch.astype(np.int32)), pa.array(index),
                        ], ["shard", "slot", "source", "epoch", "block"])
                        at += n
                    used = used + many

    groups = -(-shards // GROUP)
    per = spark.range(groups).mapInArrow(drawn, "g long, s int, n long")
    earlier = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("g", "s", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")).groupBy("g").agg(F.collect_list(F.struct("s", "first")).alias("first"))
    # one group of shards is enough work for a task, which partitions that are joined by their few bytes would not show
    taken = first.repartition(max(1, min(groups, 1 << 14)), "g").mapInArrow(slots, "shard long, slot int, source string, epoch int, block long")
    places = packed.select("source", "bucket", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("seq", "block"))
    # both sides have a row for each block, which an estimate from the few buckets would not show
    placed = taken.join(places.hint("merge"), ["source", "block"]).select("source", "bucket", F.lit(1).alias("kind"), "shard", "slot", "epoch", "block", "seq")
    both = inside.select("source", "bucket", F.lit(0).alias("kind"), "doc_id", "h", "tokens").unionByName(placed, allowMissingColumns=True)
    return both.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "kind", F.col("doc_id").asc_nulls_last(), "h").mapInArrow(_fill(block, vocabulary), FILLED)
