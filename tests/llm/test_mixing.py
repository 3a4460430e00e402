from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import mixing, vocabulary
from tripleframe.llm.mixing import SEED, draw, encode, key_of, mix_sources, permuted, unpack
from tripleframe.llm.vocabulary import FOLDER, TIKTOKEN, end_of

PATH = f"{FOLDER}/{TIKTOKEN}"
END = end_of(PATH)
DOCS = "doc_id long, text string, source string"


def corpus():
    r = random.Random(1)
    return [(i, " ".join(f"word{r.randrange(99)}" for _ in range(r.randrange(60))), r.choice(["a", "a", "a", "b", "c"])) for i in range(80)]


def packed(spark, rows, block):
    """Blocks of each source in order: buckets by the documents' hashes, documents by doc_id and the text's hash."""
    df = spark.createDataFrame([(d, t, s or "") for d, t, s in rows], DOCS).withColumn("h", F.xxhash64("text")).withColumn("k", F.xxhash64("doc_id", "h"))
    sources, out = defaultdict(list), {}
    for r in df.collect():
        sources[r.source].append((r.k, r.doc_id is None, r.doc_id or 0, r.h, r.doc_id, encode(r.text, PATH).tolist()))
    for s, docs in sources.items():
        many, streams = -(-sum(len(d[-1]) for d in docs) // mixing.BUCKET), defaultdict(list)
        for k, *_, doc, tokens in sorted(docs, key=lambda d: d[1:4]):
            streams[k % many] += [(t, doc) for t in tokens]
        out[s] = [
            ([t for t, _ in own], list(dict.fromkeys(d for _, d in own if d is not None)))
            for b in sorted(streams) for i in range(0, len(streams[b]), block) for own in [streams[b][i : i + block]]
        ]
    return out


def brute(spark, rows, block, size, shards, weights=None, others=0.0):
    blocks = packed(spark, rows, block)
    names = sorted(s for s in blocks if weights is None or weights.get(s, others) > 0)
    share = np.array([1.0 if weights is None else weights.get(s, others) for s in names])
    used, out = Counter(), []
    for shard in range(shards):
        many, order = draw(shard, size, share / share.sum(), SEED)
        slots = iter(order.tolist())
        for s, n in zip(names, many.tolist()):
            for _ in range(n):
                epoch, at = divmod(used[s], len(blocks[s]))
                used[s] += 1
                index = int(permuted(np.array([at]), len(blocks[s]), key_of(SEED, s, epoch))[0])
                tokens, ids = blocks[s][index]
                out.append((shard, next(slots), s, epoch, index, len(tokens), ids, tokens))
    return sorted(out)


def run(df, block, **kw):
    got = mix_sources(df, block=block, **kw).collect()
    assert all(unpack(r.tokens)[r.n_tokens :] == [END] * (block - r.n_tokens) for r in got), "blocks are of fixed length"
    return sorted((*r[:7], unpack(r.tokens, r.n_tokens)) for r in got)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(mixing, "BUCKET", 700)
    for parts, weights, others in ((1, None, 0.0), (5, None, 0.0), (5, {"a": 1.0, "c": 3.0, "none": 2.0}, 0.0), (3, {"c": 5.0}, 1.0)):
        got = run(spark.createDataFrame(rows, DOCS).repartition(parts), 64, shard_blocks=16, shards=40, weights=weights, others=others)
        assert got == brute(spark, rows, 64, 16, 40, weights, others)
        if weights and not others:
            share = Counter(r[2] for r in got)
            assert set(share) == {"a", "c"} and 0.7 < share["c"] / len(got) < 0.8


def test_no_token_is_lost(spark):
    rows = corpus()
    got = run(spark.createDataFrame(rows, DOCS).repartition(5), 64, shard_blocks=16, shards=40)
    for s in "abc":
        seen = {r[4]: r[7] for r in got if r[2] == s and r[3] == 0}
        want = Counter(t for _, text, source in rows if source == s for t in encode(text, PATH).tolist())
        assert sorted(seen) == list(range(len(seen))) and Counter(t for b in seen.values() for t in b) == want
        assert sum(len(b) < 64 for b in seen.values()) == 1, "one bucket"
        epochs = Counter(r[3] for r in got if r[2] == s)
        assert all(n == len(seen) for e, n in epochs.items() if e < max(epochs)), "an epoch uses every block once"
    slots = Counter((r[0], r[1]) for r in got)
    assert len(slots) == 40 * 16 and set(slots.values()) == {1}


def test_wide_vocabularies_and_weights(spark, monkeypatch):
    df = spark.createDataFrame([(1, "some text", "a")], DOCS)
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            mix_sources(df, weights=bad)
    monkeypatch.setattr(mixing, "end_of", lambda path: 70000)
    assert mixing.kind(PATH) == "<u4" and mixing.unpack(encode("some text", PATH).tobytes())[-1] == 70000
    assert vocabulary.end_of(PATH) == 50256


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        for key in (1, 2):
            assert sorted(permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 1).tolist() != permuted(np.arange(1000), 1000, 2).tolist()


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x", None), (3, "word " * 30000, "b"), (3, "twice", "b"), (3, "twice", "b")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", shard int, tokens string").coalesce(1)
    got = run(df, 128, shard_blocks=8)
    assert got == brute(spark, [r for r in rows if r[1] is not None], 128, 8, len(got) // 8)
    assert {r[2] for r in got} == {"", "a", "b"} and next(r for r in got if r[2] == "a")[7] == [END] and next(r for r in got if r[2] == "")[6] == []
    assert mix_sources(df.limit(0)).count() == 0 and mix_sources(df, weights={"z": 1}).count() == 0
