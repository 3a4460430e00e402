from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa

from tripleframe.llm import simhash
from tripleframe.llm.simhash import BITS, BUDGET, components, drop_near_duplicates, near_duplicates, near_pairs, plan, signatures, trie_pairs, tries

SCHEMA = "doc_id long, text string"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(60, 200))]
        rows.append((i, " ".join(words)))
        for k in range(r.choice([0, 0, 1, 3])):
            near = [f"n{r.randrange(4000)}" if r.random() < 0.05 else w for w in words]
            rows.append((1000 + 10 * i + k, " ".join(near)))
    return rows


def brute(rows, budget=BUDGET):
    rows = [(d, t) for d, t in rows if d is not None and t and t.split()]
    sign, _ = signatures(pa.array([t for _, t in rows], pa.string()))
    out = {}
    for (i, (a, _)), (j, (b, _)) in itertools.combinations(enumerate(rows), 2):
        d = int(np.bitwise_count(sign[i] ^ sign[j]).sum())
        if d <= budget:
            out[tuple(sorted((a, b)))] = d
    return out


def groups(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {x: find(x) for x in top if find(x) != x}


def plain_signature(text):
    """Bits by plain sums over the distinct features."""
    words = {simhash.feature(w) for w in text.split()}
    ids = np.sort(simhash.hash64(sorted(words)))
    low, high = ids.astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint32)
    sums = np.array([sum(simhash.projection(low, high, bit).astype(np.float64).tolist()) for bit in range(BITS)])
    return np.packbits(sums > 0, bitorder="little").view(np.uint64), np.abs(sums)


def test_signature_of_words():
    text = "The cat, the CAT sat!"
    texts = [text, "", None, "x " * 1000, " ".join(f"w{i}" for i in range(10000))]
    sign, size = signatures(pa.array(texts, pa.string()))
    assert size.tolist() == [3, 0, 0, 1, 10000]
    for i in (0, 3, 4):
        want, margin = plain_signature(texts[i])
        differ = np.unpackbits((sign[i] ^ want).view(np.uint8), bitorder="little").astype(bool)
        assert (margin[differ] < 1).all() and differ.sum() <= 1  # sums of another order may round to the other side of 0
    alone, _ = signatures(pa.array([texts[4]]))
    assert (alone[0] == sign[4]).all(), "a signature is that of its text alone"


def test_signatures_follow_the_share_of_common_features():
    r = random.Random(1)
    for share in (0.02, 0.05, 0.1):
        rows = []
        for _ in range(200):
            words = [f"w{r.randrange(10**6)}" for _ in range(300)]
            rows += [" ".join(words), " ".join(f"n{r.randrange(10**6)}" if r.random() < share else w for w in words)]
        sign, _ = signatures(pa.array(rows))
        got = np.bitwise_count(sign[::2] ^ sign[1::2]).sum(axis=1).mean() / BITS
        jaccard = (1 - share) / (1 + share)
        assert abs(got - (1 - jaccard) / 2) < 0.02, (share, got)


def sample(n, seed=1):
    """Random signatures, half of them with some bits of another one flipped, the flips from few to over the budget."""
    r = np.random.default_rng(seed)
    bits = r.integers(0, 2, (n, BITS)).astype(np.uint8)
    for i in range(n // 2, n):
        bits[i] = bits[r.integers(0, i)]
        bits[i, r.permutation(BITS)[: r.integers(1, 2 * BUDGET)]] ^= 1
    return np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), axis=0)


def all_pairs(sign, budget):
    out = {}
    for i in range(len(sign)):
        d = np.bitwise_count(sign[i + 1 :] ^ sign[i]).sum(axis=1)
        out |= {(i, i + 1 + int(j)): int(d[j]) for j in np.flatnonzero(d <= budget)}
    return out


def test_trie_join_is_exact(monkeypatch):
    sign = sample(400)
    words = np.ascontiguousarray(np.packbits(np.unpackbits(sign.view(np.uint8).reshape(len(sign), -1), axis=1, bitorder="little"), axis=1)).view(">u8").astype(np.uint64)
    sort = np.lexsort((words[:, 1], words[:, 0]))
    head = words[sort, 0] >> np.uint64(62)
    cuts = np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(head)]])
    for leaf in (1, 8, 64):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        for budget in (0, 5, 15, 30):
            got = {(min(x, y), max(x, y)): d for a, b, n in trie_pairs(words[sort], cuts, 2, budget) for x, y, d in zip(sort[a].tolist(), sort[b].tolist(), n.tolist())}
            inside = {k: v for k, v in all_pairs(sign, budget).items() if words[k[0], 0] >> np.uint64(62) == words[k[1], 0] >> np.uint64(62)}
            assert got == inside
    assert list(trie_pairs(words[:0], np.array([0]), 2, 5)) == []


def test_tries_hold_every_pair_within_the_budget():
    """By the pigeonhole: whichever `budget` bits differ, some trie's error-free levels have none of them."""
    r = np.random.default_rng(3)
    for budget, free in ((BUDGET, 1), (BUDGET, 2), (BUDGET, 3), (0, 1), (5, 2)):
        every = tries(budget, free)
        masks = np.zeros((len(every), BITS), bool)
        for t, (depth, order) in enumerate(every):
            assert sorted(order.tolist()) == list(range(BITS))
            masks[t, order[:depth]] = True
        for _ in range(200):
            differ = np.zeros(BITS, bool)
            differ[r.permutation(BITS)[:budget]] = True
            assert (~(masks & differ).any(axis=1)).any()
    assert [plan(n, BUDGET) for n in (10, 10**5, 10**7, 10**9, 10**11)] == [1, 1, 2, 3, 4]
    assert [len(tries(BUDGET, k)) for k in (1, 2, 3)] == [16, 136, 816]


def edges(spark, sign, **kw):
    rows = [(i, *(int(x) for x in s.view(np.int64))) for i, s in enumerate(sign)]
    df = spark.createDataFrame(rows, simhash.SIGNED)
    return {(r.a, r.b): r.bits for r in simhash._edges(df, BUDGET, False, **kw).collect()}


def test_every_pair_is_found(spark):
    for n in (200, 20000):
        sign = sample(n, n)
        want = all_pairs(sign, BUDGET)
        assert edges(spark, sign) == want and len(want) > n // 8
    sign = sample(600, 9)
    want = all_pairs(sign, BUDGET)
    assert edges(spark, sign, free=2) == want, "another block changes the cost alone"
    assert edges(spark, sign, hot=4) == want, "large subtrees in cells"


def test_a_large_subtree_of_near_copies(spark):
    """All signatures within the budget of each other: one component, also in cells and where node pairs are skipped."""
    r = np.random.default_rng(5)
    bits = np.repeat(r.integers(0, 2, (1, BITS)).astype(np.uint8), 700, 0)
    for row in bits:
        row[r.permutation(BITS)[:5]] ^= 1
    sign = np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), axis=0)
    rows = [(i, *(int(x) for x in s.view(np.int64))) for i, s in enumerate(sign)]
    for hot in (100, None):
        found = simhash._edges(spark.createDataFrame(rows, simhash.SIGNED), BUDGET, True, hot=hot)
        got = {x.node: x.top for x in components(found).collect()}
        assert len(got) == len(sign) and set(got.values()) == {0}


def test_pairs_of_texts_against_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    got = {(r.a, r.b): r.bits for r in near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 20


def test_groups_against_brute_force(spark):
    rows = corpus(7) + [(5000, corpus(7)[0][1]), (5001, corpus(7)[0][1])]
    found = {r.doc_id: r.kept_doc_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == groups(brute(rows))


def test_columns_that_differ_in_case_only(spark):
    t = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(1, "a", t), (2, "b", t), (3, "a", "other words here")], "doc_id long, Text string, text string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, "a", t), (3, "a", "other words here")]


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(1, None), (None, t), (2, ""), (3, " "), (4, t), (4, t), (9, t), (7, t + " more"), (8, " ".join(f"q{i}" for i in range(100)))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", top string, tf_gone int")
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(7, 4), (9, 4)]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "4", "8", "None"]
    one = spark.createDataFrame([(1, "only")], SCHEMA)
    assert near_duplicates(one).collect() == []


def test_many_copies_and_long_texts(spark):
    t = " ".join(f"w{i}" for i in range(20000))
    rows = [(i, t) for i in range(300)] + [(1000 + i, t + f" x{i}") for i in range(30)]
    assert drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 201)]
    got = {r.node: r.top for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and got[201] == 200
