from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tripleframe.llm.decontam import ERRORS, Q, SEGMENT, Index, banded, contaminated, drop_contaminated, grams, matches

DOCS, BENCH = "doc_id long, text string", "item_id long, text string"


def semi_global(passage: bytes, text: bytes) -> int:
    """Least edits between the passage and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    """Rows of (text number, item) with a passage within its edits, or a short item as whole words."""
    out = {(d, item) for item, short in items if 0 < len(short.encode()) < Q for d, text in enumerate(docs) if f" {short} " in f" {text} "}
    index = Index(items)
    for s in range(len(index.start)):
        for d, text in enumerate(docs):
            if semi_global(index.passage(s), text.encode()) <= index.edits(s):
                out.add((d, index.item[index.owner(s)]))
    return out


def sentence(r, n):
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(n))


def noisy(r, text, edits):
    for _ in range(edits):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "y" + text[i + 1 :]])
    return text


def test_finds_what_brute_force_finds():
    r = random.Random(4)
    items = [(i, sentence(r, r.choice([3, 8, 20, 40]))) for i in range(12)]
    docs = [sentence(r, 60) for _ in range(12)]
    for i, (_, text) in enumerate(items):
        docs.append(sentence(r, 10) + " " + noisy(r, text, r.randrange(0, 8)) + " " + sentence(r, 10))
        docs.append(noisy(r, text, i))
    got = {(d, item) for d, item, *_ in matches(Index(items), pa.array(docs))}
    want = brute(docs, items)
    assert got == want and len(want) > 8, len(want)


def test_lemma_and_band():
    r = random.Random(5)
    for _ in range(60):
        a = sentence(r, 12)[: r.randrange(20, 90)]
        b = noisy(r, a, r.randrange(0, 6))
        pad = sentence(r, 3)
        most, first = 6, len(pad) - 7
        assert banded(a.encode(), (pad + b + pad).encode(), first, 15, most) == (d if (d := semi_global(a.encode(), (pad + b + pad).encode())) <= most else None)
    index = Index([(1, "abcdefghij" * 3)])
    assert (index.least(np.arange(len(index.start))) >= 1).all() and index.edits(0) <= ERRORS * len(index.passage(0))
    data = np.frombuffer(b"abcdefghijklmnop" * 2, np.uint8)
    g = grams(data)
    assert len(g) == len(data) - Q + 1 and g[0] == g[16] and len(set(g[:16].tolist())) == 16


def test_edges(spark):
    r = random.Random(6)
    item, other = sentence(r, 40), sentence(r, 30)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, other), (3, "short"), (4, "")], BENCH)
    shout = item.upper().replace(" ", ",  ")
    rows = [(1, f"x {shout} y"), (None, item), (2, None), (3, ""), (4, other), (5, "short"), (6, item), (6, item), (7, sentence(r, 30000) + " " + item + " " + sentence(r, 3000))]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], DOCS + ", item_id string, tf_compared int")
    got = sorted((x.doc_id, x.item_id, x.edits) for x in contaminated(df, bench).collect())
    assert got == [(1, 1, 0), (5, 3, 0), (6, 1, 0), (6, 1, 0), (7, 1, 0)]
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["2", "3", "4"]
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0
    assert drop_contaminated(df, bench.limit(0)).count() == len(rows)


def test_part_of_an_item(spark):
    r = random.Random(7)
    item = sentence(r, 80)
    part = item[100 : 100 + 2 * SEGMENT]
    docs = spark.createDataFrame([(1, f"before {part} after"), (2, item[:40])], DOCS)
    assert [x.doc_id for x in contaminated(docs, spark.createDataFrame([(9, item)], BENCH)).collect()] == [1]


def test_benchmark_in_parts(spark, monkeypatch):
    from tripleframe.llm import decontam

    r = random.Random(8)
    items = [(i, sentence(r, 30)) for i in range(6)]
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in items] + [(99, sentence(r, 50))], DOCS)
    monkeypatch.setattr(decontam, "PART_BYTES", 300)
    bench = spark.createDataFrame(items, BENCH)
    assert len(decontam.indexes(bench)) > 2
    assert sorted((x.doc_id, x.item_id) for x in contaminated(docs, bench).collect()) == [(i, i) for i in range(6)]
    assert [x.doc_id for x in drop_contaminated(docs, bench).collect()] == [99]


def test_short_items_are_whole_words(spark):
    items = [(1, "forty two"), (2, "yes"), (3, "a b"), (4, "yes"), (5, "!?")]
    docs = ["it is forty two", "forty twos", "Yes, a  B c", "eyes", "yes yes", "", None, "é yes"]
    df = spark.createDataFrame(list(enumerate(docs)), DOCS)
    got = sorted(map(tuple, contaminated(df, spark.createDataFrame(items, BENCH)).collect()))
    assert got == [(0, 1, 6, 0), (2, 2, 0, 0), (2, 3, 4, 0), (2, 4, 0, 0), (4, 2, 0, 0), (4, 4, 0, 0), (7, 2, 3, 0), (7, 4, 3, 0)]


def test_grams_that_share_a_hash(monkeypatch):
    """The bytes decide, not the hash."""
    from tripleframe.llm import decontam

    monkeypatch.setattr(decontam, "grams", lambda data: np.zeros(max(len(data) - Q + 1, 0), np.uint64))
    r = random.Random(11)
    items = [(i, sentence(r, 14)) for i in range(3)]
    docs = [sentence(r, 9) + " " + items[1][1] + " " + sentence(r, 9), sentence(r, 30)]
    assert matches(Index(items), pa.array(docs)) == [(0, 1, docs[0].index(items[1][1]), 0)]


def test_an_index_is_bounded_by_its_text():
    import pickle

    r = random.Random(12)
    items = [(i, sentence(r, 40)) for i in range(3000)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(Index(items))) < 16 * size + (1 << 20)


def test_columns_that_differ_in_case_only(spark):
    r = random.Random(13)
    item = sentence(r, 30)
    df = spark.createDataFrame([(1, item, "other"), (2, "other", f"see {item}")], "doc_id long, Text string, text string")
    out = drop_contaminated(df, spark.createDataFrame([(9, item)], BENCH))
    assert out.columns == df.columns and [tuple(x) for x in out.collect()] == [(1, item, "other")]
