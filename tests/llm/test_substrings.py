from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tripleframe.llm import substrings
from tripleframe.llm.substrings import repeated_substrings, sliding_min, window_hashes

SCHEMA = "doc_id long, text string"


def brute(rows, width):
    counts = Counter()
    for _, text in rows:
        w = (text or "").split()
        counts.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    hit = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1 and doc is not None:
                hit.setdefault(doc, set()).update(range(i, i + width))
    out, starts = [], {}
    for doc, text in rows:
        w = (text or "").split()
        starts.setdefault(doc, set()).update(i for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1)
    for doc, own in starts.items():
        spans = []
        for i in sorted(own):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + width
            else:
                spans.append([i, i + width])
        out += [(doc, a, b) for a, b in spans if doc is not None]
    return sorted(out)


def run(spark, rows, width, schema=SCHEMA):
    return sorted(map(tuple, repeated_substrings(spark.createDataFrame(rows, schema), width).collect()))


def test_against_brute_force(spark):
    r = random.Random(1)
    for width in (1, 3, 5, 10):
        passage = " ".join(r.choice("abcdefgh") for _ in range(14))
        rows = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(40)))) for i in range(25)]
        rows += [(100 + i, f"x{i} {passage} y{i}\n z{i}") for i in range(4)]
        assert run(spark, rows, width) == brute(rows, width)


def test_hot_anchors(spark, monkeypatch):
    """Copies, and one passage in every document, go by the windows' own hashes, with the same result."""
    r = random.Random(3)
    passage = " ".join(r.choice("abcdefgh") for _ in range(9))
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(12))) + f" {passage} " + " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(12)))) for i in range(40)]
    rows += [(100 + i, " ".join(map(str, range(40)))) for i in range(20)] + [(200, "q w e r t y")]
    want = brute(rows, 10)
    for hot, small in ((1 << 14, 1 << 17), (5, 1 << 17), (5, 0), (0, 1 << 17)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "SMALL", small)
        assert run(spark, rows, 10) == want


def test_edges(spark):
    w = " ".join(map(str, range(30)))
    assert run(spark, [], 5) == []
    assert run(spark, [(1, None), (None, w), (2, ""), (3, " \n\t "), (4, "a b")], 5) == []
    assert run(spark, [(1, w), (1, w)], 5) == [(1, 0, 30)], "a row given twice is two occurrences"
    assert run(spark, [(1, w), (2, w + " " + w)], 30) == [(1, 0, 30), (2, 0, 60)]
    assert run(spark, [(1, "the " * 1000)], 5) == [(1, 0, 1000)], "a text may repeat itself"
    long = " ".join(f"w{i}" for i in range(60000))
    assert run(spark, [(1, long), (2, "q " + " ".join(f"w{i}" for i in range(59000, 59100)))], 50) == [(1, 59000, 59100), (2, 1, 101)]


def test_extra_columns_with_clashing_names(spark):
    w = " ".join(map(str, range(10)))
    rows = [("x", 1, w, 5, None, 1), ("y", 2, w, 6, None, 2)]
    assert run(spark, rows, 5, "anchor string, doc_id long, text string, start int, hashes string, h long") == [(1, 0, 10), (2, 0, 10)]


def test_kernels():
    r = np.random.default_rng(2)
    for width in (1, 2, 3, 7, 8, 13):
        v = r.integers(0, 1 << 60, 50).astype(np.uint64)
        assert (sliding_min(v, width) == np.lib.stride_tricks.sliding_window_view(v, width).min(axis=1)).all()
    codes = np.tile(r.integers(0, 1 << 60, 9).astype(np.uint64), 3)
    h = window_hashes(codes, np.arange(20), 7)
    assert (h[:9] == h[9:18]).all() and len(set(h.tolist())) == 9
