"""Parts of items, wherever they begin."""

from __future__ import annotations

import random

import pyarrow as pa

from tests.llm.test_decontam import BENCH, DOCS, brute, noisy, sentence
from tripleframe.llm.decontam import RUN, SEGMENT, Index, contaminated, matches


def test_parts_at_all_offsets(spark):
    r = random.Random(21)
    item = sentence(r, 60)
    words = item.split()
    index = Index([(1, item)])
    quotes = [" ".join(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]
    assert min(map(len, quotes)) < 92
    # 134 bytes, as item[5:139] that the grid of 48 bytes missed
    quotes += [item[i : i + 134] for i in range(len(item) - 133)]
    docs = [f"{sentence(r, 6)} {q} {sentence(r, 6)}" for q in quotes]
    assert [d for d, *_ in matches(index, pa.array(docs))] == list(range(len(docs)))
    short = [f"{sentence(r, 6)} {' '.join(words[i : i + 8])} {sentence(r, 6)}" for i in range(20)]
    assert matches(index, pa.array(short)) == []
    df = spark.createDataFrame([(1, docs[5]), (2, short[5])], DOCS)
    assert [x.doc_id for x in contaminated(df, spark.createDataFrame([(9, item)], BENCH)).collect()] == [1]


def test_noisy_parts_against_brute_force():
    r = random.Random(22)
    items = [(i, sentence(r, 30)) for i in range(3)]
    docs = []
    for _, text in items:
        words = text.split()
        for _ in range(4):
            i = r.randrange(len(words) - 16)
            docs.append(sentence(r, 5) + " " + noisy(r, " ".join(words[i : i + 16]), r.randrange(0, 7)) + " " + sentence(r, 5))
    got = {(d, item) for d, item, *_ in matches(Index(items), pa.array(docs))}
    assert got == brute(docs, items) and 3 < len(got) < len(docs)


def test_passages_keep_the_grid():
    text = sentence(random.Random(23), 60)
    index = Index([(1, text)])
    held = {index.passage(s) for s in range(len(index.start))}
    last = len(text) - SEGMENT
    assert all(text[i : i + SEGMENT].encode() in held for i in (*range(0, last, SEGMENT // 2), last))
