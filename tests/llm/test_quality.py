from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tripleframe.llm import quality

BIG = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def table(rows):
    """Of (text, quality, toxic): what labelled() gives."""
    columns = [*[pa.array(range(len(rows)), pa.int64())] * 2, pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)]]
    return pa.Table.from_batches(list(quality._featured([pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "text", "quality", "toxic"])])))


@pytest.fixture(scope="module")
def split(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = [(r.text, r.quality, r.toxic) for r in docs.join(labels, "doc_id").orderBy("doc_id").collect()]
    return rows[::2], rows[1::2]


def test_held_out_accuracy_and_calibration(split):
    train, test = split
    heads = quality.fit(table(train))
    for k, p in enumerate(quality.probabilities(heads, pa.array([t for t, *_ in test]))):
        y = np.array([r[1 + k] for r in test])
        assert ((p > 0.5) == y).mean() > 0.95
        assert ((p - y) ** 2).mean() < 0.05, "Brier score"
    good = quality.probabilities(heads, pa.array([t for t, *_ in test]))[0]
    assert np.mean(good[[r[1] == 1 for r in test]] > 0.5) > 0.99, "clean documents are kept"


def plain_ngrams(text: str):
    raw = text.encode()
    words, now = [], b""
    for c in raw + b" ":
        if bytes([c]).isalnum() or c >= 128:
            now += bytes([c]).lower()
        elif now:
            words.append(now)
            now = b""
    return [raw[i : i + 4] for i in range(len(raw) - 3)], words, list(zip(words, words[1:]))


def test_ngrams_against_plain_ones():
    texts = ["Ab ab, cd", "", "x", "cd", "é é-Ab", "abcd", "ab"]
    kinds = quality.ngrams(pa.array(texts))
    plain = [plain_ngrams(t) for t in texts]
    for k, (size, feature) in enumerate(kinds):
        assert size.tolist() == [len(p[k]) for p in plain]
        seen = {}
        for gram, code in zip([g for p in plain for g in p[k]], feature.tolist()):
            gram = "same" if k == 2 and gram[0] == gram[1] else gram
            assert seen.setdefault(gram, code) == code
        assert len(set(seen.values())) == len(seen)
    doc, feature, weight = quality.features(pa.array(texts))
    head = quality.Head(np.random.default_rng(1).normal(size=3 << quality.BITS).astype(np.float32), 0.3)
    want = np.bincount(doc, head.weights[feature] * weight, minlength=len(texts)) + 0.3
    assert np.allclose(quality.logits((head,), pa.array(texts))[0], want)


def test_edges(spark):
    good, bad = "a quiet sentence of plain words ", "### $$$ !!! %%% "
    docs = [(i, (good if i % 2 else bad) * 5 + str(i)) for i in range(80)]
    labels = [(i, i % 2, 0) for i in range(60)] + [(0, 0, 0), (None, 1, 1), (500, 1, 1), (3, None, 0)]
    extra = [(None, good * 4), (900, None), (901, ""), (902, bad * 3000), (902, bad * 3000)]
    df = spark.createDataFrame([(*r, 1.0, True) for r in docs + extra], DOCS + ", quality double, keep boolean")
    marks = spark.createDataFrame(labels, LABELS)
    got = [(r.doc_id, r.keep) for r in quality.quality_scores(df, marks).collect()]
    assert len(got) == len(docs) + len(extra) and all(k == bool(i % 2) for i, k in got if i is not None and i < 80)
    assert got.count((902, False)) == 2 and (None, True) in got
    kept = quality.drop_rejected(df, marks)
    assert kept.columns == df.columns and kept.where("doc_id < 80 and doc_id % 2 = 0").count() == 0 and kept.where("doc_id % 2 = 1 and doc_id < 80").count() == 40
    # without labels there is no reason to reject
    assert quality.drop_rejected(df, marks.limit(0)).count() == df.count()
    assert quality.quality_scores(df.limit(0), marks).count() == 0


def plain_fit(rows, y, train, passes, rate, batch):
    """The fit feature by feature, on dicts. `rows`: {feature: weight} of each."""
    w, order = {}, [i for i in range(len(rows)) if train[i]]
    k1 = sum(y[i] for i in order)
    bias = math.log((k1 + 0.5) / (len(order) - k1 + 0.5))
    for k, (many, l1) in enumerate(passes):
        live = None if k == 0 else {f for f, x in w.items() if x}
        past, past_bias = {}, 1e-8
        for _ in range(many):
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                grad, total = {}, 0.0
                for i in own:
                    items = [(f, v) for f, v in rows[i].items() if live is None or f in live]
                    z = bias + sum(w.get(f, 0.0) * v for f, v in items)
                    off = (1 / (1 + math.exp(-z)) - y[i]) / len(own)
                    total += off
                    for f, v in items:
                        grad[f] = grad.get(f, 0.0) + v * off
                for f, g in grad.items():
                    past[f] = past.get(f, 1e-8) + g * g
                    step = rate / math.sqrt(past[f])
                    new = w.get(f, 0.0) - step * g
                    w[f] = math.copysign(max(abs(new) - step * l1, 0), new)
                past_bias += total**2
                bias -= rate * total / math.sqrt(past_bias)
    return w, bias


def test_fit_against_plain_python():
    r = random.Random(2)
    rows = [{r.randrange(40) if r.random() < 0.8 else 1000 + i: r.random() for _ in range(r.randrange(8))} for i in range(90)]
    y = np.array([float(sum(v for f, v in x.items() if f < 15) > 1) for x in rows])
    train = np.arange(len(rows)) % 5 != 0
    begin = np.cumsum([0, *map(len, rows)])
    feature, weight = (np.array([x[k] for row in rows for x in sorted(row.items())]) for k in (0, 1))
    passes = ((3, 1e-2), (20, 1e-2), (30, 0.0))
    head = quality._fit(begin, feature.astype(np.int32), weight.astype(np.float32), y, train, passes)
    w, bias = plain_fit([{f: float(np.float32(v)) for f, v in x.items()} for x in rows], y, train, passes, quality.RATE, quality.BATCH)
    want = np.zeros(3 << quality.BITS)
    want[list(w)] = list(w.values())
    assert np.allclose(head.weights, want, atol=1e-4) and math.isclose(head.bias, bias, abs_tol=1e-6)
    assert 0 < np.count_nonzero(head.weights) < len(w), "L1 took some to 0"
    logit = np.array([bias + sum(w.get(f, 0) * v for f, v in x.items()) for x in rows])
    assert ((logit > 0) == (y > 0))[train].mean() > 0.95
    assert np.allclose((head.slope, head.shift), quality._calibrate(logit[~train], y[~train]), atol=1e-3)


def test_calibration_is_the_least_of_its_loss():
    r = np.random.default_rng(3)
    logit = r.normal(size=200) * 3
    y = (r.random(200) < 1 / (1 + np.exp(-0.7 * logit + 0.4))).astype(float)
    k1, k0 = y.sum(), (1 - y).sum()

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * logit + b)))
        t = np.where(y > 0, (k1 + 1) / (k1 + 2), 1 / (k0 + 2))
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).sum() + 0.5 * ((a - 1) ** 2 + b**2)

    a, b = quality._calibrate(logit, y)
    grid = min((loss(x, z), x, z) for x in np.arange(0.2, 2, 0.05) for z in np.arange(-2, 2, 0.05))
    assert loss(a, b) <= grid[0] and abs(a - grid[1]) < 0.06 and abs(b - grid[2]) < 0.06


def test_query_against_brute_force(spark):
    """Rows chosen, fitted, scored and tested one by one in plain Python."""
    r = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words[:30] if i % 3 else words[30:]) for _ in range(r.randrange(3, 30)))) for i in range(160)]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 160, 2)]
    order = {x.doc_id: x.h for x in spark.createDataFrame(labels, LABELS).selectExpr("doc_id", "xxhash64(doc_id, 17) AS h").collect()}
    text = dict(docs)
    chosen = sorted(labels, key=lambda x: (order[x[0]], x[0]))[:50]
    heads = quality.fit(table([(text[d], q, t) for d, q, t in chosen]))
    got = {x.doc_id: x for x in quality.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), sample=50).collect()}
    assert len(got) == len(docs)
    for doc, own in docs:
        _, feature, weight = quality.features(pa.array([own]))
        want = []
        for head in heads:
            z = head.bias + sum(float(head.weights[f]) * w for f, w in zip(feature.tolist(), weight.tolist()))
            want.append(1 / (1 + math.exp(-(head.slope * z + head.shift))))
        assert np.allclose((got[doc].quality, got[doc].toxic), want, atol=1e-5)
        assert got[doc].keep == (want[0] >= 0.5 and want[1] <= 0.5)
    assert sum(got[d].keep for d, _ in docs) not in (0, len(docs))


def test_columns_that_differ_in_case_only(spark):
    docs = spark.createDataFrame([(i, "x", "good words" if i % 2 else "### bad") for i in range(40)], "doc_id long, TEXT string, text string")
    kept = quality.drop_rejected(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS))
    assert kept.columns == docs.columns and {r[2] for r in kept.collect()} == {"good words"}
