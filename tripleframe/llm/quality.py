"""Quality rules: hashed n-gram logistic regression, calibrated, against fixed thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import apart, column, like, mix, pick, powers, private, ragged, slices, spans, utf8_bytes

BITS = 18
CHARS = 4
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20
#: of the fit: passes over the rows with their L1, AdaGrad's rate, rows of a batch
PASSES, RATE, BATCH = ((5, 1e-3), (50, 1e-3), (200, 0.0)), 0.3, 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def ngrams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: how many each text has, and the hashed feature of each, text after text.

    Kinds are 4-byte character grams with their case, words (runs of letters, digits and non-ASCII bytes, in lower
    case) and pairs of neighbouring words. All pairs of a word with itself are one feature.
    """
    data, begin = utf8_bytes(texts)
    n, docs = len(data), len(begin) - 1
    size = np.maximum(np.diff(begin) - CHARS + 1, 0)
    if n >= CHARS:
        code = np.zeros(n - CHARS + 1, np.uint32)
        for k in range(CHARS):
            code |= data[k : n - CHARS + 1 + k].astype(np.uint32) << np.uint32(8 * k)
        ok = np.ones(len(code), bool)
        for k in range(1, CHARS):  # grams that cross the end of a text
            cross = begin[1:-1] - k
            ok[cross[(cross >= 0) & (cross < len(code))]] = False
        chars = ((code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    else:
        chars = np.zeros(0, np.int64)
    out = [(size, chars)]
    letter = LETTER[data]
    # a text's end inside a run of letters is both an end and a start
    inner = begin[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start = np.concatenate([letter[:1], letter[1:] & ~letter[:-1]])
    stop = np.concatenate([letter[:-1] & ~letter[1:], letter[-1:]])
    start[inner] |= letter[inner]
    stop[inner - 1] |= letter[inner - 1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    word = mix((total[stop] - total[start]) * powers(INVERSE, n + 1)[start] + (stop - start).astype(np.uint64))
    size = np.diff(np.searchsorted(start, begin))
    out.append((size, ((word >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)).astype(np.int64)))
    doc = np.repeat(np.arange(docs), size)
    pair = doc[1:] == doc[:-1]
    both = np.where(word[1:] == word[:-1], np.uint64(0), mix(word[:-1] * np.uint64(3) + word[1:]))[pair]
    out.append((np.maximum(size - 1, 0), ((both >> np.uint64(64 - BITS)) + np.uint64(2 << BITS)).astype(np.int64)))
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) of each n-gram: one over the root of the text's number of its kind, so that noise keeps
    its size whatever a text's length."""
    kinds = ngrams(texts)
    doc = np.concatenate([np.repeat(np.arange(len(size)), size) for size, _ in kinds])
    weight = np.concatenate([np.repeat(1 / np.sqrt(np.maximum(size, 1)), size) for size, _ in kinds])
    return doc, np.concatenate([f for _, f in kinds]), weight


def logits(heads: tuple[Head, ...], texts: pa.Array) -> list[np.ndarray]:
    """Each head's bias and the weights of all n-grams of each text."""
    kinds = ngrams(texts)
    out = [np.full(len(texts), h.bias) for h in heads]
    for size, feature in kinds:
        some = size > 0
        if some.any():
            first = (np.cumsum(size) - size)[some]
            for h, total in zip(heads, out):
                total[some] += np.add.reduceat(h.weights[feature], first, dtype=np.float64) / np.sqrt(size[some])
    return out


@dataclass
class Head:
    """Logistic regression on hashed features, with Platt's calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -50, 50)))


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's sigmoid, by Newton's method; his targets keep probabilities off 0 and 1."""
    k1, k0 = y.sum(), (1 - y).sum()
    target, at = np.where(y > 0, (k1 + 1) / (k1 + 2), 1 / (k0 + 2)), np.array([1.0, 0.0])

    def loss(a: np.ndarray) -> float:
        x = a[0] * logit + a[1]
        return float(np.logaddexp(0, x).sum() - (target * x).sum() + 0.5 * ((a - [1, 0]) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * logit + at[1], -50, 50)))
        r, h = p - target, p * (1 - p)
        grad = np.array([(r * logit).sum() + at[0] - 1, r.sum() + at[1]])
        step = np.linalg.solve(np.array([[(h * logit * logit).sum() + 1, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1]]), grad)
        rate = 1.0
        while rate > 1e-6 and loss(at - rate * step) > loss(at):
            rate /= 2
        at = at - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def _passes(w: np.ndarray, bias: float, batches: list[tuple], y: np.ndarray, passes: int, l1: float, rate: float) -> float:
    """Proximal AdaGrad over the batches: a feature's steps follow its own gradients, so that rare words count as common
    ones do, and L1 takes weights that are no more than noise to 0. Changes `w`, returns the bias."""
    past, past_bias = np.full(len(w), 1e-8), 1e-8
    for _ in range(passes):
        for own, used, place, value, row in batches:
            mine = w[used]
            z = np.bincount(row, mine[place] * value, minlength=len(own)) + bias
            off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[own]) / len(own)
            grad = np.bincount(place, value * off[row], minlength=len(used))
            past[used] += grad * grad
            step = rate / np.sqrt(past[used])
            new = mine - step * grad
            w[used] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            past_bias += off.sum() ** 2
            bias -= rate * off.sum() / np.sqrt(past_bias)
    return float(bias)


def _fit(begin: np.ndarray, feature: np.ndarray, weight: np.ndarray, y: np.ndarray, train: np.ndarray, passes: tuple[tuple[int, float], ...] = PASSES, rate: float = RATE) -> Head:
    """Logistic regression with L1 on all features of the rows in `train`, calibrated on the others.

    Row i has the features begin[i] to begin[i + 1], each once. `passes`: how many, and their L1; the first go over all
    features, the next over those whose weights are not 0 by then.
    """
    n, size = len(y), np.diff(begin)
    head = Head(np.zeros(3 << BITS, np.float32), 0.0)
    if not n or not train.any():
        return head
    rows = np.flatnonzero(train)
    k1 = y[rows].sum()
    w, bias = np.zeros(3 << BITS), float(np.log((k1 + 0.5) / (len(rows) - k1 + 0.5)))
    for k, (many, l1) in enumerate(passes if 0 < k1 < len(rows) else ()):
        batches = []
        for a in range(0, len(rows), BATCH):
            own = rows[a : a + BATCH]
            at, row = spans(begin[own], size[own]), np.repeat(np.arange(len(own)), size[own])
            if k:
                some = w[feature[at]] != 0
                at, row = at[some], row[some]
            used, place = np.unique(feature[at], return_inverse=True)
            batches.append((own, used, place.astype(np.int32), weight[at].astype(np.float64), row))
        bias = _passes(w, bias, batches, y, many, l1, rate)
    head.weights[:], head.bias = w, bias
    held = np.flatnonzero(~train)
    if len(held) and 0 < y[held].sum() < len(held):
        at = spans(begin[held], size[held])
        z = np.bincount(np.repeat(np.arange(len(held)), size[held]), head.weights[feature[at]] * weight[at], minlength=len(held)) + head.bias
        head.slope, head.shift = _calibrate(np.clip(z, -30, 30), y[held])
    return head


def _distinct(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of one text, each with the sum of its weights."""
    _, feature, weight = features(pa.array([text]))
    feature, inverse = np.unique(feature, return_inverse=True)
    return feature.astype(np.int32), np.bincount(inverse, weight, minlength=len(feature)).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each row's text instead of the text."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            both = [_distinct(t) for t in part.column("text").to_pylist()]
            at = np.cumsum([0, *(len(f) for f, _ in both)])
            feature, weight = (np.concatenate([np.zeros(0, k), *(x[i] for x in both)]) for i, k in enumerate((np.int32, np.float32)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in FEATURED[:4]], ragged(feature, at), ragged(weight, at)], FEATURED)


FEATURED = ["h", "doc_id", "quality", "toxic", "feature", "weight"]


def fit(rows: pa.Table) -> tuple[Head, Head]:
    """Heads for quality and for toxic, of rows with their features, as of _featured; every fifth row calibrates."""
    rows = rows.combine_chunks()
    lists = [rows.column(c).chunk(0) if rows.num_rows else pa.array([], pa.list_(k)) for c, k in (("feature", pa.int32()), ("weight", pa.float32()))]
    begin = np.concatenate([[0], np.cumsum(np.asarray(lists[0].value_lengths(), np.int64))])
    feature, weight = (np.asarray(x.flatten()) for x in lists)
    train = np.arange(rows.num_rows) % 5 != 0
    return tuple(_fit(begin, feature, weight, np.asarray(rows.column(c), np.float64), train) for c in ("quality", "toxic"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> pa.Table:
    """At most `sample` labelled rows with their features, those first by a hash of the id, whose order is the rows'."""
    marks = pick(labels, doc_id="long", quality="int", toxic="int").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    chosen = marks.orderBy(*order).limit(sample)
    # the marks are few and bounded, so they go to the documents
    rows = pick(docs, doc_id="long", text="string").where("text is not null").join(F.broadcast(chosen), "doc_id")
    # a doc_id of several rows counts once
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    out = once.withColumn("h", order[0]).mapInArrow(_featured, "h long, doc_id long, quality int, toxic int, feature array<int>, weight array<float>")
    return out.toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])


def probabilities(heads: tuple[Head, ...], texts: pa.Array) -> list[np.ndarray]:
    return [h.probability(x) for h, x in zip(heads, logits(heads, texts))]


def _model(docs: DataFrame, labels: DataFrame, sample: int):
    return docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, labels, sample)))


def quality_scores(docs: DataFrame, labels: DataFrame, min_quality: float = 0.5, max_toxic: float = 0.5, sample: int = 3000) -> DataFrame:
    """(doc_id, quality, toxic, keep): calibrated probabilities of each document, and whether both thresholds hold.

    The labels' two columns each have a logistic regression on hashed word and character n-grams, all those of the rows
    that train it, with L1 against chance. They are fitted on the driver on at most `sample` labelled documents, chosen
    by a hash of the id (their features are made by the executors); a fifth of these calibrate. Documents are scored
    whole, whatever their length, in Arrow batches, without a shuffle.

    A row keeps its doc_id, null or repeated. A null text is scored as an empty one, whose probabilities follow from
    the labels' shares. Labels with a null are no labels; of several of one doc_id the greatest of each column counts;
    of several texts of one doc_id the least trains. Without labels both probabilities are 0.5, and the row is kept.
    Empty tables yield nothing. Other columns are ignored; of two that differ in case only, the last counts.
    """
    shared = _model(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                good, bad = probabilities(shared.value, part.column("text"))
                keep = (good >= min_quality) & (bad <= max_toxic)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(good), pa.array(bad), pa.array(keep)], ["doc_id", "quality", "toxic", "keep"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, quality double, toxic double, keep boolean")


def drop_rejected(docs: DataFrame, labels: DataFrame, min_quality: float = 0.5, max_toxic: float = 0.5, sample: int = 3000) -> DataFrame:
    """`docs` without the rows that quality_scores does not keep; all columns stay."""
    own = apart(docs)
    shared, name = _model(own, labels, sample), private(own, "tf_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, name, SLICE):
                good, bad = probabilities(shared.value, part.column(name))
                yield part.filter(pa.array((good >= min_quality) & (bad <= max_toxic))).drop_columns([name])

    return like(docs, own.withColumn(name, F.col(column(own, "text")).cast("string")).mapInArrow(run, own.schema))
