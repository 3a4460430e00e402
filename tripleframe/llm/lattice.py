"""LM scoring: the probability of a text, summed over all its segmentations into pieces of a vocabulary."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import SLICE_BYTES, kept, pick, slices, words
from tripleframe.llm.vocabulary import FOLDER, PIECES, pieces

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: longer runs of characters are scored apart, by the same recursion on its own
MATRIX = 64


class Lattice:
    """Log-probabilities of pieces, looked up by the hash of their code points."""

    def __init__(self, names: list[str], scores: np.ndarray, bytes_at: np.ndarray):
        self.byte = scores[bytes_at]
        self.score = {n: s for n, s in zip(names, scores.tolist()) if n}
        code = np.array([self.hash(n) for n in self.score], np.uint64)
        self.longest = max(map(len, self.score), default=1)
        #: at most a quarter of the slots is used
        self.shift = 64 - max(10, math.ceil(math.log2(4 * max(len(code), 1))))
        size = 1 << 64 - self.shift
        self.code, self.value = np.zeros(size, np.uint64), np.full(size, -np.inf)
        for h, s in zip(code.tolist(), self.score.values()):
            at = h >> self.shift
            while self.code[at]:
                at = (at + 1) % size
            self.code[at], self.value[at] = h, s
        used = np.flatnonzero(self.code)
        home = (self.code[used] >> np.uint64(self.shift)).astype(np.int64)
        self.probes = int(((used - home) % size).max(initial=0)) + 1

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h + ord(c) + 1) * int(BASE) & (1 << 64) - 1
            h ^= h >> 32
        return h or 1

    def lookup(self, code: np.ndarray) -> np.ndarray:
        at = (code >> np.uint64(self.shift)).astype(np.int64)
        out = np.where(self.code[at] == code, self.value[at], -np.inf)
        for k in range(1, self.probes):
            near = (at + k) & (len(self.code) - 1)
            hit = self.code[near] == code
            out[hit] = self.value[near[hit]]
        return out

    def fallback(self, char: int) -> float:
        return float(self.byte[list(chr(char).encode("utf-8", "surrogatepass"))].sum())

    def forward(self, text: str) -> float:
        """log of the sum, over all segmentations of the text into pieces, of the product of the pieces' probabilities.

        A character that is no piece of its own can also be its bytes.
        """
        alpha = [0.0]
        for j in range(1, len(text) + 1):
            terms = [alpha[i] + s for i in range(max(0, j - self.longest), j) if (s := self.score.get(text[i:j])) is not None]
            if text[j - 1] not in self.score:
                terms.append(alpha[j - 1] + self.fallback(ord(text[j - 1])))
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha[-1]

    def score_words(self, strings: list[str]) -> np.ndarray:
        """forward(SPACE + word) of each word: the recursion over all words of a length at a time."""
        out = np.zeros(len(strings))
        size = np.array([len(s) + 1 for s in strings], np.int64)
        for i in np.flatnonzero(size > MATRIX).tolist():
            out[i] = self.forward(SPACE + strings[i])
        for n in np.unique(size[size <= MATRIX]).tolist():
            rows = np.flatnonzero(size == n)
            for a in range(0, len(rows), 1 << 14):
                own = rows[a : a + (1 << 14)]
                text = "".join(SPACE + strings[i] for i in own.tolist())
                chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n).T.astype(np.uint64) + np.uint64(1)
                out[own] = self._matrix(np.ascontiguousarray(chars))
        return out

    def _matrix(self, chars: np.ndarray) -> np.ndarray:
        n, m = chars.shape
        edges: dict[int, list[tuple[int, np.ndarray]]] = {j: [] for j in range(1, n + 1)}
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = (h + chars[j - 1]) * BASE
                h ^= h >> np.uint64(32)
                s = self.lookup(np.where(h == 0, np.uint64(1), h))
                if j == i + 1 and (bad := np.isneginf(s)).any():
                    code, at = np.unique(chars[i][bad], return_inverse=True)
                    s[bad] = np.array([self.fallback(int(c) - 1) for c in code])[at]
                edges[j].append((i, s))
        alpha = np.zeros((n + 1, m))
        for j in range(1, n + 1):
            terms = np.stack([alpha[i] + s for i, s in edges.pop(j)])
            top = terms.max(axis=0)
            alpha[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha[n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each slice, and how often it has them."""
    for batch in batches:
        for part in slices(batch, "text"):
            _, distinct, code = words(part.column("text"))
            if distinct:
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(code, minlength=len(distinct)))], ["word", "n"])


def _segment(path: str):
    """Counts of the pieces of the tokenizer's own segmentation of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        total = np.zeros(model.get_piece_size())
        for batch in batches:
            n = batch.column("n").to_numpy()
            for a in range(0, batch.num_rows, 4096):
                ids = model.encode(batch.column("word").slice(a, 4096).to_pylist(), num_threads=1)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((x for y in ids for x in y), np.int64, int(size.sum()))
                total += np.bincount(flat, np.repeat(n[a : a + 4096], size), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["piece", "n"])

    return run


def piece_scores(docs: DataFrame, vocabulary: str = f"{FOLDER}/{PIECES}", smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names and log-probabilities of the vocabulary's pieces, and the numbers of its 256 byte pieces.

    The words of all documents are counted in Spark; each distinct word is segmented by the vocabulary's tokenizer, and
    the pieces' counts, plus `smoothing`, give their probabilities. Control pieces have none.
    """
    source = pick(docs, text="string").where("text is not null")
    counts = source.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.mapInArrow(_segment(vocabulary), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    model = pieces(vocabulary)
    size = model.get_piece_size()
    total = np.full(size, float(smoothing))
    for piece, n in rows:
        total[piece] += n
    names = [model.id_to_piece(i) for i in range(size)]
    control = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)])
    total[control] = 0
    with np.errstate(divide="ignore"):
        scores = np.log(total / total.sum())
    at = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    special = control.copy()
    special[at] = True
    return ["" if s else n for n, s in zip(names, special)], scores, at


def given_scores(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As piece_scores, of an existing unigram vocabulary: a sentencepiece model, or lines of a piece, a tab and its score.

    A byte piece that it doesn't have gets what sentencepiece gives to unknown characters: 10 less than the least score.
    """
    if path.endswith(".model"):
        model = pieces(path)
        rows = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    else:
        with open(path, encoding="utf-8") as file:
            rows = [(p, float(x)) for p, x in (line.rstrip("\n").rsplit("\t", 1) for line in file if line.strip("\n"))]
    total = sum(math.exp(x) for _, x in rows)
    if not 0 < total < 1.1:
        raise ValueError(f"the scores of {path} are no log-probabilities: their exponentials sum to {total:.3g}")
    names, scores = [p for p, _ in rows], [x for _, x in rows]
    known, at = {p: i for i, p in enumerate(names)}, []
    for piece in (f"<0x{b:02X}>" for b in range(256)):
        if piece not in known:
            known[piece] = len(names)
            names.append(piece)
            scores.append(min(x for _, x in rows) - 10)
        at.append(known[piece])
    special = set(at)
    return ["" if i in special else n for i, n in enumerate(names)], np.array(scores), np.array(at)


def lm_scores(docs: DataFrame, vocabulary: str = f"{FOLDER}/{PIECES}", smoothing: float = 0.5, scores: str | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_byte): the marginal log-probability of each document.

    A document's lattice has an edge for every piece of the vocabulary at every place, weighted by the piece's unigram
    log-probability, and for a character that is no piece, its byte pieces. The forward recursion in
    log space sums over all segmentations. Pieces do not go across white space, so the lattice of a document is those
    of its words one after another, and its log-probability the sum of theirs; each distinct word of a slice of
    documents is worked out once, all words of a length together. `scores` is the file of an existing unigram vocabulary
    (see given_scores); without one, the scores of `vocabulary`'s pieces are estimated from the documents (see
    piece_scores).

    Words are runs between ASCII white space, whole texts are scored. A null text has null scores; a text without words
    has log_prob 0 and null bits_per_byte (bytes count words and the space before each). Rows keep their doc_id, null or
    repeated. Other columns are ignored; of two that differ in case only, the last counts.
    """
    known = given_scores(scores) if scores else piece_scores(docs, vocabulary, smoothing)
    shared, name = docs.sparkSession.sparkContext.broadcast(known), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = kept("lattice", lambda: Lattice(*shared.value), name)
        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE_BYTES):
                text = part.column("text")
                at, distinct, code = words(text)
                size, length = np.diff(at), np.fromiter((len(w.encode()) + 1 for w in distinct), np.int64, len(distinct))
                score = lattice.score_words(distinct)
                doc = np.repeat(np.arange(len(size)), size)
                total = np.bincount(doc, score[code], minlength=len(size)).astype(float)
                many = np.bincount(doc, length[code], minlength=len(size))
                null, none = np.asarray(text.is_null()), size == 0
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(size, mask=null), pa.array(total, mask=null), pa.array(-total / np.maximum(many, 1) / math.log(2), mask=null | none),
                ], ["doc_id", "n_words", "log_prob", "bits_per_byte"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_words long, log_prob double, bits_per_byte double")
