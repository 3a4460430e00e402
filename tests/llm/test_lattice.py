from __future__ import annotations

import math

import numpy as np
import pytest

from tripleframe.llm.lattice import SPACE, Lattice, given_scores, lm_scores, piece_scores
from tripleframe.llm.vocabulary import FOLDER, PIECES, pieces

NAMES = ["a", "b", "ab", "ba", SPACE, SPACE + "a", "aba", *[f"<0x{b:02X}>" for b in range(256)]]
SCORES = np.log(np.linspace(1, 3, len(NAMES)) / 600)


@pytest.fixture(scope="module")
def lattice():
    return Lattice([n if not n.startswith("<0x") else "" for n in NAMES], SCORES, np.arange(7, 7 + 256))


def enumerate_all(lattice, text):
    """Log of the sum over all segmentations, one by one."""
    if not text:
        return [0.0]
    out = []
    for k in range(1, len(text) + 1):
        head = text[:k]
        s = lattice.score.get(head)
        if s is None and k == 1:
            s = lattice.fallback(ord(head))
        if s is not None:
            out += [s + rest for rest in enumerate_all(lattice, text[k:])]
    return out


def test_forward_sums_all_segmentations(lattice):
    words = ["a", "abab", "bab", "ababaabba", "axb", "é", "日a", "a" * 11, "b", "ab"]
    want = [math.log(sum(math.exp(x) for x in enumerate_all(lattice, SPACE + w))) for w in words]
    assert np.allclose([lattice.forward(SPACE + w) for w in words], want)
    assert np.allclose(lattice.score_words(words), want)


def test_long_words(lattice):
    words = ["ab" * 31, "ab" * 32, "ab" * 500]
    assert np.allclose(lattice.score_words(words), [lattice.forward(SPACE + w) for w in words])


DOCS = "doc_id long, text string"


def test_documents(spark):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, "the the"), (2, None), (3, ""), (4, " \n "), (5, "日本 zq " + "x" * 300), (6, "the cat " * 20000)]
    df = spark.createDataFrame([(*r, 0.5, 2) for r in rows], DOCS + ", log_prob double, n_words int")
    got = lm_scores(df).collect()
    assert len(got) == len(rows)
    names, scores, at = piece_scores(df)
    lattice = Lattice(names, scores, at)
    for r, (doc, text) in zip(got, rows):
        assert r.doc_id == doc
        if text is None:
            assert r.log_prob is None and r.n_words is None
        else:
            w = text.split()
            assert r.n_words == len(w) and math.isclose(r.log_prob, sum(lattice.forward(SPACE + x) for x in w), abs_tol=1e-6, rel_tol=1e-9)
            assert (r.bits_per_byte is None) == (not w)
    assert lm_scores(df.limit(0)).count() == 0


def test_scores_are_the_corpus_counts(spark):
    rows = [(1, "the cat the cat"), (2, "cat"), (3, None)]
    names, scores, _ = piece_scores(spark.createDataFrame(rows, DOCS), smoothing=0.5)
    model = pieces(f"{FOLDER}/{PIECES}")
    counts = np.zeros(len(scores))
    for _, t in rows:
        for w in (t or "").split():
            for i in model.encode(w):
                counts[i] += 1
    top = np.argsort(-counts)[:3]
    total = counts.sum() + 0.5 * (len(scores) - 3)
    assert np.allclose(np.exp(scores[top]), (counts[top] + 0.5) / total)
    assert math.isclose(np.exp(scores[np.isfinite(scores)]).sum(), 1)
    # a likelier text under the corpus has fewer bits a byte
    got = {r.doc_id: r.bits_per_byte for r in lm_scores(spark.createDataFrame([*rows, (9, "zebra quartz")], DOCS)).collect()}
    assert got[9] > got[2]


def test_long_pieces_and_large_vocabularies():
    """No piece is left out, whatever its length, and the table grows with the vocabulary."""
    names = ["a", "b", "ab" * 20, SPACE, *[f"p{i}" for i in range(70000)], *[""] * 256]
    scores = np.full(len(names), math.log(1 / len(names)))
    lattice = Lattice(names, scores, np.arange(len(names) - 256, len(names)))
    assert lattice.longest == 40 and len(lattice.code) >= 4 * 70000
    word = "ab" * 20
    want = math.log(math.exp(41 * scores[0]) + math.exp(2 * scores[0]))
    assert math.isclose(lattice.forward(SPACE + word), want) and np.allclose(lattice.score_words([word, "ab" * 20 + "a"]), [want, lattice.forward(SPACE + word + "a")])


def test_existing_scores(spark, tmp_path):
    rows = [(SPACE, -2.0), ("a", -1.5), ("b", -2.5), ("ab", -2.0), (SPACE + "a", -3.0)]
    path = tmp_path / "scores.tsv"
    path.write_text("".join(f"{p}\t{x}\n" for p, x in rows), encoding="utf-8")
    lattice = Lattice(*given_scores(str(path)))
    got = {r.doc_id: r.log_prob for r in lm_scores(spark.createDataFrame([(1, "ab a"), (2, "é")], DOCS), scores=str(path)).collect()}
    assert math.isclose(got[1], lattice.forward(SPACE + "ab") + lattice.forward(SPACE + "a"))
    assert math.isclose(lattice.forward(SPACE + "ab"), math.log(sum(map(math.exp, (-2 - 1.5 - 2.5, -2 - 2, -3 - 2.5)))))
    assert math.isclose(got[2], -2 + 2 * -13), "a character without a piece is its bytes, 10 under the least score"
    with pytest.raises(ValueError, match="no log-probabilities"):
        given_scores(f"{FOLDER}/{PIECES}")
