"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tripleframe.llm.common import pick, slices
from tripleframe.llm.vocabulary import FOLDER, TIKTOKEN, encoder

LONG = 1 << 16
BATCH_BYTES = 1 << 18
#: where a token of the split pattern ends whatever stands around: before a blank after none; else, where letters, digits
#: and signs meet, but for an apostrophe before letters
BLANK = regex.compile(r"(?<=\S)(?=[ \n])")
CHANGE = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def split_safely(text: str, longest: int = LONG) -> list[str]:
    """Pieces of at least `longest` characters, cut where tokens end, whose tokens are the text's.

    The first blank within as many characters again is taken, or else the first change of the kind of character. A run
    of one kind is one token of the split pattern, and stays whole.
    """
    out, start = [], 0
    while len(text) - start > longest:
        at = start + longest
        m = BLANK.search(text, at, at + longest) or CHANGE.search(text, at)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def balanced(sizes: list[int], most: int = BATCH_BYTES) -> list[list[int]]:
    """Numbers of the pieces by batch, about `most` bytes each: largest first into batches while they have room."""
    out, room = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not out or room < sizes[i]:
            out.append([])
            room = most
        out[-1].append(i)
        room -= sizes[i]
    return out


def lengths(texts: list[str | None], path: str) -> np.ndarray:
    encode = encoder(path)
    parts, owner = [], []
    for i, text in enumerate(texts):
        if text:
            cut = split_safely(text)
            parts += cut
            owner += [i] * len(cut)
    count = np.zeros(len(texts), np.int64)
    for batch in balanced([len(p.encode()) for p in parts]):
        for i, ids in zip(batch, encode.encode_ordinary_batch([parts[i] for i in batch], num_threads=1)):
            count[owner[i]] += len(ids)
    return count


def token_counts(docs: DataFrame, vocabulary: str = f"{FOLDER}/{TIKTOKEN}") -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of each text under a tiktoken vocabulary.

    Texts are encoded in Arrow batches that are cut by bytes; within one, pieces go in batches balanced by bytes. Texts
    of over 65,536 characters are split before blanks, or else where letters, digits and signs meet: there a token of
    the vocabulary's split pattern ends, so the counts are those of the whole text. Only a longer run of one kind of
    characters, which is one token of the pattern, is encoded as one.

    One row for each row, also for null or repeated doc_ids. A null text has null tokens, an empty one 0. Other columns
    are ignored; of two that differ in case only, the last counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                text = part.column("text")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths(text.to_pylist(), vocabulary), mask=np.asarray(text.is_null()))], ["doc_id", "n_tokens"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long")
