"""Benchmark decontamination: the q-gram lemma in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import apart, column, like, pick, private, slices, utf8_bytes

Q = 12
SEGMENT = 96
#: words of a passage that begins at every word
RUN = 13
ERRORS = 0.05
#: benchmark text of one index, which takes about 14 bytes for each byte of text
PART_BYTES = 4 << 20
#: document text that is held while a task goes through the indexes
HELD_BYTES = 64 << 20
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: Column) -> Column:
    """Lower case, with each run of characters that are neither letters nor digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.empty(len(data) - 7, np.uint64)
    for r in range(min(8, len(eight))):
        own = data[r : r + (len(data) - r) // 8 * 8]
        eight[r::8] = np.frombuffer(own.tobytes(), "<u8")
    out = eight[:n] * K1
    out += (eight[Q - 8 : Q - 8 + n] * K2) ^ (eight[Q - 8 : Q - 8 + n] >> np.uint64(29))
    return out * K1


def passages(data: bytes) -> np.ndarray:
    """(start, length): from each word RUN words, and from there and each half of SEGMENT bytes that many bytes."""
    begin = [0, *(i + 1 for i, c in enumerate(data) if c == 32)]
    end = [*(i - 1 for i in begin[1:]), len(data)]
    last = max(len(data) - SEGMENT, 0)
    out = {(i, min(i + SEGMENT, len(data))) for i in (*range(0, last, SEGMENT // 2), last, *(i for i in begin if i < last))}
    out = sorted(out | {(begin[k], end[k + RUN - 1]) for k in range(len(begin) - RUN + 1)})
    return np.array([(a, b - a) for a, b in out if b - a >= Q], np.int64).reshape(-1, 2)


class Index:
    """The q-grams of whole benchmark items, and the passages in which they are counted.

    Grams are 32 bits of their hash, sorted, each with its place in the items' joined text, which tells those apart that
    share a hash. Passages are where they start there, and their lengths.
    """

    def __init__(self, items: list[tuple[int, str]]):
        long = [(item, text.encode()) for item, text in items if len(text.encode()) >= Q]
        #: items of fewer bytes than a gram, which are sought as whole words
        self.short = [(item, text) for item, text in items if 0 < len(text.encode()) < Q]
        self.item = [item for item, _ in long]
        self.begin = np.cumsum([0, *(len(data) for _, data in long)])
        self.data = np.frombuffer(b"".join(data for _, data in long), np.uint8)
        code = grams(self.data)
        at = np.arange(len(code))
        at = at[at + Q <= self.begin[np.searchsorted(self.begin, at, "right")]]
        code = (code[at] >> np.uint64(32)).astype(np.uint32)
        sort = np.argsort(code, kind="stable")
        self.code, self.at = code[sort], at[sort].astype(np.int32 if len(self.data) < 1 << 31 else np.int64)
        cuts = [passages(data) for _, data in long]
        #: the passages of item k are window[k] to window[k + 1]
        self.window = np.cumsum([0, *(len(c) for c in cuts)])
        both = np.concatenate([np.zeros((0, 2), np.int64), *cuts])
        self.start, self.length = both[:, 0].astype(np.int32), both[:, 1].astype(np.int32)
        n = np.arange(self.length.max(initial=0) + 1)
        self.most = np.minimum((ERRORS * n).astype(np.int64), np.maximum((n - Q) // Q, 0))
        self.shared = n - Q + 1 - Q * self.most
        self.fewest = np.minimum.reduceat(self.least(np.arange(len(both))), self.window[:-1]) if long else np.zeros(0, np.int64)
        # 16 bits for each gram, 2^23 at least: what is not in it is in no item
        self.bits = int(np.clip(np.ceil(np.log2(16 * max(len(code), 1))), 23, 32))
        self.filter = np.zeros(1 << self.bits - 3, np.uint8)
        np.bitwise_or.at(self.filter, *self._bit(self.code))

    def _bit(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = code >> np.uint32(32 - self.bits)
        return k >> np.uint32(3), np.uint8(1) << (k & np.uint32(7)).astype(np.uint8)

    def edits(self, k):
        """The most edits of passages."""
        return self.most[self.length[k]]

    def least(self, k):
        """q-gram lemma: what is within the edits of a passage shares at least so many of its q-grams."""
        return self.shared[self.length[k]]

    def owner(self, k: int) -> int:
        """The number of the item that a passage is of."""
        return int(np.searchsorted(self.window, k, "right")) - 1

    def passage(self, k: int) -> bytes:
        a = self.begin[self.owner(k)] + self.start[k]
        return self.data[a : a + self.length[k]].tobytes()

    def hits(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shared q-grams: the text, the item's number, the position in the item and the diagonal of each."""
        code = (grams(data) >> np.uint64(32)).astype(np.uint32)
        byte, bit = self._bit(code)
        pos = np.flatnonzero(self.filter[byte] & bit)
        doc = np.searchsorted(begin, pos, "right") - 1
        ok = pos + Q <= begin[doc + 1]
        pos, doc = pos[ok], doc[ok]
        first = np.searchsorted(self.code, code[pos])
        many = np.searchsorted(self.code, code[pos], "right") - first
        at = self.at[np.repeat(first, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))].astype(np.int64)
        pos, doc = np.repeat(pos, many), np.repeat(doc, many)
        same = np.ones(len(at), bool)
        for k in range(Q):
            same &= self.data[at + k] == data[pos + k]
        at, pos, doc = at[same], pos[same], doc[same]
        own = np.searchsorted(self.begin, at, "right") - 1
        at = at - self.begin[own]
        return doc, own, at, pos - begin[doc] - at

    def regions(self, data: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, passage, first diagonal) of the bands that hold as many shared q-grams as the lemma asks for.

        Bands are 2 * (edits + 1) diagonals wide and begin every edits + 1, so a match lies inside of one. A text's
        passages of an item come together, those that share most first.
        """
        doc, own, at, diagonal = self.hits(data, begin)
        if not len(doc):
            return
        both = doc * len(self.fewest) + own
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        ok = count[inverse] >= self.fewest[own]
        both, at, diagonal = both[ok], at[ok], diagonal[ok]
        sort = np.lexsort((at, both))
        both, at, diagonal = both[sort], at[sort], diagonal[sort]
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(both)]):
            d, o = divmod(int(both[a]), len(self.fewest))
            w = np.arange(self.window[o], self.window[o + 1])
            lo = a + np.searchsorted(at[a:b], self.start[w])
            hi = a + np.searchsorted(at[a:b], self.start[w] + self.length[w] - Q, "right")
            ok = hi - lo >= self.least(w)
            for k in np.flatnonzero(ok)[np.argsort((self.length[w] - (hi - lo))[ok], kind="stable")].tolist():
                s = int(w[k])
                step, least = int(self.edits(s)) + 1, int(self.least(s))
                band, count = np.unique((diagonal[lo[k] : hi[k]] + self.start[s]) // step, return_counts=True)
                each = dict(zip(band.tolist(), count.tolist()))
                for x in sorted({*each, *(y - 1 for y in each)}):
                    if each.get(x, 0) + each.get(x + 1, 0) >= least:
                        yield d, s, x * step

    def words(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, item, position) of each short item that a text has as whole words."""
        if not self.short:
            return
        import ahocorasick

        known = ahocorasick.Automaton()
        for item, text in self.short:
            known.add_word(f" {text} ", (len(text) + 1, [*(known.get(f" {text} ", (0, []))[1]), item]))
        known.make_automaton()
        for d, text in enumerate(texts):
            padded, seen = f" {text} ", set()
            for end, (size, items) in known.iter(padded):
                for item in items:
                    if item not in seen:
                        seen.add(item)
                        yield d, item, len(padded[1 : end - size + 1].encode())


def banded(passage: bytes, text: bytes, first: int, width: int, most: int) -> int | None:
    """Least edits between the passage and any stretch of the text, along diagonals first .. first + width - 1.

    None if there are more than `most`. Cell (i, k) of the band is passage[:i] against a stretch that ends at text
    position i + first + k.
    """
    a, b = np.frombuffer(passage, np.uint8), np.frombuffer(text, np.uint8)
    k = np.arange(width)
    far = most + 1
    end = first + k
    row = np.where((end >= 0) & (end <= len(b)), 0, far)
    for i in range(1, len(a) + 1):
        end = i + first + k
        inside = (end >= 0) & (end <= len(b))
        char = np.where((end >= 1) & (end <= len(b)), b[np.clip(end - 1, 0, max(len(b) - 1, 0))] if len(b) else 0, -1)
        new = row + (char != a[i - 1])
        new[char < 0] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(np.where(inside, new, far) - k) + k
        row = np.minimum(np.where(inside, new, far), far)
        if row.min() > most:
            return None
    return int(row.min())


def matches(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """(text, item, position, edits), the best of each text and item, sorted."""
    data, begin = utf8_bytes(texts)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for d, s, first in index.regions(data, begin):
        edits, item = int(index.edits(s)), index.item[index.owner(s)]
        if best.get((d, item), (edits + 1, 0))[0] == 0:
            continue
        whole, passage = data[begin[d] : begin[d + 1]], index.passage(s)
        lo = max(first - 1, 0)
        part = whole[lo : first + 2 * (edits + 1) + len(passage) + 1].tobytes()
        exact = part.find(passage)
        cost = 0 if exact >= 0 else banded(passage, part, first - lo, 2 * (edits + 1), edits)
        if cost is not None:
            key, new = (d, item), (cost, lo + exact if exact >= 0 else max(first, 0))
            best[key] = min(best.get(key, new), new)
    for d, item, at in index.words([t or "" for t in texts.to_pylist()] if index.short else []):
        best[d, item] = min(best.get((d, item), (0, at)), (0, at))
    return sorted((d, item, at, cost) for (d, item), (cost, at) in best.items())


def indexes(benchmark: DataFrame) -> list[Broadcast]:
    """An index for each PART_BYTES of benchmark text: as many as it takes, each of bounded size."""
    items = pick(benchmark, item_id="long", text="string").where("item_id is not null and text is not null").select("item_id", normal(F.col("text")).alias("text")).distinct()
    sc, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        held.append(tuple(row))
        size += len(row.text.encode())
        if size >= PART_BYTES:
            out.append(sc.broadcast(Index(held)))
            held, size = [], 0
    return [*out, *([sc.broadcast(Index(held))] if held else [])]


def _scanned(shared: list[Broadcast], column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int]]]]:
    """The slices of the batches with their matches in all indexes, of which a worker holds one at a time."""

    def searched(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int]]]]:
        found: list[list] = [[] for _ in parts]
        for one in shared:
            for own, part in zip(found, parts):
                own += matches(one.value, part.column(column))
            if len(shared) > 1:
                one.__dict__.pop("_value", None)
        yield from ((part, sorted(own)) for own, part in zip(found, parts))

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, 4 << 20):
            held.append(part)
            size += part.nbytes
            if len(shared) == 1 or size >= HELD_BYTES:
                yield from searched(held)
                held, size = [], 0
    yield from searched(held)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, position, edits): documents that hold a passage of a benchmark item.

    Both texts are compared in lower case, with runs of other characters than letters and digits as one space. An item
    has passages of 13 words and of 96 bytes from every word on, and of 96 bytes every 48 (an item of less is one), and a
    passage is found where it is within 5 % edits: a quote of 13 whole words is, wherever it begins, and one of which
    every 13 words have a word replaced is not. An item of under 12 bytes is found where it stands as whole words.
    `position` is a byte in the compared text; best match of each row and item.

    Whole documents are scanned, once: 12-grams shared with an item are counted for each passage in overlapping bands of
    diagonals, bands with as many as the q-gram lemma asks for are kept, and each is verified by banded alignment. Only
    the benchmark travels, as indexes of bounded size; of several, a task holds one at a time.

    Null ids, null texts and items without a letter or digit match nothing; a row or item given twice is reported as
    often as the row is. Very long texts are slices of their own. Empty tables yield nothing. Other columns are ignored;
    of two that differ in case only, the last counts.
    """
    source = pick(docs, doc_id="long", text="string").where("doc_id is not null and text is not null").select("doc_id", normal(F.col("text")).alias("text"))
    shared = indexes(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scanned(shared, "text", batches):
            if found:
                doc, item, at, cost = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(at, pa.int64()), pa.array(cost, pa.int32())], ["doc_id", "item_id", "position", "edits"])

    return source.mapInArrow(run, "doc_id long, item_id long, position long, edits int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows in which `contaminated` finds a passage; all columns stay. Rows without text stay."""
    own = apart(docs)
    compared, shared = private(own, "tf_compared"), indexes(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scanned(shared, compared, batches):
            keep = np.ones(part.num_rows, bool)
            keep[[d for d, *_ in found]] = False
            yield part.filter(pa.array(keep)).drop_columns([compared])

    return like(docs, own.withColumn(compared, normal(F.col(column(own, "text")))).mapInArrow(run, own.schema))
