"""Substring dedup: Rabin-Karp window hashes, counted in Spark, merged into removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.llm.common import SLICE_BYTES, hash64, mix, pick, powers, ragged, slices, words, written

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
ANCHOR = 8
RUNS = "anchor long, doc_id long, start int, hashes array<long>"
#: windows of one anchor that are compared in one place; those of an anchor with more go by their own hashes
HOT = 1 << 14
SMALL = 1 << 17


def window_hashes(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of the `width` codes from each start."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(BASE, n), out=total[1:])
    return mix((total[starts + width] - total[starts]) * powers(INVERSE, n)[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _anchored(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...] | None:
    """Of the windows of a slice: the texts' first tokens, each window's text and first token, its anchor (the least hash
    of its 8-token grams), where another anchor or text begins, and the tokens' hashes."""
    gram = min(ANCHOR, width)
    at, distinct, code = words(part.column("text"))
    size = np.diff(at)
    count = np.maximum(size - width + 1, 0)
    if not count.sum():
        return None
    codes = hash64(distinct)[code]
    doc = np.repeat(np.arange(len(size)), count)
    start = np.repeat(at[:-1], count) + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    # grams that cross the end of a text are only in windows that do too
    grams = window_hashes(codes, np.arange(len(codes) - gram + 1), gram)
    anchor = sliding_min(grams, width - gram + 1)[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    return at, doc, start, anchor, first, codes


def _sizes(width: int):
    """How many windows of a slice each anchor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                if (found := _anchored(part, width)) is not None:
                    *_, anchor, first, _ = found
                    own, inverse = np.unique(anchor[first], return_inverse=True)
                    n = np.bincount(inverse, np.diff(np.append(first, len(anchor))), minlength=len(own)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _runs(width: int):
    """Neighbouring windows that share an anchor as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                if (found := _anchored(part, width)) is not None:
                    at, doc, start, anchor, first, codes = found
                    hashes = window_hashes(codes, start, width)
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(anchor[first].view(np.int64)), pa.array(ids[doc[first]].astype(np.int64)),
                        pa.array((start[first] - at[doc[first]]).astype(np.int32)),
                        ragged(hashes.view(np.int64), np.append(first, len(hashes))),
                    ], ["anchor", "doc_id", "start", "hashes"])

    return run


def repeated_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """Maximal intervals of tokens of which every window of `width` tokens occurs more than once in the corpus.

    Returns (doc_id, start_token, end_token), end exclusive; tokens are runs between ASCII white space. All
    occurrences are reported, as a removal that shall keep one must choose it by its own order.

    Each window is hashed (Rabin-Karp over 64-bit token hashes). Neighbouring windows with the same anchor travel as
    one row, keyed by the anchor: equal windows have equal anchors, so all copies of a window meet in one partition
    at 8 shuffled bytes a window, and are counted there. The anchors' repeated windows go back over the same exchange.
    The windows of anchors with over HOT windows (those of large groups of copies, and of much quoted passages) are
    counted by their own hashes, with sums before the shuffle, so that no anchor is large.

    Rows without doc_id or text, texts of under `width` tokens and empty tables yield nothing. Texts are read whole; a
    very long one is a slice of its own. A row given twice is two occurrences; rows that share a doc_id are reported as
    one document. Other columns are ignored; of two that differ in case only, the last counts.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    source = pick(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    runs = source.mapInArrow(_runs(width), RUNS)
    hot = written(source.mapInArrow(_sizes(width), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("anchor"), "hot")
    if not (many := hot.count()):
        return merged_intervals(_by_anchor(runs.repartition("anchor"), width))
    hot = F.broadcast(hot) if many <= SMALL else hot
    each = runs.join(hot, "anchor", "left_semi").select("doc_id", "start", F.posexplode("hashes").alias("i", "h"))
    each = written(each.select("doc_id", (F.col("start") + F.col("i")).alias("a"), "h"), "windows")
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    alone = each.join(often, "h", "left_semi").select("doc_id", "a", (F.col("a") + width).alias("b"))
    return merged_intervals(_by_anchor(runs.join(hot, "anchor", "left_anti").repartition("anchor"), width).union(alone))


def _by_anchor(runs: DataFrame, width: int) -> DataFrame:
    """(doc_id, a, b): stretches of repeated windows within runs, which are partitioned by their anchors."""
    # both uses of the runs must have the same columns and filters to share one exchange: so doc_id and start are counted
    # too, and explode_outer is for explode, which would filter (runs are never empty)
    seen = runs.withColumn("h", F.explode_outer("hashes")).groupBy("anchor", "h").agg(F.count("doc_id").alias("n"), F.count("start").alias("m"))
    often = seen.where("n > 1 and m > 1").groupBy("anchor").agg(F.collect_list("h").alias("often"))
    marked = runs.join(often.hint("shuffle_hash"), "anchor").select(
        "doc_id", "start", F.transform("hashes", lambda h: F.array_contains("often", h)).alias("hit")
    )
    # within a run: the windows where a stretch of hits begins and those where it ends
    size = F.size("hit")
    edge = F.sequence(F.lit(0), size - 1)
    begins = F.filter(edge, lambda i: F.get("hit", i) & ~F.coalesce(F.get("hit", i - 1), F.lit(False)))
    ends = F.filter(edge, lambda i: F.get("hit", i) & ~F.coalesce(F.get("hit", i + 1), F.lit(False)))
    return marked.select("doc_id", "start", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("p")).select(
        "doc_id", (F.col("start") + F.col("p.a")).alias("a"), (F.col("start") + F.col("p.b") + width).alias("b")
    )


def merged_intervals(pieces: DataFrame) -> DataFrame:
    """(doc_id, a, b) with overlapping and touching intervals of a document made one."""
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = pieces.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0))
    grouped = new.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "g").agg(F.min("a").alias("start_token"), F.max("b").alias("end_token")).drop("g")


SQL = r"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r\x0B]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM tok WHERE len(w) >= 50)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM win JOIN rep USING (h)),
brk AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS nw FROM hit),
grp AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM brk)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_token, CAST(max(i) + 50 AS INTEGER) AS end_token FROM grp GROUP BY doc_id, g
"""
