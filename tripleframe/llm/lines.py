"""Line dedup: counts of line hashes behind sharded minimal perfect hashes, which the documents' lines probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tripleframe.llm.common import apart, column, like, mix, partitions, private, written

BLANKS = " \t\n\x0b\f\r"
SHARD = "shard int, levels array<int>, bits binary, prints binary, counts binary, owners binary"
#: distinct lines of a shard
SHARD_LINES = 1 << 19
#: a line of more occurrences than this, and than this part of all, is resolved where its documents are; there are at most so many
HEAVY = 1 << 16
NO_ID = (1 << 63) - 1
GAMMA, LEVELS = 2, 64


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> dict:
    """Minimal perfect hash of distinct keys: each level places the keys that collide with no other of those left over.

    A key's index is the number of set bits before its own, over all levels; the arrays are in that order.
    """
    left, sizes, levels = keys, [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("the keys are not distinct")
        size = -(-GAMMA * len(left) // 64) * 64
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    bits = np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool), bitorder="little")
    out = {"levels": np.array(sizes, np.int32), "bits": bits}
    index = lookup(keys, out)
    prints, many, first = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.int64)
    prints[index], many[index], first[index] = fingerprints(keys), np.minimum(counts, 65535), owners
    return out | {"prints": prints, "counts": many, "owners": first}


def lookup(keys: np.ndarray, table: dict) -> np.ndarray:
    """The index of each key; -1 where no level has its bit."""
    words = table["bits"].view(np.uint64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])
    out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(table["levels"].tolist()):
        at = _place(keys[todo], level, size) + base
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        w, b = word[hit], bit[hit]
        out[todo[hit]] = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))
        todo, base = todo[~hit], base + size
    return out


def counted(keys: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """The stored count and owner of each key; 0 and -1 for keys that the table was not built of."""
    if not len(table["prints"]):
        return np.zeros(len(keys), np.uint16), np.full(len(keys), -1)
    at = lookup(keys, table)
    known = (at >= 0) & (table["prints"][at] == fingerprints(keys))
    return np.where(known, table["counts"][at], 0), np.where(known, table["owners"][at], -1)


ARRAYS = {"levels": np.int32, "bits": np.uint8, "prints": np.uint32, "counts": np.uint16, "owners": np.int64}


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    t = build(rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), rows["owner"].to_numpy(np.int64))
    return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "levels": [t["levels"]], **{k: [t[k].tobytes()] for k in ARRAYS if k != "levels"}})


def _probe(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions are sorted by shard, a shard's arrays before its probes, so one shard is in memory at a time."""
        shard, table = None, None
        for batch in batches:
            of = batch.column("shard").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if b > a and part.column("bits")[0].is_valid:
                    x = part.slice(0, 1).to_pylist()[0]
                    shard = x["shard"]
                    table = {k: np.array(x[k], kind) if k == "levels" else np.frombuffer(x[k], kind) for k, kind in ARRAYS.items()}
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                assert shard == part.column("shard")[0].as_py()
                many, owner = counted(part.column("h").to_numpy().view(np.uint64), table)
                hit = pa.array(many >= least)
                own = pa.array(owner == part.column("id").to_numpy())
                yield pa.RecordBatch.from_arrays([*[part.column(c).filter(hit) for c in ("key", "id", "pos")], own.filter(hit)], ["key", "id", "pos", "own"])

    return run


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clean(text: str, hits: list[tuple[int, bool]]) -> str | None:
    """`text` without the lines at these positions; of those that are the document's own, each line's first stays.

    None if no line with characters is left.
    """
    lines, gone, seen = text.split("\n"), set(), set()
    for pos, own in sorted(hits):
        line = lines[pos].strip(BLANKS)
        if own and line not in seen:
            seen.add(line)
        else:
            gone.add(pos)
    left = [x for i, x in enumerate(lines) if i not in gone]
    return "\n".join(left) if not gone or any(x.strip(BLANKS) for x in left) else None


@F.pandas_udf(StringType())
def _clean(text: pd.Series, pos: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else clean(t, list(zip(p, o))) for t, p, o in zip(text, pos, own)], dtype=object)


def drop_repeated_lines(docs: DataFrame, min_count: int = 2) -> DataFrame:
    """`docs` without the lines that earlier documents have, of those that the corpus has `min_count` times or more.

    A line counts without its outer ASCII white space; empty lines stay and are not counted. Of each such line the
    document with the least doc_id keeps the first; it goes from the rest of that document and from all others. A
    document of which no line is left repeats others as a whole, and goes too. All columns are kept; where the input
    has n_chars and a text changes, n_chars becomes its length.

    Distinct line hashes, with their counts and least doc_ids, are counted in Spark and go to shards of about
    SHARD_LINES; each builds a minimal perfect hash with arrays of 32-bit fingerprints, 16-bit counts (at 65535 they stop
    counting, the most that min_count may be) and owners. The hashes of the documents' lines stream past the arrays of
    their shard, so memory holds one shard's. Lines of over HEAVY occurrences don't travel: these few are sent to all.

    Null texts stay null, texts without any line of characters stay. Rows without doc_id count as one document, after
    all others. Rows that share a doc_id are one document, each of which keeps what that document keeps. Ties are thus
    all kept. Texts are read whole, whatever their length, in time linear in it. Empty tables stay empty. Of two columns
    that differ in case only, the last counts.
    """
    if not 1 <= min_count <= 65535:
        raise ValueError("min_count must be from 1 to 65535")
    own = apart(docs)
    text, ident = F.col(column(own, "text")), F.coalesce(F.col(column(own, "doc_id")).cast("long"), F.lit(NO_ID))
    key = F.xxhash64(text)
    probes = (
        own.where(text.isNotNull()).select(key.alias("key"), ident.alias("id"), F.posexplode(_lines(text)).alias("pos", "line"))
        .select("key", "id", "pos", F.trim(F.col("line"), F.lit(BLANKS)).alias("line")).where("line <> ''")
        .select("key", "id", "pos", F.xxhash64("line").alias("h"))
    )
    counts = written(probes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("owner")), "lines")
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(4 * partitions(docs.sparkSession), distinct // SHARD_LINES)
    heavy = counts.where((F.col("n") > max(HEAVY, total // HEAVY)) & (F.col("n") >= min_count)).select("h", "owner")
    shard = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    arrays = counts.select(shard, "h", "n", "owner").groupBy("shard").applyInPandas(_build, SHARD)
    few = not heavy.isEmpty()
    sent = probes.join(F.broadcast(heavy), "h", "left_anti") if few else probes
    none = {"key": "long", "id": "long", "pos": "int", "h": "long"}
    both = arrays.select("shard", F.lit(0).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()], *ARRAYS).unionByName(
        sent.select(shard, F.lit(1).alias("kind"), *none), allowMissingColumns=True
    )
    hits = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_probe(min_count), "key long, id long, pos int, own boolean")
    if few:
        hits = hits.union(probes.join(F.broadcast(heavy), "h").select("key", "id", "pos", F.col("id") == F.col("owner")))
    k, i, x, new = (private(own, f"tf_{c}") for c in ("key", "id", "hits", "new"))
    found = hits.groupBy(F.col("key").alias(k), F.col("id").alias(i)).agg(F.collect_set(F.struct("pos", "own")).alias(x))
    joined = own.withColumns({k: key, i: ident}).join(found.hint("shuffle_hash"), [k, i], "left")
    given = F.when(F.col(x).isNotNull(), text)
    out = joined.withColumn(new, _clean(given, F.col(f"{x}.pos"), F.col(f"{x}.own"))).where(F.col(x).isNull() | F.col(new).isNotNull())
    low = {c.lower(): c for c in own.columns}
    if "n_chars" in low:
        c = low["n_chars"]
        out = out.withColumn(c, F.when(F.col(new) != text, F.length(new).cast(own.schema[c].dataType)).otherwise(F.col(c)))
    return like(docs, out.withColumn(low["text"], F.coalesce(F.col(new), text)))


SQL = r"""
WITH src AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, text, lang, source, n_chars FROM documents),
ln AS (SELECT r, id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM src WHERE text IS NOT NULL),
tl AS (SELECT r, id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM ln),
cnt AS (SELECT t, count(*) AS n, min(id) AS own FROM tl WHERE t <> '' GROUP BY t),
mk AS (SELECT tl.*, coalesce(n, 0) >= 2 AND (own <> id OR row_number() OVER (PARTITION BY r, tl.t ORDER BY pos) > 1) AS gone FROM tl LEFT JOIN cnt USING (t)),
agg AS (SELECT r, bool_or(gone) AS hot, count(*) FILTER (WHERE t <> '' AND NOT gone) AS remain,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest FROM mk GROUP BY r)
SELECT doc_id, CASE WHEN hot THEN rest ELSE text END AS text, lang, source,
  CASE WHEN hot THEN CAST(length(rest) AS BIGINT) ELSE n_chars END AS n_chars
FROM src LEFT JOIN agg USING (r) WHERE NOT (coalesce(hot, false) AND remain = 0)
"""
