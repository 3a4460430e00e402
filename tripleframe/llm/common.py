"""What the corpus operators share: inputs, byte-level kernels, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.runtime import shared_dir

SLICE_BYTES = 16 << 20


def apart(df: DataFrame) -> DataFrame:
    """`df` whose column names also differ without their case: of those that don't, the last keeps its name. Names with
    dots or backticks, which mapInArrow can't resolve, are replaced, too; see like."""
    last = {c.lower(): i for i, c in enumerate(df.columns)}
    plain = [c.replace(".", "_").replace("`", "_") for c in df.columns]
    names = [c if last[c.lower()] == i and c == p else f"tf_{i}_{p}" for i, (c, p) in enumerate(zip(df.columns, plain))]
    return df if names == df.columns else df.toDF(*names)


def column(df: DataFrame, name: str) -> str:
    """The column of that name in any case."""
    return {c.lower(): c for c in df.columns}[name]


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast to their types; missing ones are null, other columns are dropped.

    Names count in any case; of several columns that differ in case only, the last is meant.
    """
    df = apart(df)
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[c]) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """`out`, made of apart(docs), with the columns of `docs`, in their order."""
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in apart(docs).columns]).toDF(*docs.columns)


def private(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    taken, k = {c.lower() for c in docs.columns}, name
    while k.lower() in taken:
        k = f"_{k}"
    return k


#: intermediate tables that were written and not removed since
WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, lineage cut, columns read as needed. See tidy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables written by this process, from the `since`-th on. For when the results that were
    made of them are written themselves: a result that is still to be computed reads them."""
    while len(WRITTEN) > since:
        remove(spark, WRITTEN.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


KEPT: dict[str, tuple] = {}


def kept(name: str, make, version: str = ""):
    """A value that a Python worker makes once and keeps between tasks, until another version of it is asked for."""
    if KEPT.get(name, (None,))[0] != version:
        KEPT[name] = (version, make())
    return KEPT[name][1]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text; a longer text is a slice of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(size) > start:
        yield batch.slice(start)


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Tokens between ASCII white space: where each text's begin, the distinct ones, and the number of each token's."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    size = np.asarray(pc.list_value_length(lists), np.int64)
    flat = lists.flatten()
    empty = np.asarray(pc.equal(flat, ""), bool)
    if empty.any():
        doc = np.repeat(np.arange(len(size)), size)[empty]
        size = size - np.bincount(doc, minlength=len(size))
        flat = flat.filter(pa.array(~empty))
    code = flat.dictionary_encode()
    return np.concatenate([[0], np.cumsum(size)]), code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)


def hash64(strings: list[str], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(s, seed) for s in strings), np.uint64, len(strings))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)[:n]


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list array of `values` cut at `offsets`."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. for count[0] numbers, then start[1], .."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) - np.repeat(end - count - start, count)
