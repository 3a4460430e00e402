"""What addresses lead to."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.terms import is_http
from tripleframe.model import RESOURCE_SCHEMA, arrow_rows

#: address and timeout to (status, content type, body)
Client = Callable[[str, float], tuple[int, str, bytes]]


def http_get(uri: str, timeout: float) -> tuple[int, str, bytes]:
    request = urllib.request.Request(uri, headers={"Accept": "text/turtle, application/rdf+xml, */*;q=0.5"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", "") if e.headers else "", b""


def fetch_one(uri: str, client: Client = http_get, timeout: float = 10.0) -> dict:
    """Never fails: what went wrong is in `error`."""
    out = {"uri": uri, "content_type": None, "body": None, "error": None}
    if not uri.startswith(("http://", "https://")):
        return out | {"error": f"not an HTTP address: {uri}"}
    try:
        status, kind, body = client(uri, timeout)
    except Exception as e:
        return out | {"error": f"{type(e).__name__}: {e}"}
    if not 200 <= status < 400:
        return out | {"error": f"status {status}"}
    return out | {"content_type": kind, "body": body}


def fetch(uris: DataFrame, client: Client = http_get, timeout: float = 10.0, at_once: int = 8) -> DataFrame:
    """A resource for each distinct address in the first column, `at_once` in each task.

    The addresses are spread over all tasks by their hash: joined by size, a few bytes each, one would fetch them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for a in range(0, batch.num_rows, 16 * at_once):
                    own = batch.column("uri").slice(a, 16 * at_once).to_pylist()
                    yield arrow_rows(list(pool.map(lambda u: fetch_one(u, client, timeout), own)), RESOURCE_SCHEMA)

    tasks = int(uris.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return uris.select(F.col(uris.columns[0]).alias("uri")).dropna().distinct().repartition(tasks, F.xxhash64("uri")).mapInArrow(run, RESOURCE_SCHEMA)


def fetch_all(df: DataFrame, client: Client = http_get, timeout: float = 10.0) -> DataFrame:
    """What the triples' objects on the web lead to, one step."""
    return fetch(df.where(is_http(F.col("object"))).select("object"), client, timeout)
