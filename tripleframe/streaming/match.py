"""Queries over a stream of triples: patterns that a stream meets are filters, joined with static triples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tripleframe.model import triples
from tripleframe.plans.compiler import Compiler
from tripleframe.plans.ir import Iri
from tripleframe.plans.parser import QueryError, parse
from tripleframe.runtime import shared_dir


def stream_query(stream: DataFrame, static: DataFrame, text: str, streamed: set[str]) -> DataFrame:
    """Solutions as they come. Triples with a predicate in `streamed` come from the stream, others are static.

    The query may have patterns with constant predicates, VALUES and filters, and one pattern on the stream, so it holds
    no state; aggregates, DISTINCT and LIMIT are for the sink's batches.
    """
    q = parse(text)
    if q.aggregates or q.distinct or q.limit or q.offset or q.order_by or q.where.optionals or q.where.unions:
        raise QueryError("a stream takes patterns, VALUES and filters")
    own = [p for p in q.where.patterns if isinstance(p.predicate, Iri) and p.predicate.value in streamed]
    if len(own) != 1 or not all(isinstance(p.predicate, Iri) for p in q.where.patterns):
        raise QueryError("exactly one pattern is on the stream, and predicates are constant")
    moving, fixed = triples(stream), triples(static)
    return Compiler(stream.sparkSession, lambda p: moving if p in streamed else fixed).select(q)


def drained(solutions: DataFrame) -> DataFrame:
    """What a stream's solutions are to the end of what is there, as a table that executors write in the shared folder, and
    its log beside it: no row passes the driver. Each call has a table of its own, which stays until the folder goes."""
    spark = solutions.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = solutions.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(solutions.schema).parquet(f"{at}/rows")
