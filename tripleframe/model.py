"""Schemas of the records that flow between operators, and vocabulary addresses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(*names: str, kind: T.DataType | None = None, nullable: bool = True) -> list[T.StructField]:
    return [T.StructField(n, kind or T.StringType(), nullable) for n in names]


TRIPLE_SCHEMA = T.StructType(
    _fields("subject", "predicate", "object", nullable=False)
    + _fields("graph")
    + _fields("is_literal", kind=T.BooleanType(), nullable=False)
    + _fields("datatype", "language", "direction")
    + _fields("is_triple_term", kind=T.BooleanType(), nullable=False)
    + _fields("reifier")
    # where the parser found it: orders "first" and "last" rules
    + _fields("pos", kind=T.LongType())
)
STATEMENT_SCHEMA = T.StructType(
    _fields("file")
    + _fields("seq", kind=T.IntegerType())
    + _fields("subject", "predicate", "object", "kind")
    + _fields("pos", "end", "line", "col", kind=T.IntegerType())
)
PROVENANCE = T.StructType(_fields("source_file") + _fields("line", "column", "start_pos", "end_pos", kind=T.IntegerType()))
FACT_SCHEMA = T.StructType(_fields("subject", "predicate", "object") + _fields("derived", kind=T.BooleanType()) + _fields("provenance", kind=PROVENANCE))
INCONSISTENCY_SCHEMA = T.StructType(_fields("type", "message") + _fields("provenance", kind=PROVENANCE))
ISSUE_SCHEMA = T.StructType(
    _fields("type", "severity", "subject", "message") + _fields("context", kind=T.MapType(T.StringType(), T.StringType())) + _fields("confidence", kind=T.DoubleType())
)
RESOURCE_SCHEMA = T.StructType(_fields("uri", "content_type") + _fields("body", kind=T.BinaryType()) + _fields("error"))


class Namespace(str):
    """An address prefix: RDF.type is RDF + "type"."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return self + name.rstrip("_")


RDF = Namespace("http://www.w3.org/1999/02/22-rdf-syntax-ns#")
RDFS = Namespace("http://www.w3.org/2000/01/rdf-schema#")
OWL = Namespace("http://www.w3.org/2002/07/owl#")
XSD = Namespace("http://www.w3.org/2001/XMLSchema#")
SKOS = Namespace("http://www.w3.org/2004/02/skos/core#")
MAGIC = Namespace("http://sparql.xyz/facade-x/ns/")
DEFAULT_GRAPH = "https://example.org/graph"
TYPE = RDF + "type"


ARROW = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}


def arrow_rows(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    """Rows as an Arrow batch of a flat schema; what a row lacks is null."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], ARROW[f.dataType]) for f in schema], schema.names)


def triples(df: DataFrame, graph: str | None = None) -> DataFrame:
    """`df` with the columns of TRIPLE_SCHEMA: what it lacks is null, or false; other columns are dropped."""
    out = []
    for f in TRIPLE_SCHEMA:
        if f.name == "graph" and graph is not None:
            out.append(F.lit(graph).alias("graph"))
        elif f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append((F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def triples_of(spark: SparkSession, rows: list[tuple], graph: str = "default") -> DataFrame:
    """Triples of (subject, predicate, object[, is_literal[, language[, datatype]]]) rows, in order."""
    full = [(*r, *(False, None, None)[len(r) - 3 :], i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "subject string, predicate string, object string, is_literal boolean, language string, datatype string, pos long")
    return triples(df, graph)


def inferred(subject: Column | str, predicate: str, obj: Column | str, graph: Column | str | None = None) -> list[Column]:
    """Columns of an inferred triple."""
    s, o = (F.col(c) if isinstance(c, str) else c for c in (subject, obj))
    g = F.lit(graph) if graph is None or isinstance(graph, str) else graph
    given = {"subject": s, "predicate": F.lit(str(predicate)), "object": o, "graph": g.cast("string")}
    return [
        (given[f.name] if f.name in given else F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in TRIPLE_SCHEMA
    ]
