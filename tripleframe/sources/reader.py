"""Files to DataFrames; a file is parsed whole by one task, as prefixes and blank nodes have its scope."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.model import DEFAULT_GRAPH, OWL, STATEMENT_SCHEMA, TRIPLE_SCHEMA, arrow_rows, triples
from tripleframe.sources import rdfxml, turtle
from tripleframe.sources.turtle import ParseError

#: from a text and where it is from
PARSERS: dict[str, Callable[[str, str], list[dict]]] = {"turtle": turtle.parse_triples, "rdfxml": rdfxml.parse_triples}


def register_parser(name: str, parse: Callable[[str], list[dict]]) -> None:
    """Another format: a function from a text to rows of TRIPLE_SCHEMA."""
    PARSERS[name] = lambda text, source: parse(text)


def detect_format(text: str) -> str:
    """By the first ten lines: directives of Turtle, or the heads of RDF/XML."""
    for line in text.split("\n")[:10]:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if re.match(r"@?(prefix|base)\s", line, re.IGNORECASE):
            return "turtle"
        if line.startswith(("<?xml", "<rdf:RDF", "<rdf:Description")):
            return "rdfxml"
    raise ParseError("neither Turtle nor RDF/XML")


def parse_text(text: str, kind: str = "auto", source: str = "") -> list[dict]:
    return PARSERS[detect_format(text) if kind == "auto" else kind](text, source)


def _plain(path: str) -> str:
    """A local path without its scheme, an address as it is."""
    return re.sub(r"^file:/*", "/", unquote(path)) if path.startswith("file:") else path if "://" in path else os.path.abspath(path)


def numbered(files: list[str], paths: list[str]) -> dict[str, int]:
    """The files' numbers: in the order of the paths that they are, or are in; those of one folder or pattern by name."""
    given = [_plain(p) for p in paths]

    def key(file: str) -> tuple[int, str]:
        own = _plain(file)
        for i, p in enumerate(given):
            if own == p or own.startswith(p.rstrip("/") + "/") or fnmatch.fnmatch(own, p) or fnmatch.fnmatch(own, p.rstrip("/") + "/*"):
                return i, own
        return len(given), own

    return {f: i for i, f in enumerate(sorted(set(files), key=key))}


def texts(spark: SparkSession, paths: str | list[str], first: int = 0) -> DataFrame:
    """(file, nr, text): whole files, numbered from `first` on in the order given, a folder's by name."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files")
    df = spark.read.text(paths, wholetext=True)
    order = numbered(df.inputFiles(), paths)
    numbers = spark.createDataFrame([(f, first + i) for f, i in order.items()], "file string, nr long")
    return df.select(F.input_file_name().alias("file"), F.col("value").alias("text")).join(numbers, "file").select("file", "nr", "text")


def _parsing(frames: DataFrame, schema: T.StructType, parse: Callable[[str, str], list[dict]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, nr, text in zip(*(batch.column(c).to_pylist() for c in ("file", "nr", "text"))):
                rows = parse(text, file)
                if "seq" not in schema.names:
                    rows = [r | {"pos": r["pos"] + (nr << 32)} for r in rows]
                yield arrow_rows(rows, schema)

    return frames.mapInArrow(run, schema)


def read_triples(spark: SparkSession, paths: str | list[str], graph: str = DEFAULT_GRAPH, kind: str = "auto", first: int = 0) -> DataFrame:
    """Triples of Turtle or RDF/XML files; `pos` orders them by file (see texts), then place."""
    parser = PARSERS.get(kind)
    if kind != "auto" and parser is None:
        raise ValueError(f"no format {kind!r}")
    parse = parser or (lambda text, file: parse_text(text, "auto", file))
    return triples(_parsing(texts(spark, paths, first), TRIPLE_SCHEMA, parse), graph)


def read_statements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Statements of Turtle files, with the bytes, lines and columns where they are."""
    return _parsing(texts(spark, paths), STATEMENT_SCHEMA, turtle.parse_statements)


def triples_of_text(spark: SparkSession, text: str, graph: str = DEFAULT_GRAPH, kind: str = "auto") -> DataFrame:
    return triples(spark.createDataFrame([tuple(r.get(f.name) for f in TRIPLE_SCHEMA) for r in ({"graph": graph, **x} for x in parse_text(text, kind))], TRIPLE_SCHEMA), graph)


def statements_of_text(spark: SparkSession, text: str, file: str = "") -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in STATEMENT_SCHEMA) for r in turtle.parse_statements(text, file)], STATEMENT_SCHEMA)


def read_with_imports(spark: SparkSession, paths: str | list[str], graph: str = DEFAULT_GRAPH, missing: str = "error") -> DataFrame:
    """Local files and those they import, directly or not, each once. Addresses on the web are left alone.

    A link without a scheme is relative to the folder of the file that it is in. One that leads to no file is an error,
    or passed over with missing="skip".
    """
    if missing not in ("error", "skip"):
        raise ValueError("missing is error or skip")
    seen, parts = [], []
    frontier = list(dict.fromkeys(os.path.abspath(p) for p in ([paths] if isinstance(paths, str) else paths)))
    while frontier:
        df = read_triples(spark, frontier, graph, first=len(seen))
        parts.append(df)
        nr = numbered(frontier, frontier)
        by = {len(seen) + i: f for f, i in nr.items()}
        seen += frontier
        said = df.where((F.col("predicate") == OWL.imports) & ~F.col("is_literal") & ~F.col("object").rlike("^https?://"))
        frontier = []
        for k, link in sorted(map(tuple, said.select(F.shiftright("pos", 32), "object").distinct().collect())):
            file = _plain(link) if link.startswith("file:") else os.path.normpath(os.path.join(os.path.dirname(by[k]), link))
            if os.path.isfile(file):
                frontier += [file] * (file not in seen and file not in frontier)
            elif missing == "error":
                raise FileNotFoundError(f"{by[k]} imports {link}, which is no file")
    return reduce(DataFrame.unionByName, parts)
