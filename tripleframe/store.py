"""Named graphs of triples."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.mapping import Mapping
from tripleframe.model import TRIPLE_SCHEMA, triples


class Store(Protocol):
    """What the engine asks of a store."""

    spark: SparkSession

    def all(self, predicate: str | None = None) -> DataFrame: ...


class TripleStore:
    """A graph is a DataFrame of triples or a Mapping; the store only holds plans. Bags: nothing is deduplicated."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graphs: dict[str, DataFrame | Mapping] = {}

    def register(self, name: str, graph: DataFrame | Mapping) -> None:
        """Adds or replaces a graph; its triples get the graph's name."""
        if not name:
            raise ValueError("a graph needs a name")
        if isinstance(graph, Mapping):
            graph = Mapping(graph.facts, graph.tables, name)
        self.graphs[name] = graph if isinstance(graph, Mapping) else triples(graph, name)

    def remove(self, name: str) -> None:
        if name not in self.graphs:
            raise KeyError(f"no graph {name!r}")
        del self.graphs[name]

    def list(self) -> list[str]:
        return sorted(self.graphs)

    def all(self, predicate: str | None = None) -> DataFrame:
        """All triples; those of mappings can be narrowed to a predicate before planning."""
        parts = [g.triples(predicate) if isinstance(g, Mapping) else g for _, g in sorted(self.graphs.items())]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], TRIPLE_SCHEMA)

    def match(self, subject: str = "", predicate: str = "", obj: str = "") -> DataFrame:
        """Triples with the given terms; "" is any."""
        df = self.all(predicate or None)
        for name, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
            if value:
                df = df.where(F.col(name) == value)
        return df

    def save(self, path: str) -> None:
        """One folder a graph and predicate, so that a pattern reads only its predicate's files."""
        self.all().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph", "predicate").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TripleStore:
        store, df = cls(spark), spark.read.option("basePath", path).parquet(path)
        for (name,) in df.select("graph").distinct().collect():
            store.register(name, df.where(F.col("graph") == name))
        return store
