"""Class and property hierarchies, and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.model import RDFS, inferred
from tripleframe.operators.closure import closure
from tripleframe.runtime import cut
from tripleframe.store import TripleStore


def hierarchy(df: DataFrame, predicate: str, transitive: bool = False) -> DataFrame:
    """Inferred triples of subClassOf or subPropertyOf.

    Every stored copy of each pair, and for each distinct pair one triple in graph "inferred" for each triple of the same
    subject with another object. No pair is new; `transitive` adds those that only a longer path joins.
    """
    e = df.where(F.col("predicate") == predicate)
    pair = e.select(F.col("subject").alias("s"), F.col("object").alias("sup")).distinct()
    again = pair.join(e.select("subject", "object"), (F.col("s") == F.col("subject")) & (F.col("object") != F.col("sup"))).select(*inferred("s", predicate, "sup", "inferred"))
    out = e.unionByName(again)
    if transitive:
        far = closure(e.select(F.col("subject").alias("src"), F.col("object").alias("dst"))).join(pair, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("sup")), "left_anti")
        out = out.unionByName(far.select(*inferred("src", predicate, "dst", "inferred")))
    return out


def k_hops(df: DataFrame, entity: str, hops: int, more: DataFrame | None = None) -> DataFrame:
    """Triples around `entity`: for each node within hops - 1 steps, its outgoing and incoming triples (and those of
    `more`), so a triple between two such nodes is there twice, as is a loop. Steps go both ways."""
    def touching(t: DataFrame) -> DataFrame:
        return t.withColumn("node", F.explode(F.array("subject", "object")))

    touch = touching(df)
    if more is not None:
        # an inferred triple is reported once for each of its ends that is visited
        touch = touch.unionByName(touching(more).dropDuplicates(["subject", "predicate", "object", "graph", "node", "pos"]))
    both = df.unionByName(more) if more is not None else df
    links = both.select(F.col("subject").alias("a"), F.col("object").alias("b")).where("a <> b").distinct()
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = frontier = df.sparkSession.createDataFrame([(entity,)], "node string")
    for _ in range(hops - 1):
        frontier = cut(frontier.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
    return touch.join(seen, "node").drop("node")


class Reasoner:
    """Ontology and data in graphs of a store. `inferred` grows with each call of `reason`, as a plan."""

    def __init__(self, spark: SparkSession, max_hops: int = 2, transitive: bool = False):
        self.store, self.max_hops, self.transitive = TripleStore(spark), max_hops, transitive
        self.inferred: DataFrame | None = None

    def load_tbox(self, df: DataFrame) -> None:
        self.store.register("tbox", df)

    def load_abox(self, df: DataFrame) -> None:
        self.store.register("abox", df)

    def reason(self) -> DataFrame:
        t = self.store.all()
        for predicate in (RDFS.subClassOf, RDFS.subPropertyOf):
            new = hierarchy(t, predicate, self.transitive)
            self.inferred = new if self.inferred is None else self.inferred.unionByName(new)
        return self.inferred

    def inferred_of(self, subject: str) -> DataFrame:
        return (self.inferred if self.inferred is not None else self.store.all().limit(0)).where(F.col("subject") == subject)

    def find_related(self, entity: str, hops: int = 0) -> DataFrame:
        return k_hops(self.store.all(), entity, hops if hops > 0 else self.max_hops, self.inferred)
