"""Nodes and edges of a vocabulary, for drawing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.terms import local_name, namespace
from tripleframe.model import OWL, RDF, RDFS, SKOS, TYPE

NODE_TYPES = {
    OWL.Class: "class", RDFS.Class: "class", OWL.ObjectProperty: "property", OWL.DatatypeProperty: "property", RDF.Property: "property",
    SKOS.Concept: "concept", SKOS.ConceptScheme: "scheme",
}
EDGE_TYPES = {
    RDFS.subClassOf: ("subClassOf", "hierarchy"), RDFS.subPropertyOf: ("subPropertyOf", "hierarchy"), RDFS.domain: ("domain", "property"),
    RDFS.range: ("range", "property"), OWL.equivalentClass: ("equivalentClass", "equivalence"), OWL.inverseOf: ("inverseOf", "property"),
    SKOS.broader: ("broader", "hierarchy"), SKOS.narrower: ("narrower", "hierarchy"), SKOS.related: ("related", "association"),
    SKOS.inScheme: ("inScheme", "membership"), SKOS.hasTopConcept: ("hasTopConcept", "membership"),
}
SITE_EDGES = {p: x for p, x in EDGE_TYPES.items() if not p.startswith(SKOS)} | {OWL.disjointWith: ("disjointWith", "equivalence"), TYPE: ("type", "type")}


def _of(table: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (str(k), v)])[c]


@dataclass
class GraphView:
    """`site`: the variant for pages, with rdf:type edges, without SKOS, nodes of typed subjects and of edges' objects."""

    triples: DataFrame
    site: bool = False

    @property
    def kinds(self) -> dict[str, tuple[str, str]]:
        return SITE_EDGES if self.site else EDGE_TYPES

    @cached_property
    def edges(self) -> DataFrame:
        """(source, target, predicate, label, namespace, type); literals have none."""
        p = F.col("predicate")
        return self.triples.where(p.isin(*map(str, self.kinds)) & ~F.col("is_literal")).select(
            F.col("subject").alias("source"), F.col("object").alias("target"), p, _of({k: v[0] for k, v in self.kinds.items()}, p).alias("label"),
            namespace(p).alias("namespace"), _of({k: v[1] for k, v in self.kinds.items()}, p).alias("type"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """(id, label, namespace, type, comment), one a node; of several types, labels or comments the last holds."""
        t = self.triples
        relevant = F.col("predicate").isin(*map(str, self.kinds), str(TYPE))
        starts = F.col("predicate") == TYPE if self.site else relevant
        kind = F.when(F.col("predicate") == TYPE, _of(NODE_TYPES, F.col("object")))
        # max_by skips nothing, so rows without a type are told apart by their order
        own = t.where(starts).groupBy(F.col("subject").alias("id")).agg(F.max(F.when(kind.isNotNull(), F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), kind.alias("k"))))["k"].alias("type"))
        ends = t.where(relevant & ~F.col("is_literal") & ~F.startswith("object", F.lit("http://www.w3.org/"))).select(F.col("object").alias("id")).distinct()
        ends = ends.join(own, "id", "left_anti").select("id", F.lit("resource").alias("type"))
        nodes = own.select("id", F.coalesce("type", F.lit("")).alias("type")).unionByName(ends)
        said = t.where(F.col("predicate").isin(RDFS.label, RDFS.comment) & F.col("is_literal")).groupBy(F.col("subject").alias("s")).agg(
            *[F.max(F.when(F.col("predicate") == p, F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "object")))["object"].alias(n) for p, n in ((RDFS.label, "said"), (RDFS.comment, "comment"))]
        )
        return nodes.join(said, F.col("id") == F.col("s"), "left").select("id", F.coalesce("said", local_name(F.col("id"))).alias("label"), namespace(F.col("id")).alias("namespace"), "type", F.coalesce("comment", F.lit("")).alias("comment"))

    def namespaces(self) -> DataFrame:
        return self.nodes.select("namespace").distinct().orderBy("namespace")

    def types(self) -> DataFrame:
        return self.nodes.select("type").distinct().orderBy("type")

    def predicates(self) -> DataFrame:
        return self.edges.select("predicate").distinct().orderBy("predicate")

    def filtered(self, node_type: str = "", in_namespace: str = "", search: str = "") -> DataFrame:
        """Nodes of a type, of a namespace, and with a text in their labels."""
        df = self.nodes
        if node_type:
            df = df.where(F.col("type") == node_type)
        if in_namespace:
            df = df.where(F.col("namespace") == in_namespace)
        return df.where(F.contains(F.lower("label"), F.lower(F.lit(search)))) if search else df
