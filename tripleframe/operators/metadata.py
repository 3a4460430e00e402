"""Classes, properties and schemes of an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.terms import is_blank, local_name
from tripleframe.model import OWL, RDF, RDFS, SKOS, TYPE

CLASSES = (RDFS.Class, OWL.Class, SKOS.Concept)
PROPERTIES = (RDF.Property, OWL.ObjectProperty, OWL.DatatypeProperty, OWL.AnnotationProperty)


def _at(c: str = "pos"):
    return F.coalesce(F.col(c), F.lit(0))


def _declared(t: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(uri, name, first, kind): where a subject is first typed, and as what."""
    typed = t.where((F.col("predicate") == TYPE) & F.col("object").isin(*map(str, kinds)) & ~is_blank(F.col("subject")))
    return typed.groupBy(F.col("subject").alias("uri")).agg(F.min(F.struct(_at().alias("pos"), F.col("object").alias("kind"))).alias("x")).select("uri", local_name(F.col("uri")).alias("name"), F.col("x.pos").alias("first"), F.col("x.kind").alias("kind"))


def _described(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """With label (the last) and description (the last definition, else the first comment), of triples after the type's."""
    own = t.where(F.col("predicate").isin(RDFS.label, RDFS.comment, SKOS.definition) & F.col("is_literal")).select(F.col("subject").alias("uri"), F.col("predicate").alias("p"), F.col("object").alias("o"), _at().alias("at"))
    own = own.join(nodes.select("uri", "first"), "uri").where("at > first").groupBy("uri").agg(
        F.max(F.when(F.col("p") == RDFS.label, F.struct("at", "o")))["o"].alias("label"),
        F.max(F.when(F.col("p") == SKOS.definition, F.struct("at", "o")))["o"].alias("definition"),
        F.min(F.when(F.col("p") == RDFS.comment, F.struct("at", "o")))["o"].alias("comment"),
    )
    return nodes.join(own, "uri", "left").select("uri", "name", "kind", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("definition", "comment", F.lit("")).alias("description"))


def _lists(t: DataFrame, nodes: DataFrame, **columns: str) -> DataFrame:
    """Each column: the objects of a predicate, in order."""
    for name, predicate in columns.items():
        own = t.where(F.col("predicate") == predicate).groupBy(F.col("subject").alias("uri")).agg(F.transform(F.array_sort(F.collect_list(F.struct(_at().alias("pos"), "object"))), lambda x: x["object"]).alias(name))
        nodes = nodes.join(own, "uri", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return nodes


def classes(t: DataFrame) -> DataFrame:
    """(uri, name, label, description, super_classes): names of the superclasses, in order."""
    out = _lists(t, _described(t, _declared(t, CLASSES)).drop("kind"), super_classes=RDFS.subClassOf)
    return out.withColumn("super_classes", F.transform("super_classes", local_name))


def properties(t: DataFrame) -> DataFrame:
    """(uri, name, label, description, is_datatype, domain, range)."""
    out = _described(t, _declared(t, PROPERTIES)).withColumn("is_datatype", F.col("kind") == OWL.DatatypeProperty).drop("kind")
    return _lists(t, out, domain=RDFS.domain, range=RDFS.range)


def schemes(t: DataFrame) -> DataFrame:
    """(uri, name, label, description, top_concepts)."""
    return _lists(t, _described(t, _declared(t, (SKOS.ConceptScheme,))).drop("kind"), top_concepts=SKOS.hasTopConcept)


def search(t: DataFrame, text: str) -> DataFrame:
    """(kind, uri, name, label) of classes and properties with the text in name or label, without regard to case."""
    both = classes(t).select(F.lit("class").alias("kind"), "uri", "name", "label").unionByName(properties(t).select(F.lit("property").alias("kind"), "uri", "name", "label"))
    needle = F.lower(F.lit(text))
    return both.where(F.contains(F.lower("name"), needle) | F.contains(F.lower("label"), needle))


def counts(t: DataFrame) -> DataFrame:
    """(what, n) of classes, properties, schemes and triples."""
    own = {"classes": _declared(t, CLASSES), "properties": _declared(t, PROPERTIES), "schemes": _declared(t, (SKOS.ConceptScheme,)), "triples": t}
    out = None
    for name, df in own.items():
        n = df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out
