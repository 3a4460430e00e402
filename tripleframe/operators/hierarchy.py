"""The SKOS hierarchy of a vocabulary, as edges and nodes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.model import SKOS, TYPE
from tripleframe.operators.closure import closure, core, reach

KINDS = {SKOS.Concept: "concept", SKOS.ConceptScheme: "scheme", SKOS.Collection: "collection", SKOS.OrderedCollection: "ordered"}


class Hierarchy:
    """Built of statements (subject, predicate, object, pos, seq). Labels, notations and scheme facts only count where the
    subject was declared by an earlier statement; edges always do."""

    def __init__(self, statements: DataFrame):
        self.statements = statements

    @cached_property
    def nodes(self) -> DataFrame:
        """(iri, kind, at): where each node is declared first, by position and number."""
        kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
        typed = self.statements.where((F.col("predicate") == TYPE) & F.col("object").isin(*KINDS))
        return typed.groupBy(F.col("subject").alias("iri"), kind[F.col("object")].alias("kind")).agg(F.min(F.struct("pos", "seq")).alias("at"))

    def _pairs(self, *predicates: str) -> DataFrame:
        return self.statements.where(F.col("predicate").isin(*predicates) & (F.col("object") != "")).select(F.col("subject").alias("src"), F.col("object").alias("dst"), "pos")

    @cached_property
    def broader(self) -> DataFrame:
        """(src, dst, pos), a bag: stated broader and reversed narrower."""
        return self._pairs(SKOS.broader).unionByName(self._pairs(SKOS.narrower).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pos"))

    @cached_property
    def narrower(self) -> DataFrame:
        return self.broader.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pos")

    @cached_property
    def related(self) -> DataFrame:
        e = self._pairs(SKOS.related)
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pos"))

    @cached_property
    def ancestors(self) -> DataFrame:
        """(src, dst): all that is broader, over any number of steps; a node on a cycle is its own ancestor."""
        return closure(self.broader.select("src", "dst"))

    def matches(self, predicate: str) -> DataFrame:
        return self._pairs(predicate)

    def node(self, iri: str) -> DataFrame:
        """(kind, predicate, value): a node's kind and the facts that count; no rows if it is not declared."""
        kind = self.nodes.where(F.col("iri") == iri).groupBy("iri").agg(F.min_by("kind", "at").alias("kind"), F.min("at").alias("at"))
        own = self.statements.where(F.col("subject") == iri).select("subject", "predicate", F.col("object").alias("value"), F.struct("pos", "seq").alias("said"))
        return kind.join(own, (F.col("iri") == F.col("subject")) & (F.col("at") <= F.col("said"))).select("kind", "predicate", "value")

    def shown(self) -> DataFrame:
        """(text): each node as a line: its kind, its address, its preferred labels, and how many nodes are broader."""
        label = self.facts(SKOS.prefLabel).groupBy("iri").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("labels"))
        up = self.broader.groupBy(F.col("src").alias("iri")).agg(F.countDistinct("dst").alias("n"))
        kind = self.nodes.groupBy("iri").agg(F.min_by("kind", "at").alias("kind"))
        said = F.concat(F.col("kind"), F.lit(" "), F.col("iri"), F.coalesce(F.concat(F.lit(" \""), F.col("labels"), F.lit("\"")), F.lit("")))
        return kind.join(label, "iri", "left").join(up, "iri", "left").select(F.concat(said, F.coalesce(F.concat(F.lit(" < "), F.col("n").cast("string")), F.lit(""))).alias("text"))

    def adding(self, statements: DataFrame) -> Hierarchy:
        """The hierarchy of these statements as well."""
        return Hierarchy(self.statements.unionByName(statements))

    def facts(self, predicate: str) -> DataFrame:
        """(iri, value): of nodes that were declared earlier."""
        own = self.statements.where(F.col("predicate") == predicate).select(F.col("subject").alias("s"), F.col("object").alias("value"), F.struct("pos", "seq").alias("said"))
        first = self.nodes.groupBy("iri").agg(F.min("at").alias("at"))
        return own.join(first, (F.col("s") == F.col("iri")) & (F.col("at") < F.col("said"))).select("iri", "value")

    def all_broader(self, iri: str) -> DataFrame:
        return reach(self.broader, iri).where(F.col("node") != iri).select(F.col("node").alias("iri"))

    def all_narrower(self, iri: str) -> DataFrame:
        return reach(self.narrower, iri).where(F.col("node") != iri).select(F.col("node").alias("iri"))

    def cyclic(self) -> DataFrame:
        """Nodes on cycles; pairs are only made of edges that can be on one."""
        return closure(core(self.broader)).where("src = dst").select(F.col("src").alias("iri"))

    def has_cycle(self) -> tuple[bool, str]:
        """With the least node on a cycle."""
        first = self.cyclic().agg(F.min("iri")).first()[0]
        return first is not None, "" if first is None else f"cycle through {first}"

    def inconsistencies(self) -> DataFrame:
        """(concept, other), once for each narrower entry: `other` is both narrower and broader than `concept`."""
        up = self.broader.select("src", "dst").distinct()
        down = self.narrower.select(F.col("src").alias("concept"), F.col("dst").alias("other"))
        return down.join(up, (F.col("concept") == F.col("src")) & (F.col("other") == F.col("dst")), "left_semi")

    def concepts_in_scheme(self, scheme: str) -> DataFrame:
        concepts = self.nodes.where("kind = 'concept'").select("iri").distinct()
        return self.facts(SKOS.inScheme).where(F.col("value") == scheme).select("iri").distinct().join(concepts, "iri", "left_semi")

    def top_concepts(self, scheme: str) -> DataFrame:
        """One for each hasTopConcept of a declared scheme, where the concept says topConceptOf as well."""
        said = self.facts(SKOS.hasTopConcept).where(F.col("iri") == scheme).select(F.col("value").alias("top"))
        back = self.facts(SKOS.topConceptOf).where(F.col("value") == scheme).select(F.col("iri").alias("top")).distinct()
        return said.join(back, "top", "left_semi").select(F.col("top").alias("iri"))

    def walk(self, order: str = "pre", depth: int | None = None) -> Iterator[tuple[str, str, int]]:
        """(kind, iri, depth) of each node and what it leads to: a concept to broader ones, a scheme to its top concepts,
        a collection to its members. For the driver; cycles are refused, as are paths of more than `depth` steps."""
        if order not in ("pre", "post"):
            raise ValueError("order is pre or post")
        if self.has_cycle()[0]:
            raise ValueError("a hierarchy with a cycle cannot be walked")
        nodes = sorted((r.kind, r.iri) for r in self.nodes.collect())
        kinds = {iri: kind for kind, iri in nodes}
        parts = [self.broader.select("src", "dst"), self._pairs(SKOS.hasTopConcept).select("src", "dst"), self._pairs(SKOS.member).select("src", "dst")]
        down: dict[str, list[str]] = {}
        for src, dst in sorted(map(tuple, reduce(DataFrame.unionByName, parts).distinct().collect())):
            down.setdefault(src, []).append(dst)

        for _, root in nodes:
            todo = [(root, 0, False)]
            while todo:
                iri, at, done = todo.pop()
                if depth is not None and at > depth:
                    raise ValueError(f"{iri} is more than {depth} steps from {root}")
                own = (kinds.get(iri, "concept"), iri, at)
                if done or order == "pre":
                    yield own
                if not done:
                    todo += [(iri, at, True)] * (order == "post")
                    todo += [(child, at + 1, False) for child in reversed(down.get(iri, ()))]
