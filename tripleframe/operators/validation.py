"""SKOS quality checks: each is a DataFrame of issues."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.terms import is_uri, label_language, normal_label
from tripleframe.model import SKOS, TYPE
from tripleframe.operators.closure import closure, core, reaches
from tripleframe.runtime import cut

SEVERITIES = ("info", "warning", "error")


def _issue(kind: str, severity: str, confidence: float, message: Column, context: dict[str, Column] | None = None) -> list[Column]:
    entries = [x for k, v in (context or {}).items() for x in (F.lit(k), v)]
    return [
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col("subject"), message.alias("message"),
        (F.create_map(*entries) if entries else F.lit(None).cast("map<string,string>")).alias("context"), F.lit(confidence).alias("confidence"),
    ]


@dataclass
class Report:
    issues: DataFrame
    total_concepts: int
    total_schemes: int

    def stats(self) -> DataFrame:
        return self.issues.groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def at_least(self, severity: str) -> Report:
        """Only issues of that severity or a graver one."""
        if severity not in SEVERITIES:
            raise ValueError(f"severity is one of {', '.join(SEVERITIES)}")
        return Report(self.issues.where(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(severity) :])), self.total_concepts, self.total_schemes)

    def ordered(self) -> DataFrame:
        rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
        return self.issues.orderBy(rank, "type", "subject", "message")


#: what the checks look at
LOOKED_AT = (TYPE, SKOS.prefLabel, SKOS.altLabel, SKOS.notation, SKOS.inScheme, SKOS.hasTopConcept, SKOS.broader, SKOS.narrower, SKOS.exactMatch, SKOS.closeMatch)
#: of nodes without a fact: kind of node, predicate, severity, confidence, message
LACKING = {
    "missing_preferred_label": ("concept", SKOS.prefLabel, "warning", 1.0, "concept has no preferred label"),
    "missing_notation": ("concept", SKOS.notation, "info", 0.5, "concept has no notation"),
    "orphan_concept": ("concept", SKOS.inScheme, "warning", 0.8, "concept is in no scheme"),
    "missing_top_concept": ("scheme", SKOS.hasTopConcept, "info", 0.7, "scheme has no top concept"),
}


class Validator:
    """Ten checks. The triples they look at are taken out once, into the shared folder; what a node lacks is told by one
    aggregation over subjects."""

    def __init__(self, triples: DataFrame):
        self.given = triples

    @cached_property
    def triples(self) -> DataFrame:
        return cut(self.given.where(F.col("predicate").isin(*LOOKED_AT)).select("subject", "predicate", "object"))

    def having(self, predicate: str) -> DataFrame:
        return self.triples.where(F.col("predicate") == predicate).select("subject", "object")

    @cached_property
    def nodes(self) -> DataFrame:
        """(subject, concept, scheme, has): what each typed subject is, and of which predicates it has a fact."""
        said = lambda *kinds: F.max((F.col("predicate") == TYPE) & F.col("object").isin(*kinds))
        has = [F.max(F.col("predicate") == p).alias(c) for c, (_, p, *_) in LACKING.items()]
        flags = self.triples.groupBy("subject").agg(said(SKOS.Concept, SKOS.Collection).alias("concept"), said(SKOS.ConceptScheme).alias("scheme"), *has)
        return cut(flags.where("concept or scheme"))

    @cached_property
    def concepts(self) -> DataFrame:
        """Subjects typed Concept or Collection."""
        return self.nodes.where("concept").select("subject")

    @cached_property
    def schemes(self) -> DataFrame:
        return self.nodes.where("scheme").select("subject")

    @cached_property
    def above(self) -> DataFrame:
        """(src, dst): what is broader than the objects of narrower, over any number of steps."""
        broader = self.having(SKOS.broader).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
        return reaches(broader, self.having(SKOS.narrower).select(F.col("object").alias("src")))

    def lacking(self, *kinds: str) -> DataFrame:
        """Issues of nodes without a fact, all kinds in one scan."""
        every = [
            F.when(F.col(node) & ~F.col(kind), F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(confidence).alias("confidence")))
            for kind, (node, _, severity, confidence, message) in LACKING.items() if kind in kinds
        ]
        found = self.nodes.select("subject", F.explode(F.array_compact(F.array(*every))).alias("x"))
        return found.select("x.type", "x.severity", "subject", "x.message", F.lit(None).cast("map<string,string>").alias("context"), "x.confidence")

    def missing_preferred_label(self) -> DataFrame:
        return self.lacking("missing_preferred_label")

    def missing_notation(self) -> DataFrame:
        return self.lacking("missing_notation")

    def orphan_concept(self) -> DataFrame:
        return self.lacking("orphan_concept")

    def missing_top_concept(self) -> DataFrame:
        return self.lacking("missing_top_concept")

    def multiple_preferred_labels(self) -> DataFrame:
        label = self.having(SKOS.prefLabel).select("subject", label_language(F.col("object")).alias("language"))
        twice = label.groupBy("subject", "language").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("subject").agg(F.min("language").alias("language"))
        return twice.join(self.concepts, "subject", "left_semi").select(*_issue("multiple_preferred_labels", "warning", 1.0, F.concat(F.lit("several preferred labels in language '"), F.col("language"), F.lit("'")), {"language": F.col("language")}))

    def overlapping_labels(self) -> DataFrame:
        one = self.having(SKOS.prefLabel).select("subject", normal_label(F.col("object")).alias("label")).distinct()
        two = self.having(SKOS.altLabel).select("subject", normal_label(F.col("object")).alias("label")).distinct()
        both = one.join(two, ["subject", "label"]).groupBy("subject").agg(F.min("label").alias("label"))
        return both.join(self.concepts, "subject", "left_semi").select(*_issue("overlapping_labels", "warning", 0.9, F.concat(F.lit("preferred and alternative label are both '"), F.col("label"), F.lit("'")), {"label": F.col("label")}))

    def circular_broader_relation(self) -> DataFrame:
        broader = self.having(SKOS.broader).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
        loop = closure(core(broader)).where("src = dst").select(F.col("src").alias("subject"))
        return loop.join(self.concepts, "subject", "left_semi").select(*_issue("circular_broader_relation", "error", 1.0, F.lit("concept is broader than itself")))

    def inconsistent_hierarchy(self) -> DataFrame:
        """A stated narrower concept from which broader leads back: flagged, although it is the plain inverse."""
        down = self.having(SKOS.narrower).select("subject", F.col("object").alias("n"))
        found = down.join(self.concepts, "subject", "left_semi").join(self.above, (F.col("n") == F.col("src")) & (F.col("subject") == F.col("dst")), "left_semi")
        return found.select(*_issue("inconsistent_hierarchy", "error", 1.0, F.concat(F.lit("narrower "), F.col("n"), F.lit(" leads back by broader")), {"narrower": F.col("n")}))

    def broken_link(self) -> DataFrame:
        match = self.triples.where(F.col("predicate").isin(SKOS.exactMatch, SKOS.closeMatch)).select("subject", F.col("object").alias("target"))
        known = self.concepts.select(F.col("subject").alias("target"))
        return match.where(~is_uri(F.col("target"))).join(self.concepts, "subject", "left_semi").join(known, "target", "left_anti").select(*_issue("broken_link", "warning", 0.6, F.concat(F.lit("no concept "), F.col("target"))))

    def invalid_concept_scheme(self) -> DataFrame:
        said = self.having(SKOS.inScheme).select("subject", F.col("object").alias("scheme")).join(self.concepts, "subject", "left_semi")
        return said.join(self.schemes.select(F.col("subject").alias("scheme")), "scheme", "left_anti").select(*_issue("invalid_concept_scheme", "error", 1.0, F.concat(F.lit("no scheme "), F.col("scheme")), {"scheme": F.col("scheme")}))

    CHECKS = (
        "missing_preferred_label", "multiple_preferred_labels", "overlapping_labels", "missing_notation", "orphan_concept", "missing_top_concept",
        "circular_broader_relation", "inconsistent_hierarchy", "broken_link", "invalid_concept_scheme",
    )

    def issues(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.lacking(*LACKING), *(getattr(self, c)() for c in self.CHECKS if c not in LACKING)])

    def validate(self) -> Report:
        return Report(self.issues(), self.concepts.count(), self.schemes.count())
