"""Rules over a vocabulary's statements, with where each fact comes from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.model import FACT_SCHEMA, INCONSISTENCY_SCHEMA, PROVENANCE, SKOS
from tripleframe.operators.hierarchy import Hierarchy
from tripleframe.operators.skos import targets


@dataclass
class Context:
    """`statements` as of sources.statements: subject, predicate, object, file, pos, end, line, col."""

    statements: DataFrame
    hierarchy: Hierarchy
    #: beyond so many pairs transitive_exact_match raises
    max_pairs: int | None = None


Rule = Callable[[Context], tuple[DataFrame | None, DataFrame | None]]


def provenance() -> Column:
    return F.struct(F.col("file").alias("source_file"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("column"), F.col("pos").cast("int").alias("start_pos"), F.col("end").cast("int").alias("end_pos"))


def nowhere() -> Column:
    return F.lit(None).cast(PROVENANCE)


def _fact(s: str, p: str | None, o: str, derived: bool, where: Column) -> list[Column]:
    return [F.col(s).alias("subject"), F.lit(str(p)).alias("predicate"), F.col(o).alias("object"), F.lit(derived).alias("derived"), where.alias("provenance")]


def _source(c: Context, predicate: str) -> DataFrame:
    return c.statements.where((F.col("predicate") == predicate) & (F.col("object") != ""))


def _transitive(predicate: str, output: str, up: bool) -> Rule:
    def rule(c: Context):
        e = _source(c, predicate)
        reach = c.hierarchy.ancestors.select(F.col("src" if up else "dst").alias("a"), F.col("dst" if up else "src").alias("far")).where("a <> far")
        derived = e.join(reach, F.col("object") == F.col("a")).select(*_fact("subject", output, "far", True, provenance()))
        return e.select(*_fact("subject", predicate, "object", False, provenance())).unionByName(derived), None

    return rule


transitive_broader = _transitive(SKOS.broader, SKOS.broaderTransitive, True)
transitive_narrower = _transitive(SKOS.narrower, SKOS.narrowerTransitive, False)


def symmetric_related(c: Context):
    """The reverse of each related pair, where it is not stated."""
    e = _source(c, SKOS.related)
    pairs = e.select("subject", "object").distinct()
    back = pairs.select(F.col("object").alias("s"), F.col("subject").alias("o"))
    new = back.join(pairs, (F.col("s") == F.col("subject")) & (F.col("o") == F.col("object")), "left_anti")
    return e.select(*_fact("subject", SKOS.related, "object", False, provenance())).unionByName(new.select(*_fact("s", SKOS.related, "o", True, nowhere()))), None


def transitive_exact_match(c: Context):
    """Each target d of a match of s with every subject of a match other than s and d, both ways, as sets."""
    e = _source(c, SKOS.exactMatch)
    subjects = e.select(F.col("subject").alias("o")).distinct()
    if c.max_pairs is not None and (n := targets(e).count() * subjects.count()) > c.max_pairs:
        raise ValueError(f"exactMatch would make {n} pairs")
    pairs = targets(e).join(subjects, (F.col("o") != F.col("d")) & (F.col("many") | (F.col("o") != F.col("only"))))
    pairs = pairs.where(~F.col("d").contains("|") & ~F.col("o").contains("|")).select("d", "o")
    out = [pairs.select(*_fact(a, SKOS.exactMatch, b, True, nowhere())) for a, b in (("d", "o"), ("o", "d"))]
    return reduce(DataFrame.unionByName, [e.select(*_fact("subject", SKOS.exactMatch, "object", False, provenance())), *out]), None


def inconsistency_detector(c: Context):
    """A concept with a node both broader and narrower, at the concept's first statement; and a cycle, once."""
    found = c.hierarchy.inconsistencies()
    first = c.statements.groupBy(F.col("subject").alias("concept")).agg(F.min_by(provenance(), "pos").alias("provenance"))
    message = F.concat(F.col("concept"), F.lit(" has "), F.col("other"), F.lit(" both broader and narrower"))
    clash = found.join(first, "concept", "left").select(F.lit("broaderAndNarrower").alias("type"), message.alias("message"), "provenance")
    least = c.hierarchy.cyclic().agg(F.min("iri").alias("iri")).where("iri is not null")
    cycle = least.select(F.lit("cycle").alias("type"), F.concat(F.lit("cycle through "), F.col("iri")).alias("message"), nowhere().alias("provenance"))
    return None, clash.unionByName(cycle)


DEFAULT_RULES: dict[str, Rule] = {
    "TransitiveBroader": transitive_broader, "TransitiveNarrower": transitive_narrower, "SymmetricRelated": symmetric_related,
    "TransitiveExactMatch": transitive_exact_match, "InconsistencyDetector": inconsistency_detector,
}


class RuleEngine:
    """An ordered list of rules. A rule takes the context and returns facts and inconsistencies, either of them None."""

    def __init__(self, statements: DataFrame, source_file: str = "", max_pairs: int | None = None):
        named = statements.withColumn("file", F.when(F.coalesce(F.col("file"), F.lit("")) == "", F.lit(source_file)).otherwise(F.col("file")))
        self.context = Context(named, Hierarchy(named), max_pairs)
        self.rules = dict(DEFAULT_RULES)
        spark = statements.sparkSession
        self.facts, self.inconsistencies = spark.createDataFrame([], FACT_SCHEMA), spark.createDataFrame([], INCONSISTENCY_SCHEMA)

    def add_rule(self, name: str, rule: Rule) -> None:
        self.rules[name] = rule

    def clear_rules(self) -> None:
        self.rules.clear()

    def add_fact(self, rows: DataFrame) -> None:
        self.facts = self.facts.unionByName(rows)

    def add_inconsistency(self, rows: DataFrame) -> None:
        self.inconsistencies = self.inconsistencies.unionByName(rows)

    def run(self, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
        for rule in self.rules.values():
            if cancelled():
                raise InterruptedError("the rules were cancelled")
            facts, clashes = rule(self.context)
            if facts is not None:
                self.add_fact(facts)
            if clashes is not None:
                self.add_inconsistency(clashes)
        return self.facts

    def facts_with(self, subject: str = "", predicate: str = "", obj: str = "") -> DataFrame:
        df = self.facts
        for name, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
            if value:
                df = df.where(F.col(name) == value)
        return df


def shown(facts: DataFrame) -> DataFrame:
    """(text): each fact as a line, with where it comes from."""
    p = F.col("provenance")
    where = F.when(p.isNotNull(), F.format_string(" [%s:%d:%d]", p["source_file"], p["line"], p["column"])).otherwise("")
    kind = F.when(F.col("derived"), " (derived)").otherwise("")
    return facts.select(F.concat(F.col("subject"), F.lit(" "), F.col("predicate"), F.lit(" "), F.col("object"), kind, where).alias("text"))


def shown_inconsistencies(rows: DataFrame) -> DataFrame:
    """(text): each inconsistency as a line, with where it comes from."""
    p = F.col("provenance")
    where = F.when(p.isNotNull(), F.format_string(" [%s:%d:%d]", p["source_file"], p["line"], p["column"])).otherwise("")
    return rows.select(F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("message"), where).alias("text"))
