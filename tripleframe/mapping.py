"""Relational tables as virtual triples: nothing is materialised, a pattern reads only the columns it needs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.model import SKOS, TRIPLE_SCHEMA, TYPE, XSD

E = "http://example.org/"
V = E + "v/"
HOLE = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Fact:
    """One triple for each row of a table: subject and object are templates with {column} holes."""

    table: str
    subject: str
    predicate: str
    object: str
    literal: bool = False
    datatype: str | None = None
    where: str | None = None

    def select(self, table: DataFrame, graph: str) -> DataFrame:
        """Rows of which a hole's column is null have no triple: tests on columns, which the scan can push down."""
        needed = dict.fromkeys(HOLE.findall(self.subject) + HOLE.findall(self.object))
        tests = [f"{c} is not null" for c in needed] + ([f"({self.where})"] if self.where else [])
        given = {
            "subject": fill(self.subject), "predicate": text(self.predicate), "object": fill(self.object), "graph": text(graph),
            "is_literal": str(self.literal).lower(), "datatype": text(self.datatype) if self.datatype else "null", "is_triple_term": "false",
        }
        df = table.where(" and ".join(tests)) if tests else table
        # expressions as text: one call for the whole select, as plans of many facts are built for every query
        return df.selectExpr(*[f"cast({given.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in TRIPLE_SCHEMA])


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fill(template: str) -> str:
    """The template with its holes filled, as an SQL expression."""
    parts, at = [], 0
    for m in HOLE.finditer(template):
        parts += [text(template[at : m.start()])] * (m.start() > at) + [f"cast({m[1]} as string)"]
        at = m.end()
    parts += [text(template[at:])] * (at < len(template) or not parts)
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


@dataclass
class Mapping:
    """Facts over tables. `tables` gives a table's DataFrame by name."""

    facts: list[Fact]
    tables: Callable[[str], DataFrame]
    graph: str = "default"
    _read: dict[str, DataFrame] = field(default_factory=dict)
    _made: dict[str | None, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.tables(name)
        return self._read[name]

    def triples(self, predicate: str | None = None) -> DataFrame:
        """All virtual triples, or those that can have the predicate: other tables are not even planned."""
        if predicate not in self._made:
            chosen = [f for f in self.facts if predicate is None or f.predicate == predicate]
            parts = [f.select(self.table(f.table), self.graph) for f in chosen]
            self._made[predicate] = reduce(DataFrame.union, parts) if parts else self.table(self.facts[0].table).sparkSession.createDataFrame([], TRIPLE_SCHEMA)
        return self._made[predicate]


def star_facts() -> list[Fact]:
    """The star schema, events, pages and documents as a graph."""

    def literals(table: str, subject: str, columns: dict[str, str], kinds: dict[str, str] | None = None) -> Iterable[Fact]:
        return (Fact(table, subject, V + p, "{" + c + "}", True, (kinds or {}).get(p, XSD.string)) for p, c in columns.items())

    region, nation, customer, supplier = E + "region/{r_regionkey}", E + "nation/{n_nationkey}", E + "customer/{c_custkey}", E + "supplier/{s_suppkey}"
    part, order, item, event = E + "part/{p_partkey}", E + "order/{o_orderkey}", E + "li/{l_orderkey}-{l_linenumber}", E + "event/{event_id}"
    turn, doc = E + "turn/{conv_id}-{turn}", E + "doc/{doc_id}"
    numbers = {p: XSD.double for p in ("acctbal", "price", "totalprice", "value", "quantity")}
    return [
        Fact("region", region, TYPE, SKOS.ConceptScheme),
        *literals("region", region, {"name": "r_name"}),
        Fact("nation", nation, V + "inRegion", E + "region/{n_regionkey}"),
        Fact("nation", nation, SKOS.broader, E + "region/{n_regionkey}"),
        Fact("nation", nation, SKOS.inScheme, E + "region/{n_regionkey}", where="n_nationkey % 5 <> 0"),
        Fact("nation", nation, TYPE, SKOS.Concept),
        *literals("nation", nation, {"name": "n_name"}),
        Fact("nation", nation, SKOS.prefLabel, "{n_name}", True, XSD.string),
        Fact("customer", customer, V + "inNation", E + "nation/{c_nationkey}"),
        Fact("customer", customer, SKOS.broader, E + "nation/{c_nationkey}"),
        *literals("customer", customer, {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"}, numbers),
        Fact("supplier", supplier, V + "inNation", E + "nation/{s_nationkey}"),
        Fact("supplier", supplier, SKOS.related, E + "nation/{s_nationkey}"),
        *literals("supplier", supplier, {"name": "s_name", "acctbal": "s_acctbal"}, numbers),
        Fact("part", part, TYPE, SKOS.Concept),
        Fact("part", part, SKOS.prefLabel, "{p_name}", True, XSD.string),
        Fact("part", part, SKOS.altLabel, "{p_type}", True, XSD.string),
        Fact("part", part, SKOS.notation, "{p_size}", True, XSD.integer, where="p_size > 10"),
        *literals("part", part, {"brand": "p_brand", "ptype": "p_type", "size": "p_size", "price": "p_retailprice"}, numbers | {"size": XSD.integer}),
        Fact("orders", order, V + "placedBy", E + "customer/{o_custkey}"),
        *literals("orders", order, {"status": "o_orderstatus", "totalprice": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}, numbers),
        Fact("lineitem", item, V + "ofOrder", E + "order/{l_orderkey}"),
        Fact("lineitem", item, V + "ofPart", E + "part/{l_partkey}"),
        Fact("lineitem", item, V + "bySupplier", E + "supplier/{l_suppkey}"),
        *literals("lineitem", item, {"quantity": "l_quantity", "returnflag": "l_returnflag"}, numbers),
        Fact("events", event, V + "byUser", E + "customer/{user_id}"),
        *literals("events", event, {"etype": "event_type", "value": "value", "ts": "ts"}, numbers),
        Fact("conversations", turn, V + "replyTo", E + "turn/{conv_id}-{before}"),
        *literals("conversations", turn, {"role": "role"}),
        Fact("pages", "{url}", V + "page", "{page_id}", True, XSD.integer),
        *literals("documents", doc, {"lang": "lang", "source": "source"}),
        *literals("labels", doc, {"quality": "quality", "toxic": "toxic"}),
    ]


def star(spark: SparkSession, sf_dir: str, graph: str = "default") -> Mapping:
    def read(name: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "conversations":
            df = df.withColumn("before", F.when(F.col("turn") > 0, F.col("turn") - 1))
        return df

    return Mapping(star_facts(), read, graph)
