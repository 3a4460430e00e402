"""Queries over a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.operators.skos import Authority, Inference, branches
from tripleframe.plans.compiler import Compiler
from tripleframe.plans.ir import Iri, Select
from tripleframe.plans.parser import parse
from tripleframe.store import Store


@dataclass
class QueryResult:
    """Lazy: `bindings` has a string column for each variable, null where unbound; `triples` those that matched."""

    bindings: DataFrame
    triples: DataFrame | None = None

    def path(self) -> list[str]:
        """The terms of the matched triples, one after another."""
        return [x for row in (self.triples.orderBy("step", "subject", "predicate", "object").select("subject", "predicate", "object").collect() if self.triples is not None else []) for x in row]


class Engine:
    """SELECT queries, with inference on demand.

    Inference rules whose output no pattern can match are not run: a fixpoint is only started for a query that sees it.
    `max_pairs` raises before a quadratic rule (exactMatch, matching by host) makes more pairs.
    """

    def __init__(self, store: Store, inference: Inference = Inference.NONE, authority: Authority = Authority.NONE, optional: str = "progressive", max_pairs: int | None = None):
        self.functions: dict[str, Callable[..., Column]] = {}
        self.store, self.inference, self.authority, self.optional, self.max_pairs = store, inference, authority, optional, max_pairs

    def set(self, **options) -> Engine:
        """Change inference, authority, optional or max_pairs; returns the engine."""
        for name, value in options.items():
            if name not in ("inference", "authority", "optional", "max_pairs"):
                raise TypeError(f"no option {name}")
            setattr(self, name, value)
        return self

    def register_function(self, name: str, function: Callable[..., Column]) -> None:
        """A function for filters, of string columns to a column. As a condition it holds unless it is false, "" or null."""
        self.functions[name.lower()] = function

    def execute(self, text: str, trace: bool = False) -> QueryResult:
        return self.execute_parsed(parse(text, self.functions), trace)

    def execute_parsed(self, q: Select, trace: bool = False) -> QueryResult:
        scan = self._scan()
        out = Compiler(self.store.spark, scan, self.optional, self.functions).select(q)
        return QueryResult(out, self._trace(q, scan) if trace else None)

    def explain(self, text: str) -> str:
        return self.execute(text).bindings._jdf.queryExecution().toString()

    def _scan(self):
        rules = branches(self.inference, self.authority, self.max_pairs)
        if not rules:
            return self.store.all
        done: dict[int, DataFrame] = {}

        def scan(predicate: str | None) -> DataFrame:
            parts = [self.store.all(predicate)]
            for i, (output, rule) in enumerate(rules):
                if predicate is None or output == predicate:
                    if i not in done:
                        done[i] = rule(self.store.all())
                    parts.append(done[i])
            return reduce(DataFrame.unionByName, parts)

        return scan

    def _trace(self, q: Select, scan) -> DataFrame:
        """Distinct triples that matched the k-th pattern together with the patterns before it, whatever later ones did."""
        compiler, parts = Compiler(self.store.spark, scan), []
        groups = [q.where, *(b for u in q.where.unions for b in u)]
        step = 0
        for g in groups:
            before = None
            for p in g.patterns:
                rows = compiler.pattern(p)
                both = rows if before is None else compiler.join(before, rows)
                names = [both.names[t.name] if not isinstance(t, Iri) and hasattr(t, "name") else None for t in (p.subject, p.predicate, p.object)]
                parts.append(both.df.select(
                    F.lit(step).alias("step"),
                    *[(F.col(n) if n else F.lit(t.value)).alias(c) for n, t, c in zip(names, (p.subject, p.predicate, p.object), ("subject", "predicate", "object"))],
                ))
                before, step = both, step + 1
        if not parts:
            return self.store.spark.createDataFrame([], "step int, subject string, predicate string, object string")
        return reduce(DataFrame.unionByName, parts).groupBy("subject", "predicate", "object").agg(F.min("step").alias("step"))
