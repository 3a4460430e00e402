"""JSON and text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.operators.graphview import GraphView
from tripleframe.operators.validation import Report


def bindings_json(df: DataFrame) -> DataFrame:
    """(json): an object for each solution, unbound variables left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def graph_json(g: GraphView) -> DataFrame:
    """(json): one object of nodes, edges, namespaces, types and predicates."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        item = F.struct(*df.columns) if len(df.columns) > 1 else F.col(df.columns[0])
        return df.agg(F.array_sort(F.collect_list(item)).alias(name))

    out = listed(g.nodes, "nodes").crossJoin(listed(g.edges, "edges")).crossJoin(listed(g.namespaces(), "namespaces"))
    out = out.crossJoin(listed(g.types(), "types")).crossJoin(listed(g.predicates(), "predicates"))
    return out.select(F.to_json(F.struct("*")).alias("json"))


def graph_parts(g: GraphView) -> Iterator[str]:
    """The text of graph_json in parts: a node or edge at a time is in memory."""
    lists = {"nodes": g.nodes.toJSON, "edges": g.edges.toJSON, "namespaces": g.namespaces, "types": g.types, "predicates": g.predicates}
    for i, (name, rows) in enumerate(lists.items()):
        yield f"{',' if i else '{'}{json.dumps(name)}:["
        for k, row in enumerate(rows().toLocalIterator()):
            yield f"{',' if k else ''}{row if i < 2 else json.dumps(row[0], ensure_ascii=False)}"
        yield "]"
    yield "}"


def graph_lines(g: GraphView) -> DataFrame:
    """(kind, json): an object for each node and each edge, for graphs of any size."""
    rows = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("json")) for kind, df in (("node", g.nodes), ("edge", g.edges))]
    return rows[0].unionByName(rows[1])


def report_json(report: Report) -> str:
    issues = [json.loads(x) for x in report.ordered().toJSON().collect()]
    return json.dumps({"total_concepts": report.total_concepts, "total_schemes": report.total_schemes, "issues": issues, "stats": {r["type"]: r["n"] for r in report.stats().collect()}}, ensure_ascii=False)


def report_text(report: Report, verbose: bool = False, quiet: bool = False) -> str:
    """A line for each issue; `verbose` adds confidence and context, `quiet` leaves only the totals."""
    rows = report.ordered().collect()
    lines = [f"Concepts: {report.total_concepts}", f"Schemes: {report.total_schemes}", f"Issues: {len(rows)}"]
    for r in rows if not quiet else ():
        lines.append(f"[{r.severity}] {r.type}: {r.subject}: {r.message}")
        if verbose:
            lines += [f"    confidence: {r.confidence:g}", *(f"    {k}: {v}" for k, v in sorted((r.context or {}).items()))]
    return "\n".join(lines) + "\n"
