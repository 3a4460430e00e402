"""python -m tripleframe COMMAND FILE...: validate, query, graph, site or serve vocabularies in Turtle or RDF/XML."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tripleframe.operators.graphview import GraphView
from tripleframe.operators.skos import Inference
from tripleframe.operators.validation import SEVERITIES, Validator
from tripleframe.plans.engine import Engine
from tripleframe.sinks.export import bindings_json, graph_json, report_json, report_text
from tripleframe.sinks.service import Service
from tripleframe.sinks.site import Renderer
from tripleframe.sources.reader import read_triples, read_with_imports
from tripleframe.store import TripleStore


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tripleframe", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "query", "graph", "site", "serve"):
        c = commands.add_parser(name)
        c.add_argument("files", nargs="+")
        c.add_argument("--imports", action="store_true", help="also read what the files import")
        if name == "validate":
            c.add_argument("--format", choices=("json", "text"), default="text")
            c.add_argument("--severity", choices=SEVERITIES, default="info")
            c.add_argument("--errors-only", action="store_true", help="the same as --severity error")
            c.add_argument("--quiet", action="store_true", help="totals alone")
            c.add_argument("--verbose", action="store_true", help="with confidence and context")
        if name == "query":
            c.add_argument("--query", required=True)
            c.add_argument("--inference", choices=[i.value for i in Inference], default="none")
        if name in ("site", "serve"):
            c.add_argument("--folder", default="site")
            c.add_argument("--title", default="Ontology")
        if name == "serve":
            c.add_argument("--port", type=int, default=8080)
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(args)
    spark = spark or SparkSession.builder.appName("tripleframe").getOrCreate()
    triples = read_with_imports(spark, a.files) if a.imports else read_triples(spark, a.files)
    if a.command == "validate":
        report = Validator(triples).validate().at_least("error" if a.errors_only else a.severity)
        print(report_json(report) if a.format == "json" else report_text(report, a.verbose, a.quiet))
        return int(report.issues.where("severity = 'error'").limit(1).count())
    if a.command == "query":
        store = TripleStore(spark)
        store.register("default", triples)
        for row in bindings_json(Engine(store, Inference(a.inference)).execute(a.query).bindings).toLocalIterator():
            print(row[0])
    elif a.command == "graph":
        print(graph_json(GraphView(triples)).first()[0])
    else:
        print("\n".join(Renderer(triples, a.title).render(a.folder)))
        if a.command == "serve":
            Service(spark, triples).serve(a.folder, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
