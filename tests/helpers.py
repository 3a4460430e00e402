from __future__ import annotations

from tripleframe.model import triples_of
from tripleframe.plans.engine import Engine
from tripleframe.store import TripleStore

EX = "http://ex.org/"


def store_of(spark, rows, graph="g"):
    store = TripleStore(spark)
    store.register(graph, triples_of(spark, rows))
    return store


def ask(spark, rows, text, **options):
    """Solutions as sorted lists of dicts without unbound variables."""
    engine = rows if isinstance(rows, Engine) else Engine(store_of(spark, rows), **options)
    out = [{k: v for k, v in r.asDict().items() if v is not None} for r in engine.execute(f"PREFIX : <{EX}> {text}").bindings.collect()]
    return sorted(out, key=lambda d: sorted(d.items()))
