from __future__ import annotations

import random

import pytest

from tests.helpers import EX, ask, store_of
from tripleframe.model import OWL, RDFS, SKOS, TYPE, triples_of
from tripleframe.operators import metadata, rdfs, skos
from tripleframe.operators.closure import closure
from tripleframe.operators.graphview import GraphView
from tripleframe.operators.hierarchy import Hierarchy
from tripleframe.operators.rules import RuleEngine, shown
from tripleframe.operators.validation import Validator
from tripleframe.plans.engine import Engine
from tripleframe.sources.reader import statements_of_text
from tripleframe.store import TripleStore


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*(columns or ("subject", "object"))).collect()))


def reachable(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not new:
            return out
        out |= new


def test_closure_against_loops(spark):
    r = random.Random(3)
    for n in (0, 5, 14):
        edges = [(str(r.randrange(8)), str(r.randrange(8))) for _ in range(n)]
        df = spark.createDataFrame(edges, "src string, dst string")
        assert pairs(closure(df), "src", "dst") == sorted(reachable(set(edges)))


def test_skos_inference_against_loops(spark):
    r = random.Random(4)
    nodes = [f"http://h{i % 2}:80/{i}" for i in range(5)]
    rows = [(r.choice(nodes), p, r.choice(nodes)) for p in (SKOS.exactMatch, SKOS.closeMatch, SKOS.related, SKOS.broader) for _ in range(6)]
    df = triples_of(spark, rows)
    e = [(s, o) for s, p, o in rows if p == SKOS.exactMatch]
    ends = {x for pair in e for x in pair}
    found = {(d, o) for s, d in e for o in ends if o != s and o != d}
    assert pairs(skos.exact_match(df)) == sorted([*found, *((o, d) for d, o in found)])
    c = [(s, o) for s, p, o in rows if p == SKOS.closeMatch]
    want = c + [(o, s) for s, o in c] + [(a[0], b[0]) for i, a in enumerate(c) for j, b in enumerate(c) if i != j and a[1] == b[1]]
    assert pairs(skos.close_match(df)) == sorted(want)
    host = lambda u: u.split("/")[2]
    seen = [s for s, _, o in rows for _ in range(2 if host(s) == host(o) else 1)]
    want = [(a, b) for i, a in enumerate(seen) for j, b in enumerate(seen) if i != j and host(a) == host(b)]
    assert pairs(skos.authority_match(df)) == sorted(want)
    related = {(s, o) for s, p, o in rows if p == SKOS.related}
    assert pairs(skos.symmetric(df)) == sorted((o, s) for s, o in related)
    with pytest.raises(ValueError):
        skos.exact_match(df, max_pairs=1)
    with pytest.raises(ValueError):
        skos.authority_match(df, max_pairs=1)


def test_inference_in_queries(spark):
    rows = [(EX + "a", SKOS.broader, EX + "b"), (EX + "b", SKOS.broader, EX + "c")]
    text = f"SELECT ?x ?y WHERE {{ ?x <{SKOS.broader}> ?y }}"
    assert len(ask(spark, rows, text)) == 2
    assert len(ask(spark, rows, text, inference=skos.Inference.BROADER)) == 5
    # the inverse keeps subject and object where they are
    assert {r["y"] for r in ask(spark, rows, text.replace("broader", "narrower"), inference=skos.Inference.BROADER)} == {EX + "b", EX + "c"}
    assert skos.infer(triples_of(spark, rows), skos.Inference.NONE, skos.Authority.AUTHORITY).count() == 2
    # a query that cannot see the rules' output does not start them
    assert Engine(store_of(spark, rows), skos.Inference.ALL).execute(f"SELECT ?x WHERE {{ ?x <{EX}p> ?y }}").bindings.count() == 0


def test_closure_keeps_graphs_apart(spark):
    store = TripleStore(spark)
    store.register("g1", triples_of(spark, [(EX + "a", SKOS.broader, EX + "b")]))
    store.register("g2", triples_of(spark, [(EX + "b", SKOS.broader, EX + "c")]))
    assert pairs(skos.transitive(store.all(), SKOS.broader)) == [(EX + "a", EX + "b"), (EX + "b", EX + "c")]


def test_rdfs(spark):
    rows = [("a", RDFS.subClassOf, "b"), ("b", RDFS.subClassOf, "c"), ("a", RDFS.subClassOf, "x")]
    r = rdfs.Reasoner(spark)
    r.load_tbox(triples_of(spark, rows))
    r.load_abox(triples_of(spark, [("i", TYPE, "a")]))
    got = r.reason()
    assert pairs(got.where("graph = 'inferred'")) == [("a", "b"), ("a", "x")]
    assert got.where("graph = 'tbox'").count() == 3
    assert r.inferred_of("b").count() == 1
    t = rdfs.Reasoner(spark, transitive=True)
    t.load_tbox(triples_of(spark, rows))
    assert ("a", "c") in pairs(t.reason())


def test_k_hops(spark):
    df = triples_of(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("a", "p", "a")])
    assert pairs(rdfs.k_hops(df, "a", 1)) == [("a", "a"), ("a", "a"), ("a", "b")]
    assert pairs(rdfs.k_hops(df, "a", 2)) == [("a", "a"), ("a", "a"), ("a", "b"), ("a", "b"), ("b", "c")]


VOCABULARY = f"""@prefix skos: <{SKOS}> .
@prefix : <{EX}> .
:s a skos:ConceptScheme ; skos:hasTopConcept :top .
:top a skos:Concept ; skos:prefLabel "Top"@en ; skos:topConceptOf :s ; skos:inScheme :s .
:mid a skos:Concept ; skos:broader :top ; skos:prefLabel "Mid" ; skos:altLabel "mid " .
:low a skos:Concept ; skos:broader :mid ; skos:related :mid ; skos:exactMatch :other .
"""


def test_rules_and_hierarchy(spark):
    rows = statements_of_text(spark, VOCABULARY)
    engine = RuleEngine(rows, "v.ttl")
    facts = [(r.subject[len(EX) :], r.predicate.rpartition("#")[2], r.object[len(EX) :], r.derived) for r in engine.run().collect()]
    assert ("low", "broaderTransitive", "top", True) in facts and ("mid", "related", "low", True) in facts
    assert ("low", "exactMatch", "other", False) in facts and not any(f[1] == "broaderTransitive" and f[2] == "mid" for f in facts)
    where = engine.facts_with(EX + "mid", SKOS.broader).first().provenance
    assert where.source_file == "v.ttl" and where.line == 5 and where.column == 1
    assert engine.inconsistencies.count() == 0
    assert f"{EX}mid {SKOS.broader} {EX}top [v.ttl:5:1]" in [r.text for r in shown(engine.facts).collect()]
    h = Hierarchy(rows)
    assert pairs(h.all_broader(EX + "low"), "iri") == [(EX + "mid",), (EX + "top",)]
    assert pairs(h.all_narrower(EX + "top"), "iri") == [(EX + "low",), (EX + "mid",)]
    assert pairs(h.concepts_in_scheme(EX + "s"), "iri") == [(EX + "top",)] and pairs(h.top_concepts(EX + "s"), "iri") == [(EX + "top",)]
    assert [x[1][len(EX) :] for x in h.walk() if x[2] == 0] == ["low", "mid", "top", "s"]
    assert next(iter(h.walk("post")))[1] == EX + "top"
    engine.clear_rules()
    engine.add_rule("none", lambda c: (None, None))
    with pytest.raises(InterruptedError):
        engine.run(lambda: True)


def test_inconsistency_and_cycle(spark):
    rows = statements_of_text(spark, f"@prefix skos: <{SKOS}> . @prefix : <{EX}> .\n:a a skos:Concept ; skos:broader :b ; skos:narrower :b .")
    engine = RuleEngine(rows)
    engine.run()
    assert sorted(r.type for r in engine.inconsistencies.collect()) == ["broaderAndNarrower", "broaderAndNarrower", "cycle"]
    assert Hierarchy(rows).has_cycle() == (True, f"cycle through {EX}a")
    with pytest.raises(ValueError):
        list(Hierarchy(rows).walk())


def test_validation(spark):
    c = lambda n: (n, TYPE, SKOS.Concept)
    rows = [
        c("a"), ("a", SKOS.prefLabel, "x@en", True), ("a", SKOS.prefLabel, "y@en", True), ("a", SKOS.altLabel, " X ", True), ("a", SKOS.broader, "b"), ("b", SKOS.broader, "a"), c("b"),
        ("a", SKOS.inScheme, "none"), ("s", TYPE, SKOS.ConceptScheme), ("b", SKOS.narrower, "a"), ("b", SKOS.exactMatch, "lost"), ("b", SKOS.closeMatch, "http://w"), ("q", TYPE, SKOS.Collection),
    ]
    report = Validator(triples_of(spark, rows)).validate()
    got = sorted((r.type, r.subject) for r in report.issues.collect())
    assert got == sorted([
        ("missing_preferred_label", "b"), ("missing_preferred_label", "q"), ("multiple_preferred_labels", "a"), ("overlapping_labels", "a"), ("missing_notation", "a"), ("missing_notation", "b"),
        ("missing_notation", "q"), ("orphan_concept", "b"), ("orphan_concept", "q"), ("missing_top_concept", "s"), ("circular_broader_relation", "a"), ("circular_broader_relation", "b"),
        ("inconsistent_hierarchy", "b"), ("broken_link", "b"), ("invalid_concept_scheme", "a"),
    ])
    assert report.total_concepts == 3 and report.total_schemes == 1
    assert report.ordered().first().severity == "error"
    assert {r.severity for r in report.at_least("warning").issues.select("severity").collect()} == {"error", "warning"}
    assert next(r.context for r in report.issues.collect() if r.type == "multiple_preferred_labels") == {"language": "en"}


def test_graph_and_metadata(spark):
    rows = [
        (EX + "A", TYPE, OWL.Class), (EX + "A", RDFS.label, "first", True), (EX + "A", RDFS.label, "last", True), (EX + "A", RDFS.comment, "says", True), (EX + "A", RDFS.subClassOf, EX + "B"),
        (EX + "p", TYPE, OWL.DatatypeProperty), (EX + "p", RDFS.domain, EX + "A"), ("_:x", TYPE, OWL.Class), (EX + "s", TYPE, SKOS.ConceptScheme), (EX + "s", SKOS.hasTopConcept, EX + "t"),
    ]
    t = triples_of(spark, rows)
    g = GraphView(t)
    nodes = {r.id: (r.label, r.namespace, r.type, r.comment) for r in g.nodes.collect()}
    assert nodes[EX + "A"] == ("last", EX, "class", "says") and nodes[EX + "B"] == ("B", EX, "resource", "") and nodes["_:x"][1] == "_"
    assert pairs(g.edges, "source", "target", "label") == [(EX + "A", EX + "B", "subClassOf"), (EX + "p", EX + "A", "domain"), (EX + "s", EX + "t", "hasTopConcept")]
    assert GraphView(t, site=True).edges.where("label = 'type'").count() == 4
    assert pairs(g.filtered("class", EX, "LAS"), "id") == [(EX + "A",)]
    assert metadata.classes(t).collect()[0].asDict() == {"uri": EX + "A", "name": "A", "label": "last", "description": "says", "super_classes": ["B"]}
    p = metadata.properties(t).first()
    assert p.is_datatype and p.domain == [EX + "A"] and p.range == []
    assert metadata.schemes(t).first().top_concepts == [EX + "t"]
    assert [r.uri for r in metadata.search(t, "LAST").collect()] == [EX + "A"]
    assert {r.what: r.n for r in metadata.counts(t).collect()} == {"classes": 1, "properties": 1, "schemes": 1, "triples": 10}


def test_store(spark, tmp_path):
    store = store_of(spark, [("a", "p", "b"), ("a", "p", "b"), ("c", "q", "d")], "one")
    assert store.all().count() == 3 and store.match("a").count() == 2 and store.match(obj="d").first().graph == "one"
    with pytest.raises(ValueError):
        store.register("", store.all())
    with pytest.raises(KeyError):
        store.remove("none")
    store.save(str(tmp_path / "t"))
    again = TripleStore.load(spark, str(tmp_path / "t"))
    assert again.list() == ["one"] and again.match(predicate="p").count() == 2
    store.remove("one")
    assert store.list() == [] and store.all().count() == 0
