from __future__ import annotations

import json

import pytest

from tests.helpers import EX
from tripleframe.model import RDF, SKOS, TYPE, XSD
from tripleframe.operators.graphview import GraphView
from tripleframe.operators.validation import Validator
from tripleframe.sinks import export
from tripleframe.sinks.service import Service
from tripleframe.sinks.site import Renderer, copy_file
from tripleframe.sources import fetch, rdfxml, reader, turtle
from tripleframe.sources.turtle import ParseError

P = f"@prefix : <{EX}> .\n"


def spo(text):
    return [(r["subject"], r["predicate"], r["object"]) for r in turtle.parse_triples(text)]


def test_turtle_terms():
    got = turtle.parse_triples(P + """:a a :T ; :p 42, 4.5, true, "x"@en, "y"@ar--rtl, '''l1
l2''', "q\\n\\"\\u0041", "1"^^<http://t/d> ; .\n# a comment\n""")
    by = {r["object"]: (r["datatype"], r["language"], r["direction"], r["is_literal"]) for r in got}
    assert by["42"][0] == XSD.decimal and by["4.5"][0] == XSD.double and by["true"][0] == XSD.boolean
    assert by["x"] == (RDF.langString, "en", None, True) and by["y"] == (RDF.dirLangString, "ar", "rtl", True)
    assert 'q\n"\\u0041' in by and "l1\nl2" in by and by["1"][0] == "http://t/d" and by[EX + "T"][3] is False
    assert turtle.parse_triples(P + ":a :p 42.")[0]["object"] == "42"


def test_turtle_structure():
    assert spo("@base <http://b/> . <x> <p> <y> .") == [("http://b/x", "http://b/p", "http://b/y")]
    assert spo(P + "BASE <http://b/>\nPREFIX q: <http://q/>\n<x> q:p :y .") == [("http://b/x", "http://q/p", EX + "y")]
    rows = spo(P + ":a :p ( 1 :b ) . :c :p () .")
    assert [r[1] for r in rows].count(RDF.first) == 2 and rows[-1][2] == RDF.nil and len(rows) == 6
    rows = turtle.parse_triples(P + ":a :says << :b :p :c >> . << :x :y :z >> :q <<( :l :m :n )>> .")
    assert [r["is_triple_term"] for r in rows if r["predicate"] in (EX + "says", EX + "q")] == [True, True] and len(rows) == 11
    rows = spo(P + ":a :p [ :q 1 ; :r [] ] . _:b1 :p _:b2 . [ :q 1 ] .")
    assert len(rows) == 5 and ("_:b1", EX + "p", "_:b2") in rows
    assert spo(P + ":a :p [] .")[0][2] != spo(P + ":b :p [] .")[0][2]


@pytest.mark.parametrize("text", [":a :p :b .", P + ":a :p", P + ":a :p :b", P + '"x" :p :b .', P + ":a :p ( :b .", "@prefix x <y> .", P + ":a :p << :b :c :d ."])
def test_turtle_errors(text):
    with pytest.raises(ParseError):
        turtle.parse_triples(text)


def test_statements_and_document():
    text = f"@prefix : <{EX}> .\n# é\n:a :p :é ;\n  :q ( 1 2 ), [ :x :y ], 1, 1.5, 1e3 .\n:b a :T"
    rows = turtle.parse_statements(text, "f.ttl")
    assert [r["kind"] for r in rows] == ["pname", "collection", "bnode", "literal", "literal", "literal", "pname"]
    assert {(r["line"], r["col"]) for r in rows[:6]} == {(3, 1)} and rows[1]["object"] == "" and rows[6]["predicate"] == TYPE
    raw = text.encode()
    assert raw[rows[0]["pos"] : rows[0]["end"]].decode() == ":a :p :é"
    doc = turtle.parse_document(text)
    assert [s.object.datatype for s in doc.statements[3:6]] == [XSD.integer, XSD.decimal, XSD.double]
    assert [k for k, _ in doc.walk()][:2] == ["document", "prefix"] and [k for k, _ in doc.walk("post")][-1] == "document"
    assert str(doc).startswith("@prefix : <") and len(doc.comments) == 1


XML = f"""<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{EX}">
  <e:Person rdf:about="{EX}a" e:nick="al">
    <e:name xml:lang="en">Alice</e:name><e:age rdf:datatype="{XSD.integer}">30</e:age><e:plain>p</e:plain><e:empty></e:empty>
    <e:knows rdf:resource="{EX}b"/><e:has><e:Cat><e:name xml:lang="ar--rtl">Tom</e:name></e:Cat></e:has>
  </e:Person>
  <rdf:Description rdf:ID="d"><e:p rdf:nodeID="n"/></rdf:Description><rdf:Description rdf:nodeID="n"><e:q>x</e:q></rdf:Description>
</rdf:RDF>"""


def test_rdfxml():
    rows = {(r["subject"], r["predicate"][len(EX) :] if r["predicate"].startswith(EX) else "type"): r for r in rdfxml.parse_triples(XML)}
    a = EX + "a"
    assert rows[a, "type"]["object"] == EX + "Person" and rows[a, "nick"]["object"] == "al" and rows[a, "name"]["language"] == "en"
    assert rows[a, "age"]["datatype"] == XSD.integer and not rows[a, "plain"]["is_literal"] and (a, "empty") not in rows
    cat = rows[a, "has"]["object"]
    assert cat.startswith("_:") and rows[cat, "name"]["direction"] == "rtl" and rows[cat, "type"]["object"] == EX + "Cat"
    assert rows["#d", "p"]["object"] == "_:n" and rows["_:n", "q"]["object"] == "x"
    with pytest.raises(ParseError):
        rdfxml.parse_triples("<rdf:RDF>")
    deep = "".join(f'<e:p{i}><e:N>' for i in range(60)) + "".join(f"</e:N></e:p{i}>" for i in reversed(range(60)))
    with pytest.raises(ParseError):
        rdfxml.parse_triples(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{EX}"><e:N>{deep}</e:N></rdf:RDF>')


def test_detection():
    assert reader.detect_format("# x\n\n@prefix a: <b> .") == reader.detect_format("PREFIX a: <b>") == "turtle"
    assert reader.detect_format(XML) == reader.detect_format("<rdf:RDF/>") == "rdfxml"
    with pytest.raises(ParseError):
        reader.detect_format("{}")


def test_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(P + f"@prefix owl: <http://www.w3.org/2002/07/owl#> .\n:a :p [] ; owl:imports <{tmp_path}/b.ttl>, <http://web/c.ttl> .")
    (tmp_path / "b.ttl").write_text(P + f"@prefix owl: <http://www.w3.org/2002/07/owl#> .\n:b :p [] ; owl:imports <{tmp_path}/a.ttl> .")
    (tmp_path / "x.rdf").write_text(XML)
    df = reader.read_triples(spark, [str(tmp_path / "b.ttl"), str(tmp_path / "x.rdf")], "g")
    assert df.count() == 2 + len(rdfxml.parse_triples(XML)) and {r.graph for r in df.select("graph").distinct().collect()} == {"g"}
    first = df.orderBy("pos").first()
    assert first.subject == EX + "b"
    assert reader.read_with_imports(spark, str(tmp_path / "a.ttl")).count() == 5
    assert reader.read_statements(spark, str(tmp_path / "a.ttl")).count() == 3
    assert reader.triples_of_text(spark, XML).count() == len(rdfxml.parse_triples(XML))
    with pytest.raises(ValueError):
        reader.read_triples(spark, [], "g")


def test_fetch(spark):
    def client(uri, timeout):
        if "slow" in uri:
            raise TimeoutError("too slow")
        return (404 if "404" in uri else 200), "text/turtle", b"x"

    rows = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://a/404",), ("http://slow/",), ("urn:x",)], "object string")
    got = {r.uri: r for r in fetch.fetch_all(rows, client).collect()}
    assert len(got) == 3 and bytes(got["http://a/1"].body) == b"x" and got["http://a/404"].error == "status 404" and "too slow" in got["http://slow/"].error
    assert fetch.fetch_one("urn:x")["error"].startswith("not an HTTP")


def test_sinks(spark, tmp_path):
    text = f"@prefix skos: <{SKOS}> .\n" + P + ':c a skos:Concept ; skos:broader :d ; skos:definition "what <it> is" . :s a skos:ConceptScheme .'
    t = reader.triples_of_text(spark, text)
    pages = Renderer(t, "My <title>").render(str(tmp_path / "site"))
    assert "viz/graph.json" in pages and "what &lt;it&gt; is" in (tmp_path / "site/classes.html").read_text()
    assert json.loads((tmp_path / "site/viz/graph.json").read_text())["edges"]
    drawn = json.loads("".join(export.graph_parts(GraphView(t))))
    once = json.loads(export.graph_json(GraphView(t)).first()[0])
    order = lambda g: {k: sorted(v, key=json.dumps) for k, v in g.items()}
    assert order(drawn) == order(once)
    report = Validator(t).validate()
    assert json.loads(export.report_json(report))["stats"]["missing_notation"] == 1 and "[warning] orphan_concept" in export.report_text(report)
    assert set(json.loads(export.graph_json(GraphView(t)).first()[0])) == {"nodes", "edges", "namespaces", "types", "predicates"}
    s = Service(spark, t)
    assert s.answer("/api/graph")[0] == 200 and json.loads(s.answer("/api/search?q=c")[1])[0]["uri"] == EX + "c"
    assert json.loads(s.answer("/api/sparql?query=SELECT%20%3Fx%20WHERE%20%7B%20%3Fx%20a%20%3Chttp%3A%2F%2Fwww.w3.org%2F2004%2F02%2Fskos%2Fcore%23Concept%3E%20%7D")[1]) == {"bindings": [{"x": EX + "c"}]}
    assert s.answer("/api/sparql?query=ASK")[0] == 400 and s.answer("/api/sparql")[0] == 400 and s.answer("/nothing")[0] == 404
    copy_file(str(tmp_path / "site/index.html"), str(tmp_path / "x/y.html"))
    assert (tmp_path / "x/y.html").exists()


def test_command_line(spark, tmp_path, capsys):
    from tripleframe.__main__ import main

    f = tmp_path / "v.ttl"
    f.write_text(f"@prefix skos: <{SKOS}> .\n" + P + ":c a skos:Concept ; skos:broader :c ; skos:inScheme :lost .")
    assert main(["validate", str(f), "--severity", "error"], spark) == 1
    shown = capsys.readouterr().out
    assert "circular_broader_relation" in shown and "missing_notation" not in shown
    assert main(["query", str(f), "--query", f"SELECT ?x WHERE {{ ?x <{SKOS.broader}> ?x }}"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"x": EX + "c"}
    assert main(["graph", str(f), "--imports"], spark) == 0 and json.loads(capsys.readouterr().out)["edges"]
    assert main(["site", str(f), "--folder", str(tmp_path / "out")], spark) == 0 and (tmp_path / "out/index.html").exists()


def test_pages_of_classes_and_properties(spark, tmp_path):
    text = f"""@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n{P}
    :A a owl:Class ; rdfs:label "an <A>" . :B a owl:Class ; rdfs:subClassOf :A ; rdfs:comment "of B" . :p a owl:DatatypeProperty ; rdfs:domain :B ; rdfs:range :A ."""
    pages = Renderer(reader.triples_of_text(spark, text)).render(str(tmp_path))
    assert {"classes.html", "properties.html", "viz/index.html"} <= set(pages)
    classes, properties, graph = ((tmp_path / p).read_text() for p in ("classes.html", "properties.html", "viz/index.html"))
    assert '<section id="A"><h2>an &lt;A&gt;</h2>' in classes and '<dt>Subclasses</dt><dd><a href="classes.html#B">B</a></dd>' in classes
    assert '<dt>Properties</dt><dd><a href="properties.html#p">p</a></dd>' in classes and '<dt>Superclasses</dt><dd><a href="classes.html#A">A</a></dd>' in classes
    assert "datatype property" in properties and '<dt>Domain</dt><dd><a href="classes.html#B">B</a></dd>' in properties
    assert 'href="../index.html"' in graph and "<svg" in graph and 'name="namespace"' in graph


def test_the_service_streams(spark):
    import threading
    import urllib.request

    t = reader.triples_of_text(spark, P + " ".join(f":s{i} :p :o{i} ." for i in range(50)))
    server = Service(spark, t).serve(".", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}/api/sparql?query=SELECT%20%3Fs%20WHERE%20%7B%20%3Fs%20%3Fp%20%3Fo%20%7D"
        assert len(json.loads(urllib.request.urlopen(at).read())["bindings"]) == 50
    finally:
        server.shutdown()
