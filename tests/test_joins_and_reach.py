"""Joins on variables that may be unbound, searches along edges, guards, and the report's forms, against plain loops."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.helpers import EX, ask, store_of
from tests.test_operators import reachable
from tripleframe.model import SKOS, TYPE, triples_of
from tripleframe.operators import rules, skos
from tripleframe.operators.closure import closure, core, reach, reaches
from tripleframe.operators.hierarchy import Hierarchy
from tripleframe.operators.validation import Validator
from tripleframe.plans.compiler import Compiler, Rows
from tripleframe.plans.engine import Engine
from tripleframe.sinks import export
from tripleframe.sources import fetch
from tripleframe.sources.reader import statements_of_text, triples_of_text


def compatible(a, b, how, names):
    out = []
    for x in a:
        found = []
        for y in b:
            if all(x.get(v) is None or y.get(v) is None or x[v] == y[v] for v in x.keys() & y.keys()):
                found.append({v: x.get(v) if x.get(v) is not None else y.get(v) for v in names})
        out += found or ([{v: x.get(v) for v in names}] if how == "left" else [])
    return sorted(repr(sorted(r.items())) for r in out)


def rows_of(spark, rows, names, maybe):
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"v_{n} string" for n in names))
    return Rows(df, {n: f"v_{n}" for n in names}, set(maybe))


def test_joins_on_variables_that_may_be_unbound(spark):
    r = random.Random(1)

    def drawn(names, maybe, n):
        return [{v: None if v in maybe and r.random() < 0.4 else r.choice("pqr") for v in names} for _ in range(n)]

    for first, second, maybe_a, maybe_b, how in (
        ("xy", "yz", "y", "", "inner"), ("xy", "yz", "", "y", "inner"), ("xy", "yz", "y", "y", "inner"), ("xy", "xy", "xy", "xy", "inner"), ("xyw", "xyz", "x", "y", "inner"),
        ("xy", "yz", "y", "", "left"), ("xy", "yz", "y", "y", "left"), ("xy", "xyz", "xy", "", "left"), ("xy", "xyz", "y", "", "left"),
    ):
        a, b = drawn(first, maybe_a, 9), drawn(second, maybe_b, 8)
        got = Compiler(spark, None).join(rows_of(spark, a, first, maybe_a), rows_of(spark, b, second, maybe_b), how)
        names = sorted({*first, *second})
        found = [{v: x[got.names[v]] for v in names} for x in got.df.collect()]
        assert sorted(repr(sorted(x.items())) for x in found) == compatible(a, b, how, names), (first, second, maybe_a, maybe_b, how)
        assert all(v in got.maybe for x in found for v in names if x[v] is None)


def test_bound_rows_are_joined_by_key(spark):
    """Nested loops are only left for rows where the variable is unbound."""
    a = rows_of(spark, [{"x": "1", "y": None}, {"x": "2", "y": "p"}], "xy", "y")
    b = rows_of(spark, [{"y": "p", "z": "3"}], "yz", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Compiler(spark, None).join(a, b).df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and " OR " not in plan


def test_optional_groups_tell_unbound_from_empty(spark):
    """Rows of an optional group are told apart by all of their columns, nulls included."""
    rows = [(EX + "a", EX + "p", "", True), (EX + "b", EX + "p", "v", True), (EX + "b", EX + "q", "w", True), (EX + "a", EX + "q", "u", True), (EX + "b", EX + "r", "t", True)]
    got = ask(spark, rows, "SELECT ?x ?v ?w ?t WHERE { ?x :p ?v . OPTIONAL { ?x :q ?w . ?x :r ?t } }")
    assert sorted(got, key=lambda x: x["x"]) == [{"x": EX + "a", "v": "", "w": "u"}, {"x": EX + "b", "v": "v", "w": "w", "t": "t"}]


def test_searches_along_edges(spark):
    r = random.Random(2)
    for n in (0, 1, 6, 14, 25):
        edges = [(str(r.randrange(9)), str(r.randrange(9))) for _ in range(n)]
        df = spark.createDataFrame(edges, "src string, dst string")
        all_ = reachable(set(edges))
        assert sorted(x.node for x in reach(df, "3").collect()) == sorted(b for a, b in all_ if a == "3")
        starts = spark.createDataFrame([("1",), ("5",), ("none",), ("1",)], "src string")
        assert sorted(map(tuple, reaches(df, starts).select("src", "dst").collect())) == sorted((a, b) for a, b in all_ if a in ("1", "5"))
        for rounds in (0, 1, 8):
            left = core(df, rounds)
            assert {x.src for x in closure(left).where("src = dst").collect()} == {a for a, b in all_ if a == b}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(30)], "src string, dst string")
    assert core(chain).count() < 30


def statements(spark, text):
    return statements_of_text(spark, f"@prefix skos: <{SKOS}> .\n@prefix : <{EX}> .\n{text}")


def test_walk_has_no_limit_but_the_one_asked_for(spark):
    chain = "\n".join(f":c{i} a skos:Concept ; skos:broader :c{i + 1} ." for i in range(1500))
    h = Hierarchy(statements(spark, chain))
    h.__dict__["has_cycle"] = lambda: (False, "")  # the search for cycles is tested elsewhere
    walk = h.walk("post")
    assert max(at for _, _, at in (next(walk) for _ in range(1501))) == 1500
    with pytest.raises(ValueError, match="more than 5 steps"):
        list(h.walk(depth=5))
    small = Hierarchy(statements(spark, ":a a skos:Concept ; skos:broader :b , :c . :b a skos:Concept ; skos:broader :c . :c a skos:Concept ."))
    pre, post = ([(i[len(EX) :], d) for _, i, d in small.walk(o)] for o in ("pre", "post"))
    assert pre == [("a", 0), ("b", 1), ("c", 2), ("c", 1), ("b", 0), ("c", 1), ("c", 0)]
    assert post == [("c", 2), ("b", 1), ("c", 1), ("a", 0), ("c", 1), ("b", 0), ("c", 0)]


def test_nodes_and_additions(spark):
    first = statements(spark, ":a a skos:Concept ; skos:prefLabel 'x' .")
    h = Hierarchy(first)
    assert sorted(map(tuple, h.node(EX + "a").select("kind", "value").collect())) == [("concept", SKOS.Concept), ("concept", "x")] and h.node(EX + "b").count() == 0
    more = h.adding(statements(spark, ":a skos:broader :b ."))
    assert [x.iri for x in more.all_broader(EX + "a").collect()] == [EX + "b"] and h.all_broader(EX + "a").count() == 0


def test_guards_can_be_set_where_rules_are_used(spark):
    rows = [(f"http://h/{i}", SKOS.exactMatch, f"http://h/{i + 1}") for i in range(6)]
    df = triples_of(spark, rows)
    text = f"SELECT ?a ?b WHERE {{ ?a <{SKOS.exactMatch}> ?b }}"
    for options in ({"inference": skos.Inference.EXACT_MATCH}, {"inference": skos.Inference.EXACT_MATCH, "authority": skos.Authority.AUTHORITY}):
        with pytest.raises(ValueError, match="pairs"):
            Engine(store_of(spark, rows), max_pairs=3, **options).execute(text).bindings.collect()
        assert Engine(store_of(spark, rows), max_pairs=10**6, **options).execute(text).bindings.count() > 6
    with pytest.raises(ValueError, match="pairs"):
        skos.infer(df, skos.Inference.ALL, max_pairs=3)
    said = statements(spark, "\n".join(f":{i} skos:exactMatch :{i + 1} ." for i in range(6)))
    with pytest.raises(ValueError, match="pairs"):
        rules.RuleEngine(said, max_pairs=3).run()
    assert rules.RuleEngine(said, max_pairs=10**6).run().count() > 6


def test_addresses_are_fetched_side_by_side(spark):
    def client(uri, timeout):
        begin = time.time()
        time.sleep(0.1)
        return 200, f"{begin} {time.time()}", uri.encode()

    rows = spark.createDataFrame([(f"http://a/{i}",) for i in range(40)], "object string")
    out = fetch.fetch(rows, client, at_once=4)
    got = out.select("*", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 40 and all(bytes(x.body).decode() == x.uri for x in got) and out.rdd.getNumPartitions() == 4
    for task in {x.task for x in got}:
        spans = [tuple(map(float, x.content_type.split())) for x in got if x.task == task]
        most = max(sum(a <= at < b for a, b in spans) for at, _ in spans)
        assert 2 <= most <= 4


def test_forms_of_the_report(spark):
    t = triples_of_text(spark, f"@prefix skos: <{SKOS}> .\n@prefix : <{EX}> .\n:c a skos:Concept ; skos:inScheme :lost ; skos:prefLabel 'x' , 'y' .")
    report = Validator(t).validate()
    plain, verbose, quiet = export.report_text(report), export.report_text(report, verbose=True), export.report_text(report, quiet=True)
    assert "invalid_concept_scheme" in plain and "confidence" not in plain
    assert f"    scheme: {EX}lost" in verbose and "    confidence: 1" in verbose and "    language: " in verbose
    assert quiet == "Concepts: 1\nSchemes: 0\nIssues: 3\n"
    order = [(x.severity, x.type) for x in report.ordered().collect()]
    assert order == [("error", "invalid_concept_scheme"), ("warning", "multiple_preferred_labels"), ("info", "missing_notation")]
    typed = triples_of(spark, [(EX + "c", TYPE, SKOS.Concept)])
    assert {x.type for x in Validator(typed).issues().collect()} == {"missing_preferred_label", "missing_notation", "orphan_concept"}


def test_functions_and_options_of_the_engine(spark):
    rows = [(EX + "a", EX + "name", "Anna", True), (EX + "b", EX + "name", "Bo", True)]
    engine = Engine(store_of(spark, rows))
    engine.register_function("isPalindrome", lambda c: F.lower(c) == F.reverse(F.lower(c)))
    engine.register_function("firstOf", lambda c, d: F.substr(F.concat(c, d), F.lit(1), F.lit(1)))
    assert [r["n"] for r in ask(spark, engine, "SELECT ?n WHERE { ?x :name ?n . FILTER(isPalindrome(?n)) }")] == ["Anna"]
    assert [r["n"] for r in ask(spark, engine, "SELECT ?n WHERE { ?x :name ?n . FILTER(!isPalindrome(?n) && firstOf(?n, 'x') = 'B') }")] == ["Bo"]
    with pytest.raises(ValueError):
        Engine(store_of(spark, rows)).execute("SELECT ?n WHERE { ?x ?p ?n . FILTER(isPalindrome(?n)) }")
    assert engine.set(optional="standard", max_pairs=5) is engine and (engine.optional, engine.max_pairs) == ("standard", 5)
    with pytest.raises(TypeError):
        engine.set(colour=1)


def test_lines_of_nodes_and_inconsistencies(spark):
    said = statements(spark, ":a a skos:Concept ; skos:prefLabel 'x' ; skos:broader :b . :b a skos:Concept ; skos:broader :a .")
    assert sorted(r.text for r in Hierarchy(said).shown().collect()) == [f'concept {EX}a "x" < 1', f"concept {EX}b < 1"]
    engine = rules.RuleEngine(said, "v.ttl")
    engine.run()
    text = [r.text for r in rules.shown_inconsistencies(engine.inconsistencies).collect()]
    assert f"[cycle] cycle through {EX}a" in text and any(t.startswith("[broaderAndNarrower] ") and "[v.ttl:" in t for t in text)
