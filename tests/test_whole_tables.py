"""Queries that once saw a part of the tables, against plain Python over the whole of them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from tripleframe.mapping import E
from tripleframe.model import SKOS, triples_of
from tripleframe.operators import rules
from tripleframe.operators.skos import authority_match, close_classes, close_match, exact_match
from tripleframe.queries.operations import MATCHES, PAGES, facts

#: more suppliers than the 60 that were let through
SF = "/root/testdata/sf0.01"


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in entry.queries()[name](spark, SF).select(*columns).collect())


@pytest.fixture(scope="module")
def links(spark):
    """Edges to nations of all suppliers, and of nations to regions."""
    s = [(f"{E}supplier/{r.s_suppkey}", f"{E}nation/{r.s_nationkey}") for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()]
    n = [(f"{E}nation/{r.n_nationkey}", f"{E}region/{r.n_regionkey}") for r in spark.read.parquet(f"{SF}/nation.parquet").collect()]
    assert len(s) > 60
    return s, n


def brute(edges, ends):
    return {(d, o) for s, d in edges for o in ends if o not in (s, d)}


def test_exact_match_of_all_suppliers(spark, links):
    edges = links[0] + links[1]
    found = brute(edges, {x for e in edges for x in e})
    assert rows(spark, "skos_exact_match", "subject", "object") == sorted([*found, *((o, d) for d, o in found)])
    found = brute(edges, {s for s, _ in edges})
    want = [(*e, False) for e in edges] + [(*e, True) for d, o in found for e in ((d, o), (o, d))]
    assert rows(spark, "rule_transitive_exact_match", "subject", "object", "derived") == sorted(want)


def test_close_match_of_all_suppliers(spark, links):
    by = defaultdict(list)
    for s, d in links[0]:
        by[d].append(s)
    want = [e for s, d in links[0] for e in ((s, d), (d, s))] + [(a, b) for x in by.values() for a in x for b in x if a != b]
    assert sorted(tuple(r) for r in close_match(facts(MATCHES, spark, SF)).select("subject", "object").collect()) == sorted(want)
    got = rows(spark, "skos_close_match", "subject", "class", "copies", "links")
    assert [r[:3] for r in got] == sorted((*e, 1) for e in links[0])
    found = written_out(got)
    for s, d, n, _ in got:
        found.update({(s, d): n, (d, s): n})
    assert found == Counter(want) and sum(2 * n + k for _, _, n, k in got) == len(want)


def test_close_classes_of_copies_and_of_several_targets(spark):
    r = random.Random(5)
    for n in (0, 1, 30):
        edges = [(f"n{r.randrange(4)}", f"n{r.randrange(4)}") for _ in range(n)]
        df = triples_of(spark, [(s, SKOS.closeMatch, o) for s, o in edges] + [("n0", SKOS.exactMatch, "n1")])
        got = [tuple(x) for x in close_classes(df).select("subject", "class", "copies", "links").collect()]
        want = Counter((a, b) for i, (a, x) in enumerate(edges) for j, (b, y) in enumerate(edges) if i != j and x == y)
        assert {(s, d): c for s, d, c, _ in got} == Counter(edges) and written_out(got) == want and sum(x[3] for x in got) == want.total()
        direct = [x for s, o in edges for x in ((s, o), (o, s))]
        assert Counter(map(tuple, close_match(df).select("subject", "object").collect())) == want + Counter(direct)


def written_out(classes):
    """All links of (subject, class, copies, links) rows, with their numbers."""
    by, out = defaultdict(list), Counter()
    for s, c, n, _ in classes:
        by[c].append((s, n))
    for x in by.values():
        for a, n in x:
            for b, m in x:
                out[a, b] += n * (n - 1) if a == b else n * m
    return +out


def test_authority_classes_have_all_links_in_a_row_a_member(spark):
    got = rows(spark, "skos_authority_match", "subject", "class", "copies", "links")
    urls = Counter(r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect())
    assert [r[0] for r in got] == sorted(urls)
    links = written_out(got)
    host = lambda u: u.split("/")[2]
    assert links == +Counter({(a, b): n * (n - 1) if a == b else n * m for a, n in urls.items() for b, m in urls.items() if host(a) == host(b)})
    pairs = authority_match(facts(PAGES, spark, SF)).select("subject", "object").collect()
    assert Counter(map(tuple, pairs)) == links and sum(r[3] for r in got) == len(pairs)


def test_pairs_of_a_class_of_several_pieces(spark):
    n = 1500
    df = triples_of(spark, [(f"http://h/{i}", "p", f"http://{'h' if i < 2 else 'g'}/x") for i in range(n)] + [("http://g/1", "p", "x"), ("none", "p", "http://h/1")])
    made = authority_match(df)
    assert made.count() == (n + 2) * (n + 1)
    many = {tuple(r) for r in made.groupBy("subject", "object").count().where("count > 1 or subject = object").collect()}
    assert many == {(f"http://h/{i}", f"http://h/{j}", (4 if j < 2 else 2) - 2 * (i == j)) for i in (0, 1) for j in range(n)} | {(f"http://h/{i}", f"http://h/{j}", 2) for i in range(2, n) for j in (0, 1)}


def test_targets_of_one_subject_and_of_more(spark):
    r = random.Random(11)
    for n in (1, 4, 12):
        edges = [(f"n{r.randrange(6)}", f"n{r.randrange(6)}") for _ in range(n)]
        df = triples_of(spark, [(s, SKOS.exactMatch, o) for s, o in edges])
        found = brute(edges, {x for e in edges for x in e})
        assert sorted(tuple(x) for x in exact_match(df).select("subject", "object").collect()) == sorted([*found, *((o, d) for d, o in found)])
        given = df.selectExpr("'f' as file", "subject", "predicate", "object", "0 as line", "0 as col", "0 as pos", "0 as end")
        found = brute(edges, {s for s, _ in edges})
        got = rules.transitive_exact_match(rules.Context(given, None))[0].where("derived").select("subject", "object")
        assert sorted(tuple(x) for x in got.collect()) == sorted([*found, *((o, d) for d, o in found)])


WHOLE = ["bgp_variable_predicate", "filter_is_uri", "filter_is_literal", "filter_is_blank", "filter_datatype"]


def test_open_patterns_see_every_table(spark, small):
    """The subjects, taken one by one from the tables, against those of the queries with a variable predicate."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "order": "o_orderkey", "event": "event_id", "doc": "doc_id"}
    names = {"order": "orders", "event": "events", "doc": "documents"}
    got = {r.s for r in entry.queries()["bgp_variable_predicate"](spark, small).select("s").distinct().collect()}
    for kind, key in keys.items():
        assert {f"{E}{kind}/{r[0]}" for r in spark.read.parquet(f"{small}/{names.get(kind, kind)}.parquet").select(key).collect()} <= got, kind
    assert {f"{E}li/{r[0]}-{r[1]}" for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect()} <= got
    rows = {n: entry.queries()[n](spark, small).collect() for n in WHOLE[1:]}
    kinds = lambda name: {r[0][len(E) :].split("/")[0] for r in rows[name] if r[0].startswith(E)}
    assert {"li", "order", "customer", "turn"} <= kinds("filter_is_uri") and {"li", "event", "doc", "region"} <= kinds("filter_is_literal")
    assert {r[0] for r in rows["filter_datatype"]} & {r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows["filter_is_blank"]) == 25 and len(rows["filter_is_uri"]) + len(rows["filter_is_literal"]) == entry.queries()["bgp_variable_predicate"](spark, small).count()
