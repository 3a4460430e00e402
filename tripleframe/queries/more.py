"""Queries on files, the reasoner, the rule engine, reports, graph filters and the hierarchy's parts, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.mapping import E, V, Fact
from tripleframe.model import OWL, RDF, RDFS, SKOS, TYPE
from tripleframe.operators import graphview, metadata, rdfs, rules
from tripleframe.operators.hierarchy import Hierarchy
from tripleframe.operators.skos import Authority, Inference, infer
from tripleframe.operators.validation import Validator
from tripleframe.queries import operations as ops
from tripleframe.queries.operations import CLASSES, ISSUES, MATCHES, NATION, REGION, SUPPLIER, VOCABULARY, Run, facts, statements
from tripleframe.queries.oracle import cte
from tripleframe.runtime import shared_dir
from tripleframe.sinks import export
from tripleframe.sources import reader

R = E + "region/{r_regionkey}"
PROPERTIES = [
    Fact("supplier", SUPPLIER, RDFS.subPropertyOf, E + "nation/{s_nationkey}"), Fact("supplier", SUPPLIER, RDFS.subPropertyOf, E + "trade", where="s_suppkey % 4 = 0"),
    Fact("nation", NATION, RDFS.subPropertyOf, REGION),
]
#: types first: labels and scheme facts count where the subject was declared before
TREE = [
    Fact("region", R, TYPE, SKOS.ConceptScheme), Fact("nation", NATION, TYPE, SKOS.Concept), Fact("nation", NATION, SKOS.broader, REGION),
    Fact("region", R, SKOS.hasTopConcept, E + "nation/{r_regionkey}"), Fact("nation", NATION, SKOS.topConceptOf, REGION, where="n_nationkey < 5 and n_nationkey <> 2"),
    Fact("nation", NATION, SKOS.prefLabel, "{n_name}", True),
]
BROADER = TREE[:3]
NESTED = "http://example.org/v/"


def folder(spark: SparkSession) -> str:
    """A new folder of files beside the intermediate tables."""
    at = os.path.join(reader._plain(shared_dir(spark)), f"files-{uuid.uuid4().hex}")
    os.makedirs(at)
    return at


def _write(at: str, name: str, text: str) -> str:
    with open(os.path.join(at, name), "w", encoding="utf-8") as file:
        file.write(text)
    return os.path.join(at, name)


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, list[str], list[str]]:
    """A Turtle file and an RDF/XML file for each region."""
    at = folder(spark)
    both = []
    for rows, end in ((ops._turtle_text(spark, sf_dir), "ttl"), (ops._xml_text(spark, sf_dir), "rdf")):
        both.append([_write(at, f"{r.nr}.{end}", r.text) for r in rows.orderBy("nr").toLocalIterator()])
    return at, *both


def _read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, *_ = _files(spark, sf_dir)
    return reader.read_triples(spark, at).select("subject", "predicate", "object", "language", "datatype")


def _read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which number each file of a list has, by the subjects it has."""
    _, turtle, xml = _files(spark, sf_dir)
    df = reader.read_triples(spark, [turtle[3], xml[1], turtle[0]])
    return df.groupBy("subject").agg(F.min(F.shiftright("pos", 32)).alias("nr"))


def _read_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in a folder above imports the regions' files, which import each other by names without a path."""
    at = folder(spark)
    os.makedirs(os.path.join(at, "parts"))
    rows = ops._turtle_text(spark, sf_dir).orderBy("nr").collect()
    for i, r in enumerate(rows):
        _write(at, f"parts/{r.nr}.ttl", f"{r.text}\n<http://example.org/file/{r.nr}> <{OWL.imports}> <{rows[(i + 1) % len(rows)].nr}.ttl> .")
    root = _write(at, "root.ttl", f"@prefix v: <{V}> .\n<http://example.org/file/root> <{OWL.imports}> <parts/{rows[0].nr}.ttl> .")
    return reader.read_with_imports(spark, root).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(reader.detect_format(r.text),) for rows in (ops._turtle_text(spark, sf_dir), ops._xml_text(spark, sf_dir)) for r in rows.toLocalIterator()]
    return spark.createDataFrame(found, "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections, blank nodes, escapes and triple terms of every nation, read from files."""
    at = folder(spark)
    line = F.format_string(
        "<nation/%d> v:list ( '%s' <region/%d> [ v:key %d ] ) ; v:holds [ v:name \"a\\\"%s\" ; v:of [] ] ; v:says <<( <nation/%d> v:key %d )>> .",
        "n_nationkey", "n_name", "n_regionkey", "n_nationkey", "n_name", "n_nationkey", "n_nationkey",
    )
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    texts = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    for r in texts.toLocalIterator():
        _write(at, f"{r.n_regionkey}.ttl", f"@prefix v: <{NESTED}> .\n@base <{E}> .\n{r.text}")
    df = reader.read_triples(spark, at)
    kind = F.when(F.col("is_triple_term"), "triple").when(F.startswith("object", F.lit("_:")), "blank").when(F.col("is_literal"), "literal").otherwise("iri")
    return df.groupBy("predicate", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"))


NESTED_SQL = f"""WITH c AS (SELECT count(*) AS n FROM nation)
SELECT p AS predicate, k AS kind, m * n AS n, s * n AS subjects FROM c, (VALUES
  ('{V}list', 'blank', 1, 1), ('{RDF.first}', 'literal', 1, 1), ('{RDF.first}', 'iri', 1, 1), ('{RDF.first}', 'blank', 1, 1),
  ('{RDF.rest}', 'blank', 2, 2), ('{RDF.rest}', 'iri', 1, 1), ('{V}key', 'literal', 1, 1), ('{V}holds', 'blank', 1, 1), ('{V}name', 'literal', 1, 1),
  ('{V}of', 'blank', 1, 1), ('{V}says', 'triple', 1, 1), ('{RDF.subject}', 'iri', 1, 1), ('{RDF.predicate}', 'iri', 1, 1), ('{RDF.object}', 'literal', 1, 1)) x(p, k, m, s)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, turtle, _ = _files(spark, sf_dir)
    return reader.read_statements(spark, turtle).select("subject", "predicate", "object", "line")


def _reasoner(spark: SparkSession, sf_dir: str) -> rdfs.Reasoner:
    r = rdfs.Reasoner(spark)
    r.load_tbox(facts(CLASSES + PROPERTIES, spark, sf_dir))
    r.load_abox(facts(MATCHES, spark, sf_dir))
    r.reason()
    return r


def _again(predicate: str) -> str:
    """What the hierarchy of a predicate has, in SQL: every copy, and each pair once for every other object of its subject."""
    return (
        f"SELECT s, p, o, 0 AS again FROM t WHERE p = '{predicate}' UNION ALL "
        f"SELECT a.s, '{predicate}', a.o, 1 FROM (SELECT DISTINCT s, o FROM t WHERE p = '{predicate}') a JOIN t b ON b.p = '{predicate}' AND a.s = b.s AND a.o <> b.o"
    )


INFERRED = f"inf AS ({_again(RDFS.subClassOf)} UNION ALL {_again(RDFS.subPropertyOf)})"


def _engine(spark: SparkSession, sf_dir: str) -> rules.RuleEngine:
    engine = rules.RuleEngine(statements(MATCHES, spark, sf_dir))
    engine.run()
    return engine


def _rule_sql(name: str) -> str:
    return ops.OPERATIONS[name][1]


def _walked(order: str) -> Run:
    return lambda s, d: s.createDataFrame(list(Hierarchy(statements(BROADER, s, d)).walk(order)), "kind string, iri string, depth int")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that are errors, in the report's order."""
    report = Validator(facts(VOCABULARY, spark, sf_dir)).validate().at_least("error")
    return spark.createDataFrame([(i, r.type, r.subject) for i, r in enumerate(report.ordered().toLocalIterator())], "at int, type string, subject string")


CONCEPTS = f"c AS (SELECT DISTINCT s FROM t WHERE p = '{TYPE}' AND o IN ('{SKOS.Concept}', '{SKOS.Collection}')), sch AS (SELECT DISTINCT s FROM t WHERE p = '{TYPE}' AND o = '{SKOS.ConceptScheme}')"
MESSAGES = {
    "orphan_concept": f"SELECT s, 'concept is in no scheme', NULL FROM c WHERE s NOT IN (SELECT s FROM t WHERE p = '{SKOS.inScheme}')",
    "multiple_preferred_labels": (
        "SELECT s, 'several preferred labels in language ''' || min(l) || '''', min(l) FROM (SELECT s, l FROM (SELECT s, CASE WHEN contains(o, '@') THEN regexp_extract(o, '@([^@]*)$', 1) ELSE '' END AS l "
        f"FROM t WHERE p = '{SKOS.prefLabel}' AND s IN (SELECT s FROM c)) GROUP BY s, l HAVING count(*) > 1) GROUP BY s"
    ),
    "broken_link": f"SELECT s, 'no concept ' || o, NULL FROM t WHERE p IN ('{SKOS.exactMatch}', '{SKOS.closeMatch}') AND s IN (SELECT s FROM c) AND o NOT IN (SELECT s FROM c) AND NOT regexp_matches(o, '^(https?://|urn:)')",
    "invalid_concept_scheme": f"SELECT s, 'no scheme ' || o, o FROM t WHERE p = '{SKOS.inScheme}' AND s IN (SELECT s FROM c) AND o NOT IN (SELECT s FROM sch)",
}


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = Validator(facts(VOCABULARY, spark, sf_dir)).issues().where(F.col("type").isin(*MESSAGES))
    return issues.select("type", "subject", "message", F.coalesce(F.col("context")["scheme"], F.col("context")["language"]).alias("about"))


def _issue_rows(severities: str = "") -> str:
    rows = " UNION ALL ".join(f"({x})" for x in ISSUES.values())
    return f"SELECT * FROM ({rows})" + (f" WHERE severity IN ({severities})" if severities else "")


SITE_NODES_SQL = f"""
, own AS (SELECT s AS id, max({ops.NODE_CASE}) AS k FROM t WHERE p = '{TYPE}' GROUP BY s),
ends AS (SELECT DISTINCT o AS id FROM t WHERE p IN {ops._in([*ops.SITE, TYPE])} AND NOT lit AND NOT starts_with(o, 'http://www.w3.org/') AND o NOT IN (SELECT id FROM own))
SELECT id, coalesce(k, '') AS type FROM own UNION ALL SELECT id, 'resource' FROM ends"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphview.GraphView(facts(CLASSES, spark, sf_dir))
    parts = [df.select(F.lit(name).alias("what"), F.col(df.columns[0]).alias("value")) for name, df in (("namespace", g.namespaces()), ("type", g.types()), ("predicate", g.predicates()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


MORE: dict[str, tuple[Run, str]] = {
    "read_files": (_read_files, f"SELECT * FROM ({_rule_sql('read_turtle')}) UNION ALL SELECT * FROM ({_rule_sql('read_rdfxml')})"),
    "read_file_order": (_read_order, "SELECT 'http://example.org/nation/' || n_nationkey AS subject, CASE n_regionkey WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS nr FROM nation WHERE n_regionkey IN (3, 1, 0)"),
    "read_imports": (_read_imports, f"WITH n AS (SELECT count(*) AS k, count(DISTINCT n_regionkey) AS r FROM nation) SELECT '{TYPE}' AS predicate, k AS n FROM n UNION ALL SELECT '{V}name', 2 * k FROM n UNION ALL SELECT '{V}key', k FROM n UNION ALL SELECT '{OWL.imports}', r + 1 FROM n"),
    "read_formats": (_formats, "SELECT k AS kind, count(DISTINCT n_regionkey) AS n FROM nation, (VALUES ('turtle'), ('rdfxml')) x(k) GROUP BY k"),
    "read_nested": (_nested, NESTED_SQL),
    "read_positions": (_positions, f"""WITH n AS (SELECT 'http://example.org/nation/' || n_nationkey AS s, n_name, n_nationkey, CAST(1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey || '>') AS INTEGER) AS line FROM nation)
SELECT s AS subject, '{TYPE}' AS predicate, '{V}Nation' AS object, line FROM n UNION ALL SELECT s, '{V}name', n_name, line FROM n UNION ALL SELECT s, '{V}name', lower(n_name), line FROM n UNION ALL SELECT s, '{V}key', CAST(n_nationkey AS VARCHAR), line FROM n"""),
    "rdfs_property_hierarchy": (lambda s, d: rdfs.hierarchy(facts(PROPERTIES, s, d), RDFS.subPropertyOf).select("subject", "object", F.when(F.col("graph") == "inferred", 1).otherwise(0).alias("again")), cte(PROPERTIES, more=f"x AS ({_again(RDFS.subPropertyOf)})") + "SELECT s AS subject, o AS object, again FROM x"),
    "reasoner_inferred": (lambda s, d: _reasoner(s, d).inferred.select("subject", "predicate", "object", F.when(F.col("graph") == "inferred", 1).otherwise(0).alias("again")), cte(CLASSES + PROPERTIES + MATCHES, more=INFERRED) + "SELECT s AS subject, p AS predicate, o AS object, again FROM inf"),
    "reasoner_inferred_of": (lambda s, d: ops._spo(_reasoner(s, d).inferred_of(E + "supplier/0")), cte(CLASSES + PROPERTIES + MATCHES, more=INFERRED) + "SELECT s AS subject, p AS predicate, o AS object FROM inf WHERE s = 'http://example.org/supplier/0'"),
    "reasoner_related": (lambda s, d: ops._spo(_reasoner(s, d).find_related(E + "nation/3", 2)), cte(CLASSES + PROPERTIES + MATCHES, more=ops.LINKS + ", " + INFERRED + ", once AS (SELECT DISTINCT s, p, o, again FROM inf), ends AS (SELECT s AS n, * FROM once UNION SELECT o, * FROM once)") + "SELECT s AS subject, p AS predicate, o AS object FROM t JOIN n1 ON t.s = n1.n UNION ALL SELECT s, p, o FROM t JOIN n1 ON t.o = n1.n UNION ALL SELECT s, p, o FROM ends JOIN n1 USING (n)"),
    "skos_full_authority": (lambda s, d: infer(facts(MATCHES, s, d), Inference.RELATED, Authority.FULL).groupBy("predicate").agg(F.count(F.lit(1)).alias("n")), cte(MATCHES) + f"SELECT p AS predicate, count(*) + CASE p WHEN '{SKOS.related}' THEN count(DISTINCT (s, o)) ELSE 0 END AS n FROM t GROUP BY p"),
    "hierarchy_top_concepts": (lambda s, d: Hierarchy(statements(TREE, s, d)).top_concepts(E + "region/1").unionByName(Hierarchy(statements(TREE, s, d)).top_concepts(E + "region/2")), cte(TREE) + f"SELECT h.o AS iri FROM t h JOIN t b ON b.s = h.o AND b.o = h.s WHERE h.p = '{SKOS.hasTopConcept}' AND b.p = '{SKOS.topConceptOf}' AND h.s IN ('http://example.org/region/1', 'http://example.org/region/2')"),
    "hierarchy_walk": (_walked("pre"), "SELECT 'concept' AS kind, 'http://example.org/nation/' || n_nationkey AS iri, 0 AS depth FROM nation UNION ALL SELECT 'scheme', 'http://example.org/region/' || n_regionkey, 1 FROM nation UNION ALL SELECT 'scheme', 'http://example.org/region/' || r_regionkey, 0 FROM region"),
    "hierarchy_walk_post": (_walked("post"), "SELECT 'concept' AS kind, 'http://example.org/nation/' || n_nationkey AS iri, 0 AS depth FROM nation UNION ALL SELECT 'scheme', 'http://example.org/region/' || n_regionkey, 1 FROM nation UNION ALL SELECT 'scheme', 'http://example.org/region/' || r_regionkey, 0 FROM region"),
    "hierarchy_node": (lambda s, d: Hierarchy(statements(TREE, s, d)).node(E + "nation/3"), cte(TREE) + "SELECT 'concept' AS kind, p AS predicate, o AS value FROM t WHERE s = 'http://example.org/nation/3'"),
    "hierarchy_has_cycle": (lambda s, d: s.createDataFrame([Hierarchy(statements(chosen, s, d)).has_cycle() for chosen in (VOCABULARY, BROADER)], "found boolean, message string"), cte(VOCABULARY, more=ops.BOTH) + "SELECT count(*) > 0 AS found, 'cycle through ' || min(s) AS message FROM closure WHERE s = o UNION ALL SELECT false, ''"),
    "rule_engine": (lambda s, d: _engine(s, d).facts.groupBy("predicate", "derived").agg(F.count(F.lit(1)).alias("n")), f"SELECT predicate, derived, count(*) AS n FROM (({_rule_sql('rule_symmetric_related')}) UNION ALL ({_rule_sql('rule_transitive_exact_match')})) GROUP BY ALL"),
    "rule_facts": (lambda s, d: _engine(s, d).facts_with(predicate=SKOS.related, obj=E + "supplier/7").select("subject", "derived"), f"SELECT subject, derived FROM ({_rule_sql('rule_symmetric_related')}) WHERE object = 'http://example.org/supplier/7'"),
    "rule_facts_shown": (lambda s, d: rules.shown(_engine(s, d).facts_with(predicate=SKOS.related).where("derived")), f"SELECT subject || ' ' || predicate || ' ' || object || ' (derived)' AS text FROM ({_rule_sql('rule_symmetric_related')}) WHERE derived"),
    "validate_order": (_ordered, cte(VOCABULARY, more="one AS (SELECT 1 AS x)").split("WITH")[0] + f"SELECT CAST(row_number() OVER (ORDER BY type, subject) - 1 AS INTEGER) AS at, type, subject FROM ({_issue_rows(chr(39) + 'error' + chr(39))})"),
    "validate_at_least": (lambda s, d: Validator(facts(VOCABULARY, s, d)).validate().at_least("warning").stats(), f"SELECT type, count(*) AS n FROM ({_issue_rows(chr(39) + 'error' + chr(39) + ', ' + chr(39) + 'warning' + chr(39))}) GROUP BY type"),
    "validate_messages": (_messages, cte(VOCABULARY, more=CONCEPTS) + " UNION ALL ".join(f"SELECT '{k}' AS type, x.* FROM ({sql}) x(subject, message, about)" for k, sql in MESSAGES.items())),
    "graph_lists": (_lists, cte(CLASSES).rstrip() + f", n AS (SELECT id, namespace, type FROM ({{nodes}})) SELECT DISTINCT 'namespace' AS what, namespace AS value FROM n UNION ALL SELECT DISTINCT 'type', type FROM n UNION ALL SELECT DISTINCT 'predicate', p FROM t WHERE p IN {ops._in(ops.EDGES)}"),
    "graph_filtered": (lambda s, d: graphview.GraphView(facts(CLASSES, s, d)).filtered("class", E + "nation/", "ATION_1").select("id", "label"), "SELECT 'http://example.org/nation/' || n_nationkey AS id, n_name AS label FROM nation WHERE contains(lower(n_name), 'ation_1')"),
    "graph_site_nodes": (lambda s, d: graphview.GraphView(facts(CLASSES, s, d), site=True).nodes.select("id", "type"), cte(CLASSES).rstrip() + SITE_NODES_SQL),
    "graph_json_lines": (lambda s, d: export.graph_lines(graphview.GraphView(facts(CLASSES, s, d))).select("kind", F.coalesce(F.get_json_object("json", "$.id"), F.concat_ws(" ", F.get_json_object("json", "$.source"), F.get_json_object("json", "$.label"), F.get_json_object("json", "$.target"))).alias("what")), cte(CLASSES).rstrip() + f", n AS (SELECT id FROM ({{nodes}})) SELECT 'node' AS kind, id AS what FROM n UNION ALL SELECT 'edge', s || ' ' || {ops._case(ops.EDGES, 0)} || ' ' || o FROM t WHERE p IN {ops._in(ops.EDGES)}"),
    "metadata_search_rows": (lambda s, d: metadata.search(facts([*CLASSES[4:7], *CLASSES], s, d), "ATION_2").select("kind", "uri", "label"), "SELECT 'class' AS kind, 'http://example.org/nation/' || n_nationkey AS uri, n_name AS label FROM nation WHERE contains(lower(n_name), 'ation_2')"),
}


def _with_nodes(sql: str) -> str:
    """{nodes} as the nodes' own query: its common tables are put before."""
    if "{nodes}" not in sql:
        return sql
    before, body = ops.NODES_SQL.split("\nSELECT id,", 1)
    head, rest = sql.split(", n AS (", 1)
    return head + before.replace("\n,", ",", 1).replace("n AS (SELECT id, coalesce", "m AS (SELECT id, coalesce") + ", n AS (" + rest.replace("{nodes}", "SELECT id," + body.replace("FROM n\n", "FROM m\n"))


MORE = {k: (run, _with_nodes(sql)) for k, (run, sql) in MORE.items()}
