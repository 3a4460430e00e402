"""SELECT queries over the star's virtual triples, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.mapping import E, V, star, star_facts
from tripleframe.model import RDF, SKOS, TYPE, XSD, triples
from tripleframe.operators.skos import Authority, Inference
from tripleframe.plans.engine import Engine
from tripleframe.queries.oracle import cte
from tripleframe.store import TripleStore

PREFIX = f"PREFIX v: <{V}> PREFIX e: <{E}> PREFIX skos: <{SKOS}> PREFIX rdf: <{RDF}> PREFIX xsd: <{XSD}>\n"


@dataclass
class Query:
    """`uses`: predicates in the SQL's t (all if empty); `rounded`: result
    columns compared as numbers with so many places, as the order of a float sum differs between engines."""

    text: str
    sql: str
    uses: tuple[str, ...] = ()
    rounded: dict[str, int] = field(default_factory=dict)
    optional: str = "progressive"
    inference: Inference = Inference.NONE
    authority: Authority = Authority.NONE
    more: str = ""
    extend: Callable[[TripleStore, SparkSession, str], None] | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        store = TripleStore(spark)
        store.register("star", star(spark, sf_dir))
        if self.extend:
            self.extend(store, spark, sf_dir)
        df = Engine(store, self.inference, self.authority, self.optional).execute(PREFIX + self.text).bindings
        for name, places in self.rounded.items():
            df = df.withColumn(name, F.round(F.col(name).cast("double"), places))
        return df

    def oracle(self) -> str:
        return cte(star_facts(), *self.uses, more=self.more) + self.sql


def _v(*names: str) -> tuple[str, ...]:
    return tuple(V + n for n in names)


def _containers(store: TripleStore, spark: SparkSession, sf_dir: str) -> None:
    """An order's items as members of a container."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    store.register("containers", triples(li.select(
        F.concat(F.lit(E + "order/"), F.col("l_orderkey").cast("string")).alias("subject"), F.concat(F.lit(RDF + "_"), F.col("l_linenumber").cast("string")).alias("predicate"),
        F.concat(F.lit(E + "part/"), F.col("l_partkey").cast("string")).alias("object"),
    )))


def _nations(store: TripleStore, spark: SparkSession, sf_dir: str, name: str, **columns) -> None:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    given = {"subject": F.concat(F.lit(E + "nation/"), F.col("n_nationkey").cast("string")), "is_literal": F.lit(True)} | columns
    store.register(name, triples(n.select(*[c.alias(k) for k, c in given.items()])))


def _blanks(store: TripleStore, spark: SparkSession, sf_dir: str) -> None:
    """Blank nodes that lead to blank nodes."""
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    _nations(store, spark, sf_dir, "blanks", subject=of("_:n", "n_nationkey"), predicate=F.lit(V + "near"), object=of("_:r", "n_regionkey"), is_literal=F.lit(False))


def _spoken(store: TripleStore, spark: SparkSession, sf_dir: str) -> None:
    """Names with a language."""
    _nations(store, spark, sf_dir, "spoken", predicate=F.lit(V + "said"), object=F.col("n_name"), language=F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("fr"))


def _amounts(store: TripleStore, spark: SparkSession, sf_dir: str) -> None:
    """Numbers in the forms that numbers have, and a word."""
    forms = F.array(*map(F.lit, ("inf", "nan", "0x1.8p1", "1e2", "-.5", "none")))
    _nations(store, spark, sf_dir, "amounts", predicate=F.lit(V + "amount"), object=F.element_at(forms, (F.col("n_nationkey") % 6 + 1).cast("int")))


P, N, A, S = V + "placedBy", V + "inNation", V + "acctbal", V + "segment"
NAME, REGION = V + "name", V + "inRegion"


def _filter(condition: str, sql: str, **kw) -> Query:
    """On names of nations and regions and their links."""
    return Query(f"SELECT ?x ?n WHERE {{ ?x v:name ?n . FILTER({condition}) }}", f"SELECT s AS x, o AS n FROM t WHERE {sql}", (NAME,), **kw)


SELECTS: dict[str, Query] = {
    "bgp_join": Query(
        "SELECT ?nation ?region WHERE { ?n v:name ?nation . ?n v:inRegion ?r . ?r v:name ?region }",
        "SELECT a.o AS nation, c.o AS region FROM t a JOIN t b ON b.s = a.s JOIN t c ON c.s = b.o WHERE a.p = '%s' AND b.p = '%s' AND c.p = '%s'" % (NAME, REGION, NAME), (NAME, REGION),
    ),
    "bgp_star": Query(
        "SELECT ?c ?name ?bal ?seg WHERE { ?c v:name ?name ; v:acctbal ?bal ; v:segment ?seg . }",
        "SELECT a.s AS c, a.o AS name, b.o AS bal, d.o AS seg FROM t a JOIN t b USING (s) JOIN t d USING (s) WHERE a.p = '%s' AND b.p = '%s' AND d.p = '%s'" % (NAME, A, S), (NAME, A, S),
    ),
    "bgp_chain_count": Query(
        "SELECT ?region (COUNT(?o) AS ?n) WHERE { ?o v:placedBy ?c . ?c v:inNation ?na . ?na v:inRegion ?r . ?r v:name ?region } GROUP BY ?region",
        "SELECT r_name AS region, CAST(count(*) AS VARCHAR) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", (NAME,),
    ),
    "bgp_cross_product": Query(
        "SELECT ?n ?s WHERE { ?n v:inRegion <http://example.org/region/1> . ?s a skos:ConceptScheme }",
        "SELECT a.s AS n, b.s AS s FROM t a, t b WHERE a.p = '%s' AND a.o = 'http://example.org/region/1' AND b.p = '%s' AND b.o = '%s'" % (REGION, TYPE, SKOS.ConceptScheme), (REGION, TYPE),
    ),
    "bgp_variable_predicate": Query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }", "SELECT s, p, o FROM t"),
    "bgp_repeated_variable": Query("SELECT ?x ?y WHERE { ?x skos:related ?y . ?y skos:related ?y . }", "SELECT a.s AS x, a.o AS y FROM u a JOIN u b ON b.s = a.o AND b.o = a.o", (SKOS.related,), extend=lambda st, sp, d: st.register("loop", st.match(predicate=SKOS.related).selectExpr("object as subject", "predicate", "object").distinct()), more="u AS (SELECT s, o FROM t UNION ALL SELECT DISTINCT o, o FROM t)"),
    "bgp_star_triangle": Query(
        "SELECT ?l ?p ?s WHERE { ?l v:ofPart ?p . ?l v:bySupplier ?s . ?s v:inNation <http://example.org/nation/3> . ?p v:brand 'Brand#12' }",
        "SELECT 'http://example.org/li/' || l_orderkey || '-' || l_linenumber AS l, 'http://example.org/part/' || p_partkey AS p, 'http://example.org/supplier/' || s_suppkey AS s "
        "FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_suppkey AS k FROM lineitem) b USING (l_orderkey, l_linenumber) JOIN part ON l_partkey = p_partkey JOIN supplier ON k = s_suppkey WHERE s_nationkey = 3 AND p_brand = 'Brand#12'", (REGION,),
    ),
    "select_all_variables": Query("SELECT * WHERE { ?n v:inRegion ?r . OPTIONAL { ?n v:name ?name } }", "SELECT a.s AS n, a.o AS r, b.o AS name FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '%s' WHERE a.p = '%s'" % (NAME, REGION), (NAME, REGION)),
    "pattern_constant_subject": Query("SELECT ?p ?o WHERE { <http://example.org/nation/7> ?p ?o }", "SELECT p, o FROM t WHERE s = 'http://example.org/nation/7'"),
    "pattern_type_keyword": Query("SELECT ?s WHERE { ?s a skos:ConceptScheme }", "SELECT s FROM t WHERE p = '%s' AND o = '%s'" % (TYPE, SKOS.ConceptScheme), (TYPE,)),
    "pattern_lists": Query(
        "SELECT ?c ?n WHERE { ?c v:segment 'BUILDING' ; v:name ?n . ?c v:inNation e:nation/1 , ?other . }".replace("e:nation/1", "<http://example.org/nation/1>"),
        "SELECT 'http://example.org/customer/' || c_custkey AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 1", (REGION,),
    ),
    "pattern_any_slot": Query("SELECT ?o ?item WHERE { ?o fx:anySlot ?item . ?o v:status 'F' }", "SELECT 'http://example.org/order/' || l_orderkey AS o, 'http://example.org/part/' || l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'", (REGION,), extend=_containers),
    "filter_cardinal": Query("SELECT ?o ?slot WHERE { ?o ?slot ?item . FILTER(fx:cardinal(?slot) = '7') }", "SELECT 'http://example.org/order/' || l_orderkey AS o, '%s_7' AS slot FROM lineitem WHERE l_linenumber = 7" % RDF, (REGION,), extend=_containers),
    "filter_equals": _filter('?n = "ASIA"', "o = 'ASIA'"),
    "filter_not_equals": _filter('?n != "ASIA"', "o <> 'ASIA'"),
    "filter_not_equals_unbound": Query("SELECT ?d WHERE { ?d v:lang 'fr' . OPTIONAL { ?d v:quality ?q } FILTER(?q != '1') }", "SELECT a.s AS d FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '%s' WHERE a.p = '%s' AND a.o = 'fr' AND coalesce(b.o, '') <> '1'" % _v("quality", "lang"), _v("quality", "lang")),
    "filter_regex": _filter('regex(?n, "^[A-C].*A$")', "regexp_matches(o, '^[A-C].*A$')"),
    "filter_regex_invalid": _filter('regex(?n, "([")', "false"),
    "filter_contains": _filter('contains(?n, "IA")', "contains(o, 'IA')"),
    "filter_starts_with": _filter('strStarts(?n, "Customer#00000001")', "starts_with(o, 'Customer#00000001')"),
    "filter_ends_with": _filter('strEnds(?n, "7")', "ends_with(o, '7')"),
    "filter_lcase": _filter('lcase(?n) = "asia" || lcase(?n, "EUROPE")', "lower(o) IN ('asia', 'europe')"),
    "filter_ucase": _filter('ucase(?n, "africa")', "upper(o) = 'AFRICA'"),
    "filter_replace": _filter('replace(?n, "AM", "x")', "contains(o, 'AM')"),
    "filter_is_uri": Query("SELECT ?s ?o WHERE { ?s ?p ?o . FILTER(isURI(?o)) }", "SELECT s, o FROM t WHERE regexp_matches(o, '^(https?://|urn:)')"),
    "filter_is_literal": Query("SELECT ?s ?o WHERE { ?s ?p ?o . FILTER(isLiteral(?o)) }", "SELECT s, o FROM t WHERE NOT regexp_matches(o, '^(https?://|urn:)')"),
    "filter_is_blank": Query("SELECT ?s ?o WHERE { ?s ?p ?o . FILTER(isBlank(?o)) }", "SELECT s, o FROM t WHERE starts_with(o, '_:') UNION ALL SELECT '_:n' || n_nationkey, '_:r' || n_regionkey FROM nation", extend=_blanks),
    "filter_lang": Query("SELECT ?n ?l WHERE { ?n v:said ?l . FILTER(lang(?l) = 'en') }", "SELECT 'http://example.org/nation/' || n_nationkey AS n, n_name AS l FROM nation WHERE n_nationkey % 2 = 0", (REGION,), extend=_spoken),
    "filter_concat": _filter('concat(?n, "!") = "ASIA!"', "o = 'ASIA'"),
    "filter_seconds": Query("SELECT ?x ?d WHERE { ?x v:ts ?d . FILTER(seconds(?d) = '15') }", "SELECT s AS x, o AS d FROM t WHERE CAST(second(CAST(o AS TIMESTAMP)) AS INTEGER) = 15", _v("ts")),
    "agg_number_forms": Query("SELECT ?n (SUM(?x) AS ?total) WHERE { ?n v:amount ?x } GROUP BY ?n", "SELECT 'http://example.org/nation/' || n_nationkey AS n, CASE n_nationkey % 6 WHEN 0 THEN '+Inf' WHEN 1 THEN 'NaN' WHEN 2 THEN '3' WHEN 3 THEN '100' WHEN 4 THEN '-0.5' ELSE '0' END AS total FROM nation", (REGION,), extend=_amounts),
    "agg_distinct_rows": Query("SELECT DISTINCT ?s (COUNT(?c) AS ?n) WHERE { ?c v:segment ?s } GROUP BY ?s", "SELECT DISTINCT o AS s, CAST(count(*) AS VARCHAR) AS n FROM t GROUP BY o", (S,)),
    "agg_min_max_distinct": Query("SELECT ?b (MIN(DISTINCT ?s) AS ?least) (MAX(DISTINCT ?s) AS ?most) WHERE { ?p v:brand ?b . ?p v:size ?s } GROUP BY ?b", "SELECT p_brand AS b, CAST(min(p_size) AS VARCHAR) AS least, CAST(max(p_size) AS VARCHAR) AS most FROM part GROUP BY 1", (REGION,)),
    "filter_str": _filter('str(?n, "ASIA")', "o = 'ASIA'"),
    "filter_substr": _filter("substr(?n, 10)", "10 < strlen(o)"),
    "filter_strlen": _filter("strlen(?n) > 17", "length(o) > 17"),
    "filter_year": Query("SELECT ?o ?d WHERE { ?o v:date ?d . FILTER(year(?d) = '1995' && month(?d) = '3') }", "SELECT s AS o, t.o AS d FROM t WHERE year(CAST(t.o AS TIMESTAMP)) = 1995 AND month(CAST(t.o AS TIMESTAMP)) = 3", _v("date")),
    "filter_hours": Query("SELECT ?x ?d WHERE { ?x v:ts ?d . FILTER(hours(?d) = '5' || minutes(?d) = '30') }", "SELECT s AS x, o AS d FROM t WHERE hour(CAST(o AS TIMESTAMP)) = 5 OR minute(CAST(o AS TIMESTAMP)) = 30", _v("ts")),
    "filter_year_present": Query("SELECT ?o WHERE { ?o v:date ?d . FILTER(year(?d)) }", "SELECT s AS o FROM t", _v("date")),
    "filter_logic": _filter('!contains(?n, "A") && (strEnds(?n, "5") || strEnds(?n, "0"))', "NOT contains(o, 'A') AND (ends_with(o, '5') OR ends_with(o, '0'))"),
    "filter_numeric_compare": Query("SELECT ?c ?b WHERE { ?c v:acctbal ?b . ?c v:segment ?s . FILTER(?b >= 9000 && ?b < 9500.5) }", "SELECT a.s AS c, a.o AS b FROM t a JOIN t b USING (s) WHERE a.p = '%s' AND b.p = '%s' AND CAST(a.o AS DOUBLE) >= 9000 AND CAST(a.o AS DOUBLE) < 9500.5" % (A, S), (A, S)),
    "filter_variables": Query("SELECT ?a ?b WHERE { ?a v:inRegion ?r . ?b v:inRegion ?r . FILTER(?a != ?b) }", "SELECT a.s AS a, b.s AS b FROM t a JOIN t b USING (o) WHERE a.s <> b.s", (REGION,)),
    "filter_datatype": Query("SELECT ?x ?o WHERE { ?x ?p ?o . FILTER(datatype(?o) = '%s') }" % XSD.integer, "SELECT s AS x, o FROM t WHERE dt = '%s'" % XSD.integer),
    "distinct": Query("SELECT DISTINCT ?s ?st WHERE { ?o v:status ?st . ?o v:placedBy ?c . ?c v:segment ?s }", "SELECT DISTINCT c_mktsegment AS s, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey", (REGION,)),
    "limit_offset": Query("SELECT ?n ?b WHERE { ?c v:name ?n . ?c v:acctbal ?b } LIMIT 20 OFFSET 15", "SELECT a.o AS n, b.o AS b FROM t a JOIN t b USING (s) WHERE a.p = '%s' AND b.p = '%s' ORDER BY n, b LIMIT 20 OFFSET 15" % (NAME, A), (NAME, A)),
    "offset_past_end": Query("SELECT ?n WHERE { ?n v:inRegion ?r } OFFSET 1000", "SELECT s AS n FROM t WHERE false", (REGION,)),
    "order_by": Query("SELECT ?c ?b WHERE { ?c v:acctbal ?b } ORDER BY DESC(?b) LIMIT 25", "SELECT s AS c, o AS b FROM t ORDER BY CAST(o AS DOUBLE) DESC, o DESC, s LIMIT 25", (A,)),
    "agg_count": Query("SELECT ?s (COUNT(?c) AS ?n) WHERE { ?c v:segment ?s } GROUP BY ?s", "SELECT o AS s, CAST(count(*) AS VARCHAR) AS n FROM t GROUP BY o", (S,)),
    "agg_count_distinct": Query("SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(?c) AS ?all) WHERE { ?o v:placedBy ?c }", "SELECT CAST(count(DISTINCT o) AS VARCHAR) AS n, CAST(count(*) AS VARCHAR) AS \"all\" FROM t", (P,)),
    "agg_sum": Query("SELECT ?st (SUM(?t) AS ?total) WHERE { ?o v:status ?st . ?o v:totalprice ?t } GROUP BY ?st", "SELECT o_orderstatus AS st, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", (REGION,), rounded={"total": 2}),
    "agg_avg": Query("SELECT ?st (AVG(?t) AS ?mean) WHERE { ?o v:status ?st . ?o v:totalprice ?t } GROUP BY ?st", "SELECT o_orderstatus AS st, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1", (REGION,), rounded={"mean": 2}),
    "agg_min_max": Query("SELECT ?b (MIN(?s) AS ?least) (MAX(?s) AS ?most) WHERE { ?p v:brand ?b . ?p v:size ?s } GROUP BY ?b", "SELECT p_brand AS b, CAST(min(p_size) AS VARCHAR) AS least, CAST(max(p_size) AS VARCHAR) AS most FROM part GROUP BY 1", (REGION,)),
    "agg_min_max_text": Query("SELECT ?r (MIN(?n) AS ?first) (MAX(?n) AS ?last) WHERE { ?x v:inRegion ?r . ?x v:name ?n } GROUP BY ?r", "SELECT b.o AS r, min(a.o) AS \"first\", max(a.o) AS \"last\" FROM t a JOIN t b USING (s) WHERE a.p = '%s' AND b.p = '%s' GROUP BY 1" % (NAME, REGION), (NAME, REGION)),
    "agg_sum_distinct": Query("SELECT ?b (SUM(DISTINCT ?s) AS ?total) (COUNT(?s) AS ?n) WHERE { ?p v:brand ?b . ?p v:size ?s } GROUP BY ?b", "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS VARCHAR) AS total, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1", (REGION,)),
    "agg_avg_distinct": Query("SELECT (AVG(DISTINCT ?q) AS ?mean) WHERE { ?l v:quantity ?q }", "SELECT round(avg(DISTINCT l_quantity), 4) AS mean FROM lineitem", (REGION,), rounded={"mean": 4}),
    "agg_carried_variable": Query("SELECT ?r ?n (COUNT(?n) AS ?k) WHERE { ?n v:inRegion ?r } GROUP BY ?r", "SELECT o AS r, min(s) AS n, CAST(count(*) AS VARCHAR) AS k FROM t GROUP BY 1", (REGION,)),
    "agg_empty": Query("SELECT (COUNT(?x) AS ?n) (SUM(?x) AS ?total) (MIN(?x) AS ?least) WHERE { ?x v:nothing ?y }", "SELECT '0' AS n, '0' AS total, '' AS least", (REGION,)),
    "group_without_aggregate": Query("SELECT ?r WHERE { ?n v:inRegion ?r } GROUP BY ?r", "SELECT o AS r FROM t", (REGION,)),
    "optional_left": Query("SELECT ?d ?q WHERE { ?d v:lang 'de' . OPTIONAL { ?d v:quality ?q } }", "SELECT a.s AS d, b.o AS q FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '%s' WHERE a.p = '%s' AND a.o = 'de'" % _v("quality", "lang"), _v("quality", "lang")),
    "optional_progressive": Query(
        "SELECT ?d ?q ?x WHERE { ?d v:source 'src3' . OPTIONAL { ?d v:lang 'en' . ?d v:quality ?q . ?d v:toxic ?x } }",
        "SELECT 'http://example.org/doc/' || d.doc_id AS d, CAST(quality AS VARCHAR) AS q, CAST(toxic AS VARCHAR) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE source = 'src3'", (REGION,),
    ),
    "optional_standard": Query(
        "SELECT ?d ?q ?x WHERE { ?d v:source 'src3' . OPTIONAL { ?d v:lang 'en' . ?d v:quality ?q . ?d v:toxic ?x } }",
        "SELECT 'http://example.org/doc/' || d.doc_id AS d, CAST(quality AS VARCHAR) AS q, CAST(toxic AS VARCHAR) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en' WHERE source = 'src3'", (REGION,), optional="standard",
    ),
    "optional_filter_inside": Query("SELECT ?d ?q WHERE { ?d v:lang 'es' . OPTIONAL { ?d v:quality ?q . FILTER(?q = '0') } }", "SELECT a.s AS d, b.o AS q FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '%s' AND b.o = '0' WHERE a.p = '%s' AND a.o = 'es'" % _v("quality", "lang"), _v("quality", "lang")),
    "optional_twice": Query(
        "SELECT ?d ?q WHERE { ?d v:lang 'fr' . OPTIONAL { ?d v:quality ?q . } OPTIONAL { ?d v:source ?q } }",
        "SELECT a.s AS d, CASE WHEN b.o IS NULL THEN c.o ELSE b.o END AS q FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '%s' LEFT JOIN t c ON a.s = c.s AND c.p = '%s' AND (b.o IS NULL OR b.o = c.o) WHERE a.p = '%s' AND a.o = 'fr'" % _v("quality", "source", "lang"), _v("quality", "lang", "source"),
    ),
    "union_bag": Query("SELECT ?x ?n WHERE { { ?x v:inRegion ?n } UNION { ?x v:inNation ?n } }", "SELECT s AS x, o AS n FROM t", (REGION, N)),
    "union_three_branches": Query("SELECT ?x ?a ?b WHERE { { ?x v:inRegion ?a } UNION { ?x v:brand ?b } UNION { ?x v:inRegion ?a . ?x v:name ?b } }", "SELECT s AS x, o AS a, NULL AS b FROM t WHERE p = '{r}' UNION ALL SELECT s, NULL, o FROM t WHERE p = '{d}' UNION ALL SELECT a.s, a.o, b.o FROM t a JOIN t b USING (s) WHERE a.p = '{r}' AND b.p = '{n}'".format(r=REGION, d=V + "brand", n=NAME), (REGION, V + "brand", NAME)),
    "union_joined": Query("SELECT ?x ?n ?y WHERE { ?x v:name ?n . { ?x v:inRegion ?y } UNION { ?x v:segment ?y } }", "SELECT a.s AS x, a.o AS n, b.o AS y FROM t a JOIN t b USING (s) WHERE a.p = '%s' AND b.p IN ('%s', '%s')" % (NAME, REGION, S), (NAME, REGION, S)),
    "values_single": Query("SELECT ?x ?n WHERE { VALUES ?n { 'ASIA' 'EUROPE' 'ASIA' } ?x v:name ?n }", "SELECT s AS x, o AS n FROM t JOIN (VALUES ('ASIA'), ('EUROPE'), ('ASIA')) u(n) ON o = n", (NAME,)),
    "values_rows": Query("SELECT ?c ?s ?n WHERE { ?c v:segment ?s . ?c v:inNation ?n . VALUES (?s ?n) { ('BUILDING' <http://example.org/nation/3>) ('MACHINERY' <http://example.org/nation/5>) } }", "SELECT a.s AS c, a.o AS s, b.o AS n FROM t a JOIN t b USING (s) WHERE a.p = '%s' AND b.p = '%s' AND ((a.o = 'BUILDING' AND b.o = 'http://example.org/nation/3') OR (a.o = 'MACHINERY' AND b.o = 'http://example.org/nation/5'))" % (S, N), (S, N)),
    "values_undef": Query("SELECT ?c ?s ?n WHERE { ?c v:segment ?s . ?c v:inNation ?n . VALUES (?s ?n) { ('BUILDING' UNDEF) (UNDEF <http://example.org/nation/5>) } }", "SELECT a.s AS c, a.o AS s, b.o AS n FROM t a JOIN t b USING (s) JOIN (VALUES ('BUILDING', NULL), (NULL, 'http://example.org/nation/5')) u(vs, vn) ON (vs IS NULL OR vs = a.o) AND (vn IS NULL OR vn = b.o) WHERE a.p = '%s' AND b.p = '%s'" % (S, N), (S, N)),
    "skos_inverse_visible": Query("SELECT ?a ?b WHERE { ?a skos:narrower ?b }", "SELECT s AS a, o AS b FROM t", (SKOS.broader,), inference=Inference.BROADER),
    "skos_broader_count": Query(
        "SELECT (COUNT(?b) AS ?n) WHERE { ?a skos:broader ?b }",
        "SELECT CAST((SELECT count(*) FROM t) + (SELECT count(*) FROM closure) AS VARCHAR) AS n", (SKOS.broader,), inference=Inference.BROADER,
        more="closure AS (SELECT s, o FROM t UNION SELECT c.s, t.o FROM closure c JOIN t ON t.s = c.o)",
    ),
    "skos_related_both_ways": Query("SELECT ?a ?b WHERE { ?a skos:related ?b }", "SELECT s AS a, o AS b FROM t UNION ALL SELECT o, s FROM (SELECT DISTINCT s, o FROM t)", (SKOS.related,), inference=Inference.RELATED),
    "skos_join_inferred": Query(
        "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c skos:broader ?r . ?r v:name ?n . ?r a skos:ConceptScheme . ?c v:segment 'BUILDING' } GROUP BY ?n",
        "SELECT r_name AS n, CAST(count(*) AS VARCHAR) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1", (REGION,), inference=Inference.BROADER,
    ),
}
