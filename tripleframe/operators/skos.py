"""SKOS inference at query time: triples with inferred ones appended, nothing deduplicated."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.terms import authority
from tripleframe.model import SKOS, inferred, triples
from tripleframe.operators.closure import closure


class Inference(Enum):
    NONE = "none"
    BROADER = "broader"
    NARROWER = "narrower"
    RELATED = "related"
    EXACT_MATCH = "exactMatch"
    CLOSE_MATCH = "closeMatch"
    ALL = "all"


class Authority(Enum):
    NONE = "none"
    FULL = "full"
    AUTHORITY = "authority"


def edges(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.col("predicate") == predicate)


def inverse(df: DataFrame, predicate: str, other: str) -> DataFrame:
    """(s other o) for each (s predicate o): subject and object keep their places."""
    return edges(df, predicate).select(*inferred("subject", other, "object", F.col("graph")))


def transitive(df: DataFrame, predicate: str) -> DataFrame:
    """Within each graph, a triple for each pair that is joined by a path, also for direct ones."""
    e = edges(df, predicate).select("graph", F.col("subject").alias("src"), F.col("object").alias("dst"))
    return closure(e, ("graph",)).select(*inferred("src", predicate, "dst", F.col("graph")))


def symmetric(df: DataFrame) -> DataFrame:
    """(o related s) for each distinct pair over all graphs, also where it is there."""
    return edges(df, SKOS.related).select("subject", "object").distinct().select(*inferred("object", SKOS.related, "subject", ""))


def targets(e: DataFrame) -> DataFrame:
    """(d, only, many): each object, with its least subject and whether it has others."""
    return e.groupBy(F.col("object").alias("d")).agg(F.min("subject").alias("only"), (F.min("subject") < F.max("subject")).alias("many"))


def exact_match(df: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """Each target d of a match of s with every endpoint o other than s and d, and the reverse.

    A target of two subjects or more goes with every other endpoint, so pairs are made once, targets times endpoints.
    `max_pairs` raises beyond edges times endpoints instead of starting it.
    """
    e = edges(df, SKOS.exactMatch).select("subject", "object")
    ends = e.select(F.explode(F.array("subject", "object")).alias("o")).distinct()
    if max_pairs is not None:
        n = e.count() * ends.count()
        if n > max_pairs:
            raise ValueError(f"exactMatch would compare {n} pairs")
    pairs = targets(e).join(ends, (F.col("o") != F.col("d")) & (F.col("many") | (F.col("o") != F.col("only")))).select("d", "o")
    return pairs.select(*inferred("d", SKOS.exactMatch, "o", "")).unionByName(pairs.select(*inferred("o", SKOS.exactMatch, "d", "")))


def linked(members: DataFrame) -> DataFrame:
    """(subject, class, copies, links, whole) of (subject, class, copies), the members of classes: `whole` is the sum of
    the class's copies, and a member has copies * (whole - 1) links to its class, each copy one to every other copy.

    The classes are all pairs, one row a member: a and b of a class are linked copies(a) * copies(b) times, a and itself
    copies(a) * (copies(a) - 1) times.
    """
    whole = members.groupBy("class").agg(F.sum("copies").alias("whole"))
    return members.join(whole, "class").select("subject", "class", "copies", (F.col("copies") * (F.col("whole") - 1)).alias("links"), "whole")


#: copies that meet their whole class in one task, at most about so many
PIECE = 1024


def meetings(classes: DataFrame) -> DataFrame:
    """The links of `linked`, each an exactMatch triple: quadratic in a class. The class is sent to each of its pieces, so
    no task makes all its pairs, and the number of tasks is not left to sizes: these rows are small beside their pairs."""
    n, pieces = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.ceil(F.col("whole") / PIECE)
    each = classes.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    one = each.select("class", F.pmod(F.xxhash64("subject", "k"), pieces).alias("piece"), "subject", "k")
    other = each.select("class", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"), F.col("subject").alias("s2"), F.col("k").alias("k2"))
    met = one.repartition(n, "class", "piece").join(other.repartition(n, "class", "piece"), ["class", "piece"])
    return met.where((F.col("subject") != F.col("s2")) | (F.col("k") != F.col("k2"))).select(*inferred("subject", SKOS.exactMatch, "s2", ""))


def close_classes(df: DataFrame) -> DataFrame:
    """The subjects of closeMatch by target, as `linked` has them; copies are equal edges. A subject of several targets has a
    row for each. The links are those between subjects: each copy also links subject and target, both ways."""
    e = edges(df, SKOS.closeMatch).select("subject", F.col("object").alias("class"))
    return linked(e.groupBy("subject", "class").agg(F.count(F.lit(1)).alias("copies")))


def close_match(df: DataFrame) -> DataFrame:
    """closeMatch as exactMatch, both ways, and every link of `close_classes`. Quadratic in a target's subjects."""
    e = edges(df, SKOS.closeMatch)
    direct = [e.select(*inferred(a, SKOS.exactMatch, b, "")) for a, b in (("subject", "object"), ("object", "subject"))]
    return reduce(DataFrame.unionByName, [*direct, meetings(close_classes(df))])


def authority_classes(df: DataFrame) -> DataFrame:
    """The terms that are subjects, by host, as `linked` has them; those without a host are in no class.

    Copies count the triples with the term as subject, twice where the object is on the same host.
    """
    t = df.select("subject", authority(F.col("subject")).alias("class"), authority(F.col("object")).alias("other")).where("class <> ''")
    return linked(t.groupBy("class", "subject").agg(F.sum(F.when(F.col("class") == F.col("other"), 2).otherwise(1)).alias("copies")))


def authority_match(df: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """exactMatch between all terms of a host, every link of `authority_classes`. Quadratic in a host's terms; `max_pairs`
    raises beyond the sum of the squares of the hosts' copies."""
    classes = authority_classes(df)
    if max_pairs is not None:
        n = classes.agg(F.sum(F.col("copies") * F.col("whole"))).first()[0] or 0
        if n > max_pairs:
            raise ValueError(f"authority matching would make {n} pairs")
    return meetings(classes)


def branches(mode: Inference, host: Authority, max_pairs: int | None = None) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """Each rule of the mode, with the predicate of its output. `max_pairs` guards those that are quadratic."""
    if mode is Inference.NONE:
        return []
    up = [(SKOS.narrower, lambda t: inverse(t, SKOS.broader, SKOS.narrower)), (SKOS.broader, lambda t: transitive(t, SKOS.broader))]
    down = [(SKOS.broader, lambda t: inverse(t, SKOS.narrower, SKOS.broader)), (SKOS.narrower, lambda t: transitive(t, SKOS.narrower))]
    by = {Inference.BROADER: up, Inference.NARROWER: down, Inference.RELATED: [(SKOS.related, symmetric)], Inference.EXACT_MATCH: [(SKOS.exactMatch, lambda t: exact_match(t, max_pairs))], Inference.CLOSE_MATCH: [(SKOS.exactMatch, close_match)]}
    out = [x for m, rules in by.items() if mode in (m, Inference.ALL) for x in rules]
    return out + [(SKOS.exactMatch, lambda t: authority_match(t, max_pairs))] * (host is Authority.AUTHORITY)


def infer(df: DataFrame, mode: Inference = Inference.ALL, host: Authority = Authority.NONE, max_pairs: int | None = None) -> DataFrame:
    """The triples, and what each rule of the mode infers from them. Authority matching needs a mode as well."""
    df = triples(df)
    return reduce(DataFrame.unionByName, [df, *(rule(df) for _, rule in branches(mode, host, max_pairs))])


