"""Transitive closure of an edge relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.runtime import cut


def closure(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst): distinct pairs that a path of one edge or more joins, within each value of `by`.

    Semi-naive with doubling: the pairs that are new in a round are extended by all known ones, so the rounds are the
    logarithm of the longest shortest path. Each round is cut in the shared folder. A node on a cycle reaches itself.
    """
    keys = list(by)
    known = delta = cut(edges.select(*keys, "src", "dst").dropna(subset=["src", "dst"]).distinct())
    while True:
        step = known.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col("src").alias("mid"), F.col("dst").alias("far"))
        on = F.col("dst") == F.col("mid")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"n_{k}"))
        found = delta.join(step, on).select(*keys, "src", F.col("far").alias("dst")).distinct()
        same = [found[c].eqNullSafe(known[c]) if c in keys else found[c] == known[c] for c in [*keys, "src", "dst"]]
        delta = cut(found.join(known, same, "left_anti"))
        if delta.isEmpty():
            return known
        known = cut(known.unionByName(delta))


def reach(edges: DataFrame, start: str) -> DataFrame:
    """(node): what a path of one edge or more leads to from `start`. Only the frontier of each step is joined."""
    e = edges.select("src", "dst").dropna().distinct()
    seen = frontier = cut(e.where(F.col("src") == start).select(F.col("dst").alias("node")))
    while not frontier.isEmpty():
        found = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def reaches(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(src, dst): what a path of one edge or more leads to from each `src` of `starts`; pairs of other nodes are not made."""
    e = edges.select("src", "dst").dropna().distinct()
    seen = frontier = cut(e.join(starts.select("src").distinct(), "src", "left_semi"))
    step = e.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    while not frontier.isEmpty():
        found = frontier.join(step, F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst")).distinct()
        frontier = cut(found.join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def core(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """The edges that can be on a cycle: those from nodes that nothing leads to, and to nodes that lead nowhere, are
    taken off, round by round; the result has all cycles, whatever the number of rounds."""
    e = edges.select("src", "dst").dropna().distinct()
    left = None
    for _ in range(rounds):
        ends = e.select(F.col("src").alias("n")).distinct().join(e.select(F.col("dst").alias("n")).distinct(), "n")
        inside = e.join(ends.withColumnRenamed("n", "src"), "src", "left_semi").join(ends.withColumnRenamed("n", "dst"), "dst", "left_semi")
        e = cut(inside.select("src", "dst"))
        n = e.count()
        if n == left or not n:
            break
        left = n
    return e
