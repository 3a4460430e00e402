"""Patterns over streams that are run to their end."""

from __future__ import annotations

import __spark_entry__ as entry
from tests.helpers import EX
from tripleframe.model import triples, triples_of
from tripleframe.streaming.match import drained, stream_query

SF = "/root/testdata/sf0.01"


def test_a_drained_stream_is_not_kept_on_the_driver(spark):
    customers = {r.c_custkey: r.c_mktsegment for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    want = sorted((f"http://example.org/event/{r.event_id}", customers[r.user_id]) for r in events if r.user_id in customers)
    first, second = (entry.queries()["stream_pattern"](spark, SF) for _ in range(2))
    assert first.inputFiles() and not set(first.inputFiles()) & set(second.inputFiles())
    assert sorted(map(tuple, first.select("e", "s").collect())) == sorted(map(tuple, second.select("e", "s").collect())) == want


def test_a_stream_without_files_has_no_solutions(spark, tmp_path):
    static = triples_of(spark, [(EX + "a", EX + "q", EX + "b")])
    for rows in ([], [(EX + "x", EX + "p", EX + "a"), (EX + "y", EX + "p", EX + "z")]):
        at = str(tmp_path / f"in{len(rows)}")
        (tmp_path / f"in{len(rows)}").mkdir()
        if rows:
            spark.createDataFrame(rows, "subject string, predicate string, object string").write.mode("append").parquet(at)
        moving = triples(spark.readStream.schema("subject string, predicate string, object string").parquet(at))
        out = drained(stream_query(moving, static, f"SELECT ?x ?b WHERE {{ ?x <{EX}p> ?a . ?a <{EX}q> ?b }}", {EX + "p"}))
        assert [tuple(r) for r in out.select("x", "b").collect()] == ([(EX + "x", EX + "b")] if rows else [])
