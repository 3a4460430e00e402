"""Each stage and the whole against plain Python on the smallest documents; queries against their SQL."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_lines import brute as cleaned
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_mixing import packed
from tests.llm.test_simhash import brute as near
from tests.llm.test_simhash import groups
from tripleframe.llm import common, decontam, mixing, quality
from tripleframe.llm.mixing import unpack

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(spark, docs):
    """The rows of the first four stages, stage by stage."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    good, bad = quality.probabilities(quality.fit(quality.labelled(frame, labels, 3000)), pa.array([r[1] for r in docs], pa.string()))
    docs = [r for r, g, b in zip(docs, good, bad) if g >= 0.5 and b <= 0.5]
    yield docs
    docs = cleaned(docs, 10)
    yield docs
    gone = groups(near([(r[0], r[1]) for r in docs]))
    docs = [r for r in docs if r[0] not in gone]
    yield docs
    shown = decontam.normal(F.col("text")).alias("t")
    texts = [r.t or "" for r in spark.createDataFrame([(r[1],) for r in docs], "text string").select(shown).collect()]
    items = [(r.item_id, r.t) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", shown).collect()]
    hit = {d for d, _ in leaks_exact(texts, items)}
    yield [r for i, r in enumerate(docs) if i not in hit]


def leaks_exact(texts, items):
    """Passages that are in a text as they are; the inexact ones are for test_decontam, as full alignment is slow."""
    index = decontam.Index(items)
    short = {(d, item) for item, words in index.short for d, t in enumerate(texts) if f" {words} " in f" {t} "}
    return short | {(d, index.item[index.owner(s)]) for s in range(len(index.start)) for d, t in enumerate(texts) if index.passage(s) in t.encode()}


def test_stages_and_run(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    *filters, (last, mix) = corpus_pipeline.STAGES
    for (name, stage), want in zip(filters, brute(spark, docs)):
        frame = spark.createDataFrame(stage(spark, frame, SF).collect(), frame.schema)
        assert frame.columns == COLUMNS, name
        assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want)), name
    assert 0 < frame.count() < len(docs)
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = [tuple(r) for r in frame.select("doc_id", "text", "source").collect()]
    want = mixed(spark, kept, mixing.BLOCK, mixing.SHARD, -(-sum(map(len, packed(spark, kept, mixing.BLOCK).values())) // mixing.SHARD), mixing.TARGETS, mixing.OTHERS)
    assert sorted((*r[:7], unpack(r.tokens, r.n_tokens)) for r in rows) == want


def test_run_of_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, an extra column, and tables without rows, through all stages; what stages leave is removed."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(None, words, "en", "s", 1, "k"), (1, None, "en", "s", 0, "k"), (2, "", None, None, 0, None), (3, words + " x", "en", "s", 9, "k"), (3, words + " x", "en", "s", 9, "k")]
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for i, docs in enumerate((rows, [])):
        at = str(tmp_path / str(i))
        for name, df in (("documents", spark.createDataFrame(docs, schema)), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(f"{at}/{name}.parquet")
        before = len(common.WRITTEN)
        out = corpus_pipeline.run(spark, at)
        got = out.where("epoch = 0").collect()
        assert sorted({r.source for r in got}) == (["", "s"] if docs else []) and len(common.WRITTEN) == before
        assert {d for r in got for d in r.doc_ids} == ({2, 3} if docs else set())
        made = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
        assert os.listdir(os.path.dirname(made)) == ["mix_sources"]


def test_stage_inputs(spark):
    """Nulls, empty tables and extra columns go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, tf_text int, `a.b` int, Lang string"
    rows = [(None, "some words here", None, None, None, "k", 1), (1, None, "en", "s", 0, None, None), (2, "", "en", "s", 0, "k", 2), (3, "one two three " * 30, "en", "s", 9, "k", 3), (3, "one two three " * 30, "en", "s", 9, "k", 3)]
    rows = [(*r, 4, "x") for r in rows]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            out.collect()
            assert name == "mix_sources" or out.columns == df.columns
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_line_dedup", "op8_chat_format"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*order).collect()))) == sorted(map(repr, want.fetchall()))


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
