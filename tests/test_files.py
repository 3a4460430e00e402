"""Names of blank nodes, order of files, and imports."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import EX
from tripleframe.sources import rdfxml, reader, turtle

P = f"@prefix : <{EX}> .\n"
OWL = "http://www.w3.org/2002/07/owl#"


def test_blank_nodes_of_equal_texts_stay_apart(spark, tmp_path):
    text = P + ":a :p [ :q 1 ] ."
    names = {r["object"] for where in ("x", "y", "x") for r in turtle.parse_triples(text, where) if r["object"].startswith("_:")}
    assert len(names) == 2 and all(len(n.split("_")[1].removeprefix(":tb")) == 24 for n in names)
    xml = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="{EX}"><e:N/></rdf:RDF>'
    assert rdfxml.parse_triples(xml, "x")[0]["subject"] != rdfxml.parse_triples(xml, "y")[0]["subject"]
    for name in ("one.ttl", "two.ttl"):
        (tmp_path / name).write_text(text)
    df = reader.read_triples(spark, str(tmp_path))
    assert df.where(F.startswith("subject", F.lit("_:"))).select("subject").distinct().count() == 2


def test_numbers_follow_paths():
    files = [f"file:///d/{n}" for n in ("y/a.ttl", "x/a.ttl", "x/ba.ttl", "x/b%20c.ttl", "z.ttl")]
    assert reader.numbered(files, ["/d/x/ba.ttl", "/d/y/a.ttl", "/d/x/a.ttl", "/d/x/b c.ttl", "/d/z.ttl"]) == {files[2]: 0, files[0]: 1, files[1]: 2, files[3]: 3, files[4]: 4}
    assert list(reader.numbered(files, ["/d/y", "/d/x"])) == [files[0], files[1], files[3], files[2], files[4]], "a folder's files by name"
    assert list(reader.numbered(files, ["/d/?/*.ttl", "/d/z.ttl"])) == [files[1], files[3], files[2], files[0], files[4]]
    assert list(reader.numbered(["s3://b/k/2", "s3://b/k/1"], ["s3://b/k"])) == ["s3://b/k/1", "s3://b/k/2"]


def test_order_of_files(spark, tmp_path):
    for name in ("x/a.ttl", "y/a.ttl", "x/ba.ttl", "x/sub dir.ttl"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(P + f":s :p '{name}' .")
    paths = [str(tmp_path / n) for n in ("y/a.ttl", "x/ba.ttl", "x/a.ttl")]
    assert [r.object for r in reader.read_triples(spark, paths).orderBy("pos").collect()] == ["y/a.ttl", "x/ba.ttl", "x/a.ttl"]
    rows = reader.read_triples(spark, [str(tmp_path / "y"), str(tmp_path / "x")]).select("object", F.shiftright("pos", 32).alias("nr")).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("y/a.ttl", 0), ("x/a.ttl", 1), ("x/ba.ttl", 2), ("x/sub dir.ttl", 3)]


def test_imports(spark, tmp_path):
    os.makedirs(tmp_path / "deep/er")
    (tmp_path / "root.ttl").write_text(P + f":root <{OWL}imports> <deep/one.ttl> , <http://web/x.ttl> .")
    (tmp_path / "deep/one.ttl").write_text(P + f":one <{OWL}imports> <er/two.ttl> , <../root.ttl> .")
    (tmp_path / "deep/er/two.ttl").write_text(P + f":two <{OWL}imports> <../one.ttl> , <{tmp_path}/three.ttl> .")
    (tmp_path / "three.ttl").write_text(P + ":three :p 1 .")
    df = reader.read_with_imports(spark, str(tmp_path / "root.ttl"))
    assert [r.subject[len(EX) :] for r in df.groupBy("subject").agg(F.min("pos").alias("at")).orderBy("at").collect()] == ["root", "one", "two", "three"]
    (tmp_path / "other.ttl").write_text(P + f":other <{OWL}imports> <lost.ttl> , <three.ttl> .")
    with pytest.raises(FileNotFoundError, match="lost.ttl"):
        reader.read_with_imports(spark, str(tmp_path / "other.ttl"))
    both = reader.read_with_imports(spark, [str(tmp_path / "root.ttl"), str(tmp_path / "other.ttl")], missing="skip")
    assert {r.subject[len(EX) :] for r in both.select("subject").distinct().collect()} == {"root", "one", "two", "three", "other"} and both.where(F.col("subject") == EX + "three").count() == 1
    with pytest.raises(ValueError):
        reader.read_with_imports(spark, str(tmp_path / "root.ttl"), missing="maybe")


def test_another_format(spark, tmp_path):
    reader.register_parser("lines", lambda text: [{"subject": x, "predicate": "p", "object": "o", "is_literal": False, "is_triple_term": False, "pos": i} for i, x in enumerate(text.split())])
    try:
        (tmp_path / "a.txt").write_text("x y")
        assert [r.subject for r in reader.read_triples(spark, str(tmp_path / "a.txt"), kind="lines").orderBy("pos").collect()] == ["x", "y"]
    finally:
        del reader.PARSERS["lines"]
