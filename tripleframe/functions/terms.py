"""Tests and parts of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleframe.model import RDF

EXTERNAL = r"^(https?://|urn:)"


def is_uri(c: Column) -> Column:
    return c.rlike(EXTERNAL)


def is_http(c: Column) -> Column:
    return c.rlike("^https?://")


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def is_member(c: Column) -> Column:
    """rdf:_1, rdf:_2, .."""
    return c.startswith(RDF + "_")


def authority(c: Column) -> Column:
    """Host and port; "" where the term is no address."""
    return F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("AUTHORITY")), F.lit("")), "^.*@", "")


def local_name(c: Column) -> Column:
    """After the last # or /."""
    return F.regexp_extract(c, r"([^#/]*)$", 1)


def namespace(c: Column) -> Column:
    """Through the last # or /; "_" for blank nodes, "" without either sign."""
    return F.when(is_blank(c), F.lit("_")).otherwise(F.regexp_extract(c, r"^(.*[#/])", 1))


def normal_label(c: Column) -> Column:
    """Without @language, outer blanks and case."""
    return F.lower(F.trim(F.regexp_replace(c, "@[^@]*$", "")))


def label_language(c: Column) -> Column:
    """What follows the last @."""
    return F.when(c.contains("@"), F.regexp_extract(c, "@([^@]*)$", 1)).otherwise(F.lit(""))
