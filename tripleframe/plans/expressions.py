"""Filter expressions to columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tripleframe.functions.numbers import number
from tripleframe.functions.terms import is_blank, is_uri
from tripleframe.model import RDF
from tripleframe.plans.ir import Call, Iri, Literal, Term, Var

#: of a pattern: what linear-time regular expressions do not have
FOREIGN = re.compile(r"\(\?[=!]|\(\?<[=!]|\(\?>|\\[1-9]|[*+?}]\+")


def pattern_ok(spark: SparkSession, pattern: str) -> bool:
    if FOREIGN.search(pattern):
        return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


class Expressions:
    """`names`: the columns of the variables in scope; an unbound variable is ""."""

    def __init__(self, spark: SparkSession, names: dict[str, str], extras: dict[str, dict[str, str]], functions: dict[str, Callable[..., Column]] | None = None):
        self.spark, self.names, self.extras, self.functions = spark, names, extras, functions or {}

    def raw(self, name: str) -> Column:
        return F.col(self.names[name]) if name in self.names else F.lit(None).cast("string")

    def value(self, e: Call | Term) -> Column:
        """The expression as a string."""
        if isinstance(e, Var):
            return F.coalesce(self.raw(e.name), F.lit(""))
        if isinstance(e, Iri | Literal):
            return F.lit(e.value)
        a = [self.value(x) for x in e.args]
        if e.name in self.functions:
            return F.coalesce(self.functions[e.name](*a).cast("string"), F.lit(""))
        match e.name:
            case "str":
                return a[0]
            case "lcase":
                return F.lower(a[0])
            case "ucase":
                return F.upper(a[0])
            case "replace":
                return F.replace(a[0], a[1], a[2])
            case "concat":
                return F.concat(*a)
            case "strlen":
                return F.length(a[0]).cast("string")
            case "substr":
                n = F.greatest(self.integer(e.args[1]), F.lit(1))
                return F.substr(a[0], n, self.integer(e.args[2])) if len(a) > 2 else F.substr(a[0], n)
            case "year" | "month" | "day" | "hours" | "minutes" | "seconds":
                part = {"hours": F.hour, "minutes": F.minute, "seconds": F.second, "year": F.year, "month": F.month, "day": F.dayofmonth}[e.name]
                return F.coalesce(part(F.try_to_timestamp(a[0])).cast("string"), F.lit(""))
            case "lang" | "datatype":
                name = e.args[0].name if isinstance(e.args[0], Var) else None
                column = self.extras.get(name, {}).get(e.name)
                return F.coalesce(F.col(column), F.lit("")) if column else F.lit("")
            case "cardinal":
                return F.coalesce(F.nullif(F.regexp_extract(a[0], "^" + re.escape(RDF) + r"_(\d+)$", 1), F.lit("")), F.lit(""))
        return F.when(self.truth(e), "true").otherwise("false")

    def integer(self, e: Call | Term) -> Column:
        return F.coalesce(self.value(e).try_cast("int"), F.lit(0))

    def truth(self, e: Call | Term) -> Column:
        """The expression as a condition, never null. Functions of strings have a condition of their own."""
        if not isinstance(e, Call):
            return self.value(e) != ""
        if e.name in self.functions:
            return ~self.value(e).isin("", "false")
        match e.name:
            case "&&":
                return self.truth(e.args[0]) & self.truth(e.args[1])
            case "||":
                return self.truth(e.args[0]) | self.truth(e.args[1])
            case "!":
                return ~self.truth(e.args[0])
            case "bound":
                return self.raw(e.args[0].name).isNotNull()
            case "regex":
                text = e.args[1]
                if isinstance(text, Literal | Iri):
                    return self.value(e.args[0]).rlike(text.value) if pattern_ok(self.spark, text.value) else F.lit(False)
                return F.coalesce(F.rlike(self.value(e.args[0]), self.value(text)), F.lit(False))
            case "<" | ">" | "<=" | ">=":
                x, y = (self.value(v) for v in e.args)
                m, n = number(x), number(y)
                compare = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[e.name]
                return F.when(m.isNotNull() & n.isNotNull(), compare(m, n)).otherwise(compare(x, y))
        a = [self.value(x) for x in e.args]
        match e.name:
            case "=":
                return a[0] == a[1]
            case "!=":
                return a[0] != a[1]
            case "contains":
                return F.contains(a[0], a[1])
            case "strstarts":
                return F.startswith(a[0], a[1])
            case "strends":
                return F.endswith(a[0], a[1])
            case "lcase":
                return F.lower(a[0]) == F.lower(a[1]) if len(a) > 1 else F.lit(True)
            case "ucase":
                return F.upper(a[0]) == F.upper(a[1]) if len(a) > 1 else F.lit(True)
            case "replace":
                return F.replace(a[0], a[1], a[2]) != a[0]
            case "str":
                return a[0] == a[1] if len(a) > 1 else a[0] != ""
            case "substr":
                return self.integer(e.args[1]) < F.octet_length(a[0])
            case "isuri":
                return is_uri(a[0])
            case "isliteral":
                return ~is_uri(a[0])
            case "isblank":
                return is_blank(a[0])
            case "lang" | "datatype" | "concat" | "cardinal":
                return self.value(e) != ""
        return a[0] != ""


