"""Select to a DataFrame: patterns are filters on triples, groups are joins; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleframe.functions.numbers import number, show
from tripleframe.functions.terms import is_member
from tripleframe.model import MAGIC
from tripleframe.plans.expressions import Expressions
from tripleframe.plans.ir import Aggregate, Call, Group, Iri, Literal, Pattern, Select, Term, Var

Scan = Callable[[str | None], DataFrame]


@dataclass
class Rows:
    """Solutions. `names`: column of each variable; `maybe`: variables that can be unbound; `extras`: columns of language
    and datatype of variables that a filter asks for."""

    df: DataFrame
    names: dict[str, str] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)
    extras: dict[str, dict[str, str]] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [*self.names.values(), *(c for x in self.extras.values() for c in x.values())]


class Compiler:
    def __init__(self, spark: SparkSession, scan: Scan, optional: str = "progressive", functions: dict[str, Callable[..., Column]] | None = None):
        if optional not in ("progressive", "standard"):
            raise ValueError("optional is progressive or standard")
        self.spark, self.scan, self.optional, self.functions = spark, scan, optional, functions or {}
        self.numbers: dict[str, int] = {}
        self.asked: set[str] = set()
        self.fresh = 0

    def column(self, variable: str) -> str:
        """Columns are compared without case, variables with it."""
        return f"v{self.numbers.setdefault(variable, len(self.numbers))}"

    # patterns

    def pattern(self, p: Pattern) -> Rows:
        wildcard = isinstance(p.predicate, Iri) and p.predicate.value == MAGIC + "anySlot"
        df = self.scan(p.predicate.value if isinstance(p.predicate, Iri | Literal) and not wildcard else None)
        rows, select = Rows(df), []
        for place, term in (("subject", p.subject), ("predicate", p.predicate), ("object", p.object)):
            c = F.col(place)
            if place == "predicate" and wildcard:
                df = df.where(is_member(c))
            elif not isinstance(term, Var):
                df = df.where(c == term.value)
                if isinstance(term, Literal) and term.language:
                    df = df.where(F.lower("language") == term.language.lower())
                if isinstance(term, Literal) and term.datatype:
                    df = df.where(F.col("datatype") == term.datatype)
            elif term.name in rows.names:
                df = df.where(c == next(x for n, x in select if n == term.name))
            else:
                rows.names[term.name] = self.column(term.name)
                select.append((term.name, c))
        out = [c.alias(rows.names[n]) for n, c in select]
        if isinstance(p.object, Var) and p.object.name in self.asked:
            base = self.column(p.object.name)
            rows.extras[p.object.name] = {"lang": f"{base}_lang", "datatype": f"{base}_datatype"}
            out += [F.col("language").alias(f"{base}_lang"), F.col("datatype").alias(f"{base}_datatype")]
        rows.df = df.select(*out) if out else df.select(F.lit(1).alias("v_none"))
        return rows

    @staticmethod
    def order(patterns: list[Pattern]) -> list[Pattern]:
        """Connected before disconnected, most constants first, then textual: inner joins of bags commute."""
        left, out, seen = list(enumerate(patterns)), [], set()
        while left:
            best = min(left, key=lambda x: (bool(seen) and not seen & set(x[1].variables()), len(x[1].variables()), x[0]))
            left.remove(best)
            out.append(best[1])
            seen |= set(best[1].variables())
        return out

    def join(self, a: Rows, b: Rows, how: str = "inner") -> Rows:
        """Natural join; a variable that can be unbound is compatible with anything while it is unbound."""
        shared = [v for v in a.names if v in b.names]
        exact = [v for v in shared if v not in a.maybe and v not in b.maybe]
        # without a key, rows that have the variable are joined by it, and only the others are compatible with all
        if not exact and (v := next((v for v in shared if v in a.maybe), None)):
            return self.apart(a, b, how, v)
        if not exact and how == "inner" and shared:
            return self.apart(b, a, how, shared[0])
        names = {**a.names, **{v: c for v, c in b.names.items() if v not in a.names}}
        maybe = {v for v in a.maybe | b.maybe if not ((v in a.names and v not in a.maybe) or (v in b.names and v not in b.maybe))}
        if how == "left":
            maybe = a.maybe | {v for v in b.names if v not in a.names}
        extras = {**{v: x for v, x in b.extras.items()}, **a.extras}
        taken = set(a.columns())
        right = b.df.select(*([F.col(c).alias(f"r_{c}") if c in taken else F.col(c) for c in b.columns()] or [F.lit(1).alias(self.unique())]))
        conditions = []
        for v in shared:
            x, y = F.col(a.names[v]), F.col(f"r_{b.names[v]}")
            test = x == y
            if v not in exact:
                test = reduce(Column.__or__, [test, *([x.isNull()] if v in a.maybe else []), *([y.isNull()] if v in b.maybe else [])])
            conditions.append(test)
        df = a.df.join(right, reduce(Column.__and__, conditions), how) if conditions else a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        out = []
        for v, c in names.items():
            both = v in a.names and v in b.names and v in a.maybe
            out.append(F.coalesce(F.col(c), F.col(f"r_{b.names[v]}")).alias(c) if both else F.col(c))
        for v, x in extras.items():
            for c in x.values():
                both = v in a.extras and v in b.extras
                out.append(F.coalesce(F.col(c), F.col(f"r_{c}")).alias(c) if both else F.col(c))
        return Rows(df.select(*out) if out else df.select(F.lit(1).alias("v_none")), names, maybe, extras)

    def apart(self, a: Rows, b: Rows, how: str, v: str) -> Rows:
        """The join of the rows of `a` where `v` is bound, and of those where it is not, on which it then has no bearing."""
        column, own = a.names[v], set(a.extras.get(v, {}).values())
        bound = Rows(a.df.where(F.col(column).isNotNull()), a.names, a.maybe - {v}, a.extras)
        free = Rows(a.df.where(F.col(column).isNull()).drop(column, *own), {x: c for x, c in a.names.items() if x != v}, a.maybe - {v}, {x: e for x, e in a.extras.items() if x != v})
        parts = [self.join(bound, b, how), self.join(free, b, how)]
        names, extras = parts[0].names, parts[0].extras
        frames = []
        for p in parts:
            pairs = [(p.names[x], c) for x, c in names.items()] + [(p.extras.get(x, {}).get(k), c) for x, e in extras.items() for k, c in e.items()]
            frames.append(p.df.select(*[(F.col(x) if x in p.df.columns else F.lit(None).cast("string")).alias(c) for x, c in pairs]) if pairs else p.df)
        maybe = parts[0].maybe | parts[1].maybe
        return Rows(frames[0].unionByName(frames[1]), names, maybe, extras)

    def unique(self) -> str:
        self.fresh += 1
        return f"x{self.fresh}"

    def patterns(self, patterns: list[Pattern]) -> Rows | None:
        out = None
        for p in self.order(patterns):
            out = self.pattern(p) if out is None else self.join(out, self.pattern(p))
        return out

    # groups

    def group(self, g: Group) -> Rows:
        rows = self.patterns(g.patterns)
        for v in g.values:
            rows = self.joined(rows, self.values(v))
        for branches in g.unions:
            rows = self.joined(rows, self.union([self.group(b) for b in branches]))
        if rows is None:
            rows = Rows(self.spark.range(1).select(F.lit(1).alias("v_none")))
        for o in g.optionals:
            rows = self.optionally(rows, o)
        for f in g.filters:
            rows.df = rows.df.where(Expressions(self.spark, rows.names, rows.extras, self.functions).truth(f))
        return rows

    def joined(self, a: Rows | None, b: Rows) -> Rows:
        return b if a is None else self.join(a, b)

    def values(self, v) -> Rows:
        names = {n: self.column(n) for n in v.variables}
        schema = ", ".join(f"{c} string" for c in names.values())
        df = self.spark.createDataFrame([tuple(r) for r in v.rows], schema)
        # the rows are those written in the query
        return Rows(F.broadcast(df), names, {n for i, n in enumerate(v.variables) if any(r[i] is None for r in v.rows)})

    def union(self, branches: list[Rows]) -> Rows:
        names = {v: c for b in branches for v, c in b.names.items()}
        maybe = {v for v in names for b in branches if v not in b.names or v in b.maybe}
        extras = {v: x for b in branches for v, x in b.extras.items()}
        columns = [*names.values(), *(c for x in extras.values() for c in x.values())]
        parts = [b.df.select(*[F.col(c) if c in b.columns() else F.lit(None).cast("string").alias(c) for c in columns]) if columns else b.df for b in branches]
        return Rows(reduce(DataFrame.unionByName, parts), names, maybe, extras)

    def optionally(self, rows: Rows, o: Group) -> Rows:
        plain = not (o.values or o.unions or o.optionals or o.filters)
        if plain and (len(o.patterns) == 1 or self.optional == "progressive"):
            return self.progressive(rows, o.patterns)
        right = self.group(Group(o.patterns, o.values, o.unions, o.optionals))
        mark = self.unique()
        right.df = right.df.withColumn(mark, F.lit(1))
        if not o.filters:
            return self.join(rows, right, "left")
        # a filter inside of the optional group sees both sides: extend, test, and bring back the rows without any
        rows, key = self.keyed(rows)
        both = self.join(Rows(rows.df, {**rows.names, "": key}, rows.maybe, rows.extras), right)
        for f in o.filters:
            both.df = both.df.where(Expressions(self.spark, both.names, both.extras, self.functions).truth(f))
        bare = rows.df.join(both.df.select(key).distinct(), key, "left_anti")
        out = both.df.unionByName(bare, allowMissingColumns=True).drop(key)
        names = {v: c for v, c in both.names.items() if v}
        return Rows(out, names, rows.maybe | {v for v in names if v not in rows.names}, both.extras)

    def keyed(self, rows: Rows) -> tuple[Rows, str]:
        """With the row itself as a key: equal rows are extended alike, so they may share it."""
        key, columns = self.unique(), [x for c in rows.columns() for x in (F.col(c), F.col(c).isNull())]
        # two hashes of 64 bits, with which of the columns are null: the key of a shuffle is 16 bytes, whatever the row is
        value = F.struct(F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns))
        return Rows(rows.df.withColumn(key, value), rows.names, rows.maybe, rows.extras), key

    def progressive(self, rows: Rows, patterns: list[Pattern]) -> Rows:
        """One pattern is a left join. Of several, each that matches for some extension of a row replaces the row's
        extensions by the matching ones; one that matches for none is passed over."""
        if len(patterns) == 1:
            return self.optional_join(rows, self.pattern(patterns[0]))[0]
        rows, key = self.keyed(rows)
        inner = Rows(rows.df, {**rows.names, "": key}, rows.maybe, rows.extras)
        for p in patterns:
            inner, mark = self.optional_join(inner, self.pattern(p))
            any_ = self.unique()
            df = inner.df.withColumn(any_, F.max(mark).over(Window.partitionBy(key)))
            inner.df = df.where(F.col(mark).isNotNull() | F.col(any_).isNull()).drop(mark, any_)
        inner.names.pop("")
        inner.df = inner.df.drop(key)
        return inner

    def optional_join(self, rows: Rows, right: Rows) -> tuple[Rows, str]:
        """Left join, and the column that is null where nothing matched."""
        mark = self.unique()
        marked = Rows(right.df.withColumn(mark, F.lit("1")), {**right.names, f" {mark}": mark}, right.maybe, right.extras)
        out = self.join(rows, marked, "left")
        out.names.pop(f" {mark}")
        out.maybe.discard(f" {mark}")
        return out, mark

    # the whole query

    def select(self, q: Select) -> DataFrame:
        self.asked = {a.name for f in q.where.all_filters() for a in _asked(f)}
        rows = self.group(q.where)
        c = {v: F.col(rows.names[v]) if v in rows.names else F.lit(None).cast("string") for v in [*rows.names, *q.variables, *q.group_by, *(a.variable for a in q.aggregates), *(v for v, _ in q.order_by)]}
        if q.aggregates:
            df = self.aggregate(rows.df, q, c)
        else:
            names = list(dict.fromkeys(q.variables))
            more = [v for v, _ in q.order_by if v not in names and not q.distinct]
            df = rows.df.select(*[c[v].alias(v) for v in names + more])
            if q.distinct:
                # unbound and "" are one
                keys = [F.coalesce(F.col(f"`{v}`"), F.lit("")).alias(f"k{i}") for i, v in enumerate(names)]
                wide = df.select(*keys, *[F.col(f"`{v}`").alias(f"d{i}") for i, v in enumerate(names)])
                df = wide.groupBy(*[f"k{i}" for i in range(len(names))]).agg(*[F.max(f"d{i}").alias(v) for i, v in enumerate(names)]).select(*[F.col(f"`{v}`") for v in names])
        if q.order_by:
            df = df.orderBy(*[x for v, up in q.order_by for x in _ordered(v, up)], *[F.col(f"`{n}`").asc_nulls_first() for n in df.columns])
        elif q.limit or q.offset:
            df = df.orderBy(*[F.col(f"`{n}`").asc_nulls_first() for n in df.columns])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit:
            df = df.limit(q.limit)
        return df.select(*[F.col(f"`{v}`") for v in q.variables]) if not q.aggregates and df.columns != q.variables else df

    def aggregate(self, df: DataFrame, q: Select, c: dict[str, Column]) -> DataFrame:
        keys = {f"g{i}": F.coalesce(c[v], F.lit("")) for i, v in enumerate(q.group_by)}
        kept = [v for v in q.variables if v not in {a.alias for a in q.aggregates}]
        used = list(dict.fromkeys([*kept, *(a.variable for a in q.aggregates if a.variable != "*")]))
        base = df.select(*[k.alias(n) for n, k in keys.items()], *[c[v].alias(f"u{i}") for i, v in enumerate(used)])
        at = {v: F.col(f"u{i}") for i, v in enumerate(used)}
        # sums and means of distinct strings: "1" and "1.0" both count, so strings are made distinct first
        apart = [a for a in q.aggregates if a.distinct and a.function in ("SUM", "AVG")]
        plain = [a for a in q.aggregates if a not in apart]
        columns = [F.min(at[v]).alias(f"k{i}") for i, v in enumerate(kept)] + [_aggregate(a, at).alias(f"a{q.aggregates.index(a)}") for a in plain]
        out = base.groupBy(*keys).agg(*(columns or [F.count(F.lit(1)).alias("n")]))
        for a in apart:
            once = base.select(*keys, at[a.variable].alias("x")).distinct().groupBy(*keys).agg(_aggregate(a, {a.variable: F.col("x")}).alias(f"a{q.aggregates.index(a)}"))
            # both sides have one row for each key, or one row
            out = out.join(once, list(keys)) if keys else out.crossJoin(once)
        named = [F.col(f"k{i}").alias(v) for i, v in enumerate(kept)] + [F.col(f"a{i}").alias(a.alias) for i, a in enumerate(q.aggregates)]
        return out.select(*named)


def _aggregate(a: Aggregate, at: dict[str, Column]) -> Column:
    if a.variable == "*":
        return F.count(F.lit(1)).cast("string")
    x = at[a.variable]
    match a.function:
        case "COUNT":
            return (F.count_distinct(x) if a.distinct else F.count(x)).cast("string")
        case "SUM":
            return show(F.coalesce(F.sum(number(x)), F.lit(0.0)))
        case "AVG":
            return show(F.coalesce(F.avg(number(x)), F.lit(0.0)))
        case "MIN":
            return F.coalesce(show(F.min(number(x))), F.min(x), F.lit(""))
        case _:
            return F.coalesce(show(F.max(number(x))), F.max(x), F.lit(""))


def _ordered(v: str, up: bool) -> list[Column]:
    c = F.col(f"`{v}`")
    return [number(c).asc_nulls_first(), c.asc_nulls_first()] if up else [number(c).desc_nulls_last(), c.desc_nulls_last()]


def _asked(e: Call | Term) -> list[Var]:
    if not isinstance(e, Call):
        return []
    own = [a for a in e.args if isinstance(a, Var)] if e.name in ("lang", "datatype") else []
    return [*own, *(v for a in e.args for v in _asked(a))]
