"""The parsed query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    language: str | None = None
    datatype: str | None = None
    number: bool = False


Term = Var | Iri | Literal


@dataclass(frozen=True)
class Pattern:
    subject: Term
    predicate: Term
    object: Term

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in (self.subject, self.predicate, self.object) if isinstance(t, Var)))


@dataclass(frozen=True)
class Call:
    """An operator or function on expressions; operators are named by their signs."""

    name: str
    args: tuple[Call | Term, ...]


@dataclass(frozen=True)
class Values:
    variables: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass
class Group:
    """A group graph pattern, evaluated in this order: patterns, values, unions, optionals, filters."""

    patterns: list[Pattern] = field(default_factory=list)
    values: list[Values] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    filters: list[Call | Term] = field(default_factory=list)

    def variables(self) -> list[str]:
        """In order of first sight: patterns, optionals, unions, values."""
        out = [v for p in self.patterns for v in p.variables()]
        out += [v for g in self.optionals for v in g.variables()]
        out += [v for u in self.unions for g in u for v in g.variables()]
        out += [v for x in self.values for v in x.variables]
        return list(dict.fromkeys(out))

    def all_patterns(self) -> list[Pattern]:
        inner = [*self.optionals, *(g for u in self.unions for g in u)]
        return [*self.patterns, *(p for g in inner for p in g.all_patterns())]

    def all_filters(self) -> list[Call | Term]:
        inner = [*self.optionals, *(g for u in self.unions for g in u)]
        return [*self.filters, *(f for g in inner for f in g.all_filters())]


@dataclass(frozen=True)
class Aggregate:
    function: str
    variable: str
    alias: str
    distinct: bool = False


@dataclass
class Select:
    variables: list[str]
    where: Group
    aggregates: list[Aggregate] = field(default_factory=list)
    distinct: bool = False
    group_by: list[str] = field(default_factory=list)
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    limit: int = 0
    offset: int = 0
