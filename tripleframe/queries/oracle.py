"""The virtual triples in SQL, for the queries' oracle."""

from __future__ import annotations

from collections.abc import Iterable

from tripleframe.mapping import HOLE, Fact

TABLES = {"conversations": "(SELECT *, CASE WHEN turn > 0 THEN turn - 1 END AS before FROM conversations)"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str) -> str:
    parts, at = [], 0
    for m in HOLE.finditer(template):
        parts += [quoted(template[at : m.start()])] * (m.start() > at) + [f"CAST({m[1]} AS VARCHAR)"]
        at = m.end()
    parts += [quoted(template[at:])] * (at < len(template) or not parts)
    return " || ".join(parts)


def cte(facts: Iterable[Fact], *predicates: str, more: str = "") -> str:
    """WITH t(s, p, o, lit, dt): the facts with the predicates, or all of them."""
    rows = []
    for f in facts:
        if predicates and f.predicate not in predicates:
            continue
        test = f" WHERE {f.where}" if f.where else ""
        rows.append(f"SELECT {filled(f.subject)} AS s, {quoted(f.predicate)} AS p, {filled(f.object)} AS o, {str(f.literal).lower()} AS lit, {quoted(f.datatype) if f.datatype else 'NULL'} AS dt FROM {TABLES.get(f.table, f.table)}{test}")
    body = "\nUNION ALL ".join(rows)
    return f"WITH {'RECURSIVE ' if 'closure' in more else ''}t AS (SELECT * FROM (\n{body}) WHERE s IS NOT NULL AND o IS NOT NULL){', ' + more if more else ''}\n"
