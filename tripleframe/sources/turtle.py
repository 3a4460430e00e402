"""Turtle, as triples and as statements with their places in the text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from tripleframe.model import RDF, TYPE, XSD


def salt_of(text: str, source: str) -> str:
    """96 bits of a hash, which two of any number of files do not share."""
    return hashlib.sha256(f"{source}\0{text}".encode("utf-8", "surrogatepass")).hexdigest()[:24]


class ParseError(ValueError):
    """The text is not of the format."""


TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+)
    |(?P<comment>\#[^\n]*)
    |(?P<open><<\(?)
    |(?P<close>\)?>>)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@(?:prefix|base)\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)
    |(?P<number>[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>\^\^|[.;,()\[\]])""",
    re.VERBOSE | re.DOTALL,
)
#: other escapes stay as they are
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}


def unquote(text: str) -> str:
    n = 3 if text[:3] in ('"""', "'''") else 1
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), text[n:-n], flags=re.DOTALL)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(text: str) -> Iterator[Token]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"line {text.count(chr(10), 0, at) + 1}: cannot read {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            yield Token(m.lastgroup, m[0], m.start(), m.end())
        at = m.end()
    yield Token("end", "", len(text), len(text))


@dataclass(frozen=True)
class Node:
    """A term: kind is iri, pname, bnode, literal or collection."""

    kind: str
    value: str
    datatype: str | None = None
    language: str | None = None
    direction: str | None = None
    triple_term: bool = False
    start: int = 0
    end: int = 0

    def __str__(self) -> str:
        if self.kind == "literal":
            tag = f"@{self.language}" + (f"--{self.direction}" if self.direction else "") if self.language else f"^^<{self.datatype}>" if self.datatype else ""
            return f'"{self.value}"{tag}'
        return f"<{self.value}>" if self.kind == "iri" else self.value


class Reader:
    """What both parsers share: tokens, prefixes, literals."""

    integer, decimal, double = XSD.integer, XSD.decimal, XSD.double

    def __init__(self, text: str):
        self.text = text
        self.comments: list[Token] = []
        self.tokens = [t for t in tokens(text) if t.kind != "comment" or self.comments.append(t)]
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def next(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def sign(self, text: str) -> bool:
        if self.now.kind == "sign" and self.now.text == text:
            self.at += 1
            return True
        return False

    def fail(self, wanted: str) -> ParseError:
        t = self.now
        return ParseError(f"line {self.text.count(chr(10), 0, t.start) + 1}: expected {wanted}, not {t.text or 'the end'!r}")

    def directive(self) -> bool:
        t = self.now
        name = t.text.lstrip("@").lower()
        if not (t.kind == "directive" or t.kind == "word" and name in ("prefix", "base")):
            return False
        self.next()
        if name == "prefix":
            p = self.next()
            if p.kind != "pname" or not p.text.endswith(":"):
                raise self.fail("a prefix")
        iri = self.next()
        if iri.kind != "iri":
            raise self.fail("an address")
        if name == "prefix":
            self.prefixes[p.text[:-1]] = iri.text[1:-1]
        else:
            self.base = iri.text[1:-1]
        if t.text.startswith("@") and not self.sign("."):
            raise self.fail("'.'")
        self.sign(".")
        return True

    def expand(self, pname: str) -> str:
        prefix, _, local = pname.partition(":")
        if prefix not in self.prefixes:
            raise ParseError(f"prefix {prefix!r} is not declared")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def literal(self) -> Node:
        t = self.next()
        if t.kind == "number":
            kind = self.double if re.search("[eE]", t.text) else self.decimal if "." in t.text else self.integer
            return Node("literal", t.text, kind, start=t.start, end=t.end)
        if t.kind == "word":
            return Node("literal", t.text, XSD.boolean, start=t.start, end=t.end)
        value = unquote(t.text)
        if self.now.kind == "lang":
            tag = self.next()
            language, _, direction = tag.text[1:].partition("--")
            return Node("literal", value, RDF.dirLangString if direction else RDF.langString, language, direction or None, start=t.start, end=tag.end)
        if self.sign("^^"):
            of = self.next()
            kind = self.resolve(of.text[1:-1]) if of.kind == "iri" else self.expand(of.text)
            return Node("literal", value, kind, start=t.start, end=of.end)
        return Node("literal", value, XSD.string, start=t.start, end=t.end)

    def resolve(self, iri: str) -> str:
        return iri


class TripleParser(Reader):
    """Turtle with RDF 1.2 triple terms, to triples.

    Addresses without :// are put after the base. Numbers without a dot are decimals, others doubles. Generated blank
    nodes carry a hash of the text and where it is from, so that those of several files stay apart.
    """

    def __init__(self, text: str, source: str = ""):
        super().__init__(text)
        self.salt = salt_of(text, source)
        self.count = 0
        self.out: list[tuple[str, str, Node]] = []

    def resolve(self, iri: str) -> str:
        return self.base + iri if self.base and "://" not in iri else iri

    def fresh(self) -> Node:
        self.count += 1
        return Node("bnode", f"_:tb{self.salt}_{self.count}")

    def parse(self) -> list[tuple[str, str, Node]]:
        while self.now.kind != "end":
            if self.directive():
                continue
            bracket = self.now.kind == "sign" and self.now.text == "["
            subject = self.subject()
            if not (bracket and self.now.kind == "sign" and self.now.text == "."):
                self.predicates(subject.value)
            if not self.sign("."):
                raise self.fail("'.'")
        return self.out

    def subject(self) -> Node:
        if self.now.kind in ("iri", "pname", "bnode", "open") or self.now.kind == "sign" and self.now.text == "[":
            return self.term()
        raise self.fail("a subject")

    def predicates(self, subject: str) -> None:
        while True:
            predicate = self.predicate()
            while True:
                self.out.append((subject, predicate, self.term()))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                return
            while self.sign(";"):
                pass
            if self.now.kind == "sign" and self.now.text in ".]":
                return

    def predicate(self) -> str:
        t = self.now
        if t.kind == "word" and t.text == "a":
            self.next()
            return TYPE
        if t.kind not in ("iri", "pname"):
            raise self.fail("a predicate")
        self.next()
        return self.resolve(t.text[1:-1]) if t.kind == "iri" else self.expand(t.text)

    def term(self) -> Node:
        t = self.now
        if t.kind == "iri":
            self.next()
            return Node("iri", self.resolve(t.text[1:-1]))
        if t.kind == "pname":
            self.next()
            return Node("iri", self.expand(t.text))
        if t.kind == "bnode":
            self.next()
            return Node("bnode", t.text)
        if t.kind == "open":
            return self.triple_term()
        if self.sign("["):
            node = self.fresh()
            if not self.sign("]"):
                self.predicates(node.value)
                if not self.sign("]"):
                    raise self.fail("']'")
            return node
        if self.sign("("):
            return self.collection()
        if t.kind in ("string", "number") or t.kind == "word" and t.text in ("true", "false"):
            node = self.literal()
            if t.kind == "number":
                return Node("literal", node.value, XSD.double if "." in node.value else XSD.decimal)
            return node
        raise self.fail("a term")

    def collection(self) -> Node:
        items = []
        while not self.sign(")"):
            if self.now.kind == "end":
                raise self.fail("')'")
            items.append(self.term())
        cells = [self.fresh() for _ in items]
        for cell, item, rest in zip(cells, items, [*cells[1:], Node("iri", RDF.nil)]):
            self.out += [(cell.value, RDF.first, item), (cell.value, RDF.rest, rest)]
        return cells[0] if cells else Node("iri", RDF.nil)

    def triple_term(self) -> Node:
        closing = {"<<": ">>", "<<(": ")>>"}[self.next().text]
        subject, predicate, obj = self.term(), self.predicate(), self.term()
        if self.now.kind != "close" or self.now.text != closing:
            raise self.fail(closing)
        self.next()
        node = self.fresh()
        self.out += [(node.value, RDF + "subject", subject), (node.value, RDF + "predicate", Node("iri", predicate)), (node.value, RDF + "object", obj)]
        return Node("bnode", node.value, triple_term=True)


def parse_triples(text: str, source: str = "") -> list[dict]:
    """Rows of TRIPLE_SCHEMA, without graph."""
    return [
        {"subject": s, "predicate": p, "object": o.value, "is_literal": o.kind == "literal", "datatype": o.datatype, "language": o.language, "direction": o.direction, "is_triple_term": o.triple_term, "reifier": None, "pos": i}
        for i, (s, p, o) in enumerate(TripleParser(text, source).parse())
    ]


@dataclass(frozen=True)
class Statement:
    subject: Node
    predicate: Node
    object: Node
    start: int
    end: int


@dataclass
class Document:
    """Positions are bytes. All statements of a ';' group begin where their subject does."""

    text: str
    prefixes: dict[str, str] = field(default_factory=dict)
    statements: list[Statement] = field(default_factory=list)
    comments: list[Token] = field(default_factory=list)

    def value(self, n: Node) -> str:
        """What a term stands for; "" for a collection."""
        if n.kind == "collection":
            return ""
        if n.kind == "pname":
            prefix, _, local = n.value.partition(":")
            known = self.prefixes.get(prefix, RDF if prefix == "rdf" else None)
            return known + local if known is not None else n.value
        return n.value

    def __str__(self) -> str:
        heads = [f"@prefix {p}: <{iri}> ." for p, iri in self.prefixes.items()]
        return "\n".join([*heads, *(f"{s.subject} {s.predicate} {s.object} ." for s in self.statements)])

    def walk(self, order: str = "pre") -> Iterator[tuple[str, object]]:
        """(kind, item) of the document, prefixes, statements with their terms, and comments."""
        if order == "pre":
            yield "document", self
        for p in self.prefixes.items():
            yield "prefix", p
        for s in self.statements:
            if order == "pre":
                yield "statement", s
            yield from (("term", t) for t in (s.subject, s.predicate, s.object))
            if order != "pre":
                yield "statement", s
        for c in self.comments:
            yield "comment", c
        if order != "pre":
            yield "document", self


class DocumentParser(Reader):
    """The positioned reading: base is read and not used, what is in [ ] is skipped, a collection is one term, a missing
    last '.' is let pass; no triple terms."""

    def parse(self) -> Document:
        doc = Document(self.text)
        offset = self._bytes()
        while self.now.kind != "end":
            if self.directive():
                continue
            subject, start = self.term(offset), offset(self.now.start)
            start = subject.start
            while True:
                predicate = self.term(offset)
                while True:
                    obj = self.term(offset)
                    doc.statements.append(Statement(subject, predicate, obj, start, obj.end))
                    if not self.sign(","):
                        break
                if not self.sign(";"):
                    break
                while self.sign(";"):
                    pass
                if self.now.kind == "end" or self.now.kind == "sign" and self.now.text == ".":
                    break
            if not self.sign(".") and self.now.kind != "end":
                raise self.fail("'.'")
        doc.prefixes = dict(self.prefixes)
        doc.comments = self.comments
        return doc

    def _bytes(self):
        if self.text.isascii():
            return lambda i: i
        places = [0]
        for c in self.text:
            places.append(places[-1] + len(c.encode("utf-8", "surrogatepass")))
        return places.__getitem__

    def term(self, offset) -> Node:
        t = self.now
        where = {"start": offset(t.start), "end": offset(t.end)}
        if t.kind in ("iri", "pname", "bnode"):
            self.next()
            return Node(t.kind, t.text[1:-1] if t.kind == "iri" else t.text, **where)
        if t.kind == "word" and t.text == "a":
            self.next()
            return Node("pname", "rdf:type", **where)
        if t.kind in ("string", "number") or t.kind == "word" and t.text in ("true", "false"):
            n = self.literal()
            return Node("literal", n.value, n.datatype, n.language, n.direction, start=offset(n.start), end=offset(n.end))
        for opening, closing, kind in (("[", "]", "bnode"), ("(", ")", "collection")):
            if t.kind == "sign" and t.text == opening:
                depth = 0
                while True:
                    u = self.next()
                    if u.kind == "end":
                        raise self.fail(repr(closing))
                    depth += (u.kind == "sign") * ((u.text == opening) - (u.text == closing))
                    if not depth:
                        return Node(kind, f"_:b{offset(t.start)}" if kind == "bnode" else "()", start=offset(t.start), end=offset(u.end))
        raise self.fail("a term")


def parse_document(text: str) -> Document:
    return DocumentParser(text).parse()


def parse_statements(text: str, file: str = "") -> list[dict]:
    """Rows of STATEMENT_SCHEMA; line and column are of the statement's start, from 1, columns in bytes."""
    doc, raw = parse_document(text), text.encode("utf-8", "surrogatepass")
    rows = []
    for i, s in enumerate(doc.statements):
        line = raw.count(b"\n", 0, s.start) + 1
        rows.append({"file": file, "seq": i, "subject": doc.value(s.subject), "predicate": doc.value(s.predicate), "object": doc.value(s.object), "kind": s.object.kind, "pos": s.start, "end": s.end, "line": line, "col": s.start - (raw.rfind(b"\n", 0, s.start) + 1) + 1})
    return rows
