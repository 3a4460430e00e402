"""RDF/XML to triples."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from tripleframe.model import RDF, TYPE
from tripleframe.sources.turtle import ParseError, salt_of

LANG = "{http://www.w3.org/XML/1998/namespace}lang"
DEEPEST = 50
SYNTAX = {"about", "ID", "nodeID", "resource", "datatype", "parseType", "RDF", "Description", "li"}


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class Reader:
    def __init__(self, text: str, source: str = ""):
        self.text, self.salt = text, salt_of(text, source)
        self.count = 0
        self.rows: list[dict] = []

    def add(self, s: str, p: str, o: str, literal: bool = False, datatype: str | None = None, language: str | None = None, direction: str | None = None) -> None:
        self.rows.append({"subject": s, "predicate": p, "object": o, "is_literal": literal, "datatype": datatype, "language": language, "direction": direction, "is_triple_term": False, "reifier": None, "pos": len(self.rows)})

    def parse(self) -> list[dict]:
        try:
            root = ET.fromstring(self.text)
        except (ET.ParseError, ValueError) as e:
            raise ParseError(f"not XML: {e}") from e
        for node in root if _name(root.tag) == RDF + "RDF" else [root]:
            self.node(node, root.get(LANG), 1)
        return self.rows

    def subject(self, e: ET.Element) -> str:
        for key in ("about", None, "ID", "nodeID"):
            value = e.get("about") if key is None else e.get(f"{{{RDF}}}{key}")
            if value is not None:
                return {"ID": "#", "nodeID": "_:"}.get(key, "") + value
        self.count += 1
        return f"_:b{self.salt}_{self.count}"

    def node(self, e: ET.Element, language: str | None, depth: int) -> str:
        if depth > DEEPEST:
            raise ParseError(f"nodes are nested more than {DEEPEST} deep")
        language, subject = e.get(LANG, language), self.subject(e)
        if _name(e.tag) != RDF + "Description":
            self.add(subject, TYPE, _name(e.tag))
        for key, value in e.attrib.items():
            name = _name(key)
            if key == LANG or key == "about" or not key.startswith("{") or name.startswith(RDF) and name[len(RDF) :] in SYNTAX:
                continue
            if name == TYPE:
                self.add(subject, TYPE, value)
            else:
                self.text_of(subject, name, value, None, language if e.get(LANG) else None)
        for p in e:
            self.property(subject, p, e.get(LANG), depth)
        return subject

    def property(self, subject: str, e: ET.Element, language: str | None, depth: int) -> None:
        name = _name(e.tag)
        link, ident = e.get(f"{{{RDF}}}resource"), e.get(f"{{{RDF}}}nodeID")
        if link is not None or ident is not None:
            self.add(subject, name, link if link is not None else f"_:{ident}")
        elif len(e):
            # the first nested node alone
            self.add(subject, name, self.node(e[0], e.get(LANG, language), depth + 1))
        elif text := (e.text or "").strip():
            self.text_of(subject, name, text, e.get(f"{{{RDF}}}datatype"), e.get(LANG, language))

    def text_of(self, subject: str, name: str, text: str, datatype: str | None, tag: str | None) -> None:
        """Text with a datatype or a language is a literal; plain text is not marked as one."""
        if datatype:
            self.add(subject, name, text, True, datatype)
        elif tag:
            language, _, direction = tag.partition("--")
            self.add(subject, name, text, True, RDF.dirLangString if direction else RDF.langString, language, direction or None)
        else:
            self.add(subject, name, text)


def parse_triples(text: str, source: str = "") -> list[dict]:
    return Reader(text, source).parse()
