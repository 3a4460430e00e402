"""Pages that document an ontology."""

from __future__ import annotations

import html
import shutil
from pathlib import Path

from pyspark.sql import DataFrame

from tripleframe.operators.graphview import GraphView
from tripleframe.operators.metadata import classes, counts, properties, schemes
from tripleframe.operators.validation import Validator
from tripleframe.sinks.export import graph_parts

PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title></head>
<body><nav><a href="{up}index.html">Overview</a> <a href="{up}classes.html">Classes</a> <a href="{up}properties.html">Properties</a>
<a href="{up}validation.html">Validation</a> <a href="{up}sparql.html">Query</a> <a href="{up}viz/index.html">Graph</a></nav>
<h1>{title}</h1>
{body}
</body></html>
"""
QUERY = """<form action="/api/sparql" method="get"><textarea name="query" rows="8" cols="80">SELECT ?s ?p ?o WHERE { ?s ?p ?o } LIMIT 10</textarea><button>Run</button></form>"""
DRAW = """<form id="filters"><select name="type"><option value="">all types</option></select> <select name="namespace"><option value="">all namespaces</option></select>
<input name="search" placeholder="label"> <span id="shown"></span></form>
<svg id="picture" width="1000" height="700" viewBox="0 0 1000 700"></svg><div id="about"></div>
<script>
const picture = document.getElementById("picture"), filters = document.getElementById("filters"), about = document.getElementById("about");
const shape = (kind, given, text) => {
  const made = document.createElementNS("http://www.w3.org/2000/svg", kind);
  for (const name in given) made.setAttribute(name, given[name]);
  if (text !== undefined) made.textContent = text;
  picture.append(made);
  return made;
};
// places: nodes push each other away, edges pull their ends together, a little less with every step
function placed(nodes, edges) {
  nodes.forEach((n, i) => { n.x = 500 + 300 * Math.cos(2.4 * i) * Math.sqrt((i + 1) / nodes.length); n.y = 350 + 230 * Math.sin(2.4 * i) * Math.sqrt((i + 1) / nodes.length); });
  const rounds = Math.min(150, Math.ceil(3e7 / (nodes.length * nodes.length + 1)));
  for (let step = 0; step < rounds; step++) {
    const heat = 12 * (1 - step / rounds);
    for (const n of nodes) { n.dx = (500 - n.x) * 0.01; n.dy = (350 - n.y) * 0.01; }
    for (let i = 0; i < nodes.length; i++) for (let j = 0; j < i; j++) {
      const p = nodes[i], q = nodes[j], x = p.x - q.x || 0.1, y = p.y - q.y || 0.1, push = 900 / (x * x + y * y);
      p.dx += x * push; p.dy += y * push; q.dx -= x * push; q.dy -= y * push;
    }
    for (const [p, q] of edges) { const x = (q.x - p.x) * 0.02, y = (q.y - p.y) * 0.02; p.dx += x; p.dy += y; q.dx -= x; q.dy -= y; }
    for (const n of nodes) { const far = Math.hypot(n.dx, n.dy) || 1, go = Math.min(far, heat) / far; n.x = Math.max(20, Math.min(980, n.x + n.dx * go)); n.y = Math.max(20, Math.min(680, n.y + n.dy * go)); }
  }
}
function draw(graph) {
  const type = filters.type.value, namespace = filters.namespace.value, search = filters.search.value.toLowerCase();
  const nodes = graph.nodes.filter(n => (!type || n.type === type) && (!namespace || n.namespace === namespace) && n.label.toLowerCase().includes(search));
  const known = new Map(nodes.map(n => [n.id, n]));
  const links = graph.edges.filter(e => known.has(e.source) && known.has(e.target));
  document.getElementById("shown").textContent = nodes.length + " nodes, " + links.length + " edges";
  picture.replaceChildren();
  placed(nodes, links.map(e => [known.get(e.source), known.get(e.target)]));
  for (const e of links) { const p = known.get(e.source), q = known.get(e.target); shape("line", {x1: p.x, y1: p.y, x2: q.x, y2: q.y, stroke: "#999"}); shape("text", {x: (p.x + q.x) / 2, y: (p.y + q.y) / 2, "font-size": 8, fill: "#777"}, e.label); }
  for (const n of nodes) {
    const dot = shape("circle", {cx: n.x, cy: n.y, r: 6, fill: "hsl(" + 67 * graph.types.indexOf(n.type) + " 60% 45%)"});
    shape("text", {x: n.x + 8, y: n.y + 4, "font-size": 11}, n.label);
    dot.onclick = () => { about.textContent = n.id + " (" + (n.type || "untyped") + ") " + n.comment; };
  }
}
fetch("graph.json").then(answer => answer.json()).then(graph => {
  for (const [name, values] of [["type", graph.types], ["namespace", graph.namespaces]]) for (const v of values) filters[name].add(new Option(v || "untyped", v));
  filters.oninput = () => draw(graph);
  draw(graph);
});
</script>"""


def _links(values: list[str], page: str, known: set[str]) -> str:
    """Names, with links where the page has them."""
    return ", ".join(f'<a href="{page}#{html.escape(v, quote=True)}">{html.escape(v)}</a>' if v in known else html.escape(v) for v in values)


def _details(rows: list[tuple[str, str, str, str, dict[str, str]]]) -> str:
    """A section for each (name, uri, label, description, further lines as HTML)."""
    out = []
    for name, uri, label, description, more in rows:
        lines = "".join(f"<dt>{html.escape(k)}</dt><dd>{v}</dd>" for k, v in more.items() if v)
        said = f"<p>{html.escape(description)}</p>" if description else ""
        out.append(f'<section id="{html.escape(name, quote=True)}"><h2>{html.escape(label or name)}</h2><code>{html.escape(uri)}</code>{said}<dl>{lines}</dl></section>')
    return "".join(out)


def _table(names: list[str], rows: list) -> str:
    def show(x) -> str:
        return html.escape(", ".join(x) if isinstance(x, list) else str(x))

    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{show(r[n])}</td>" for n in names) + "</tr>" for r in rows) + "</table>"


class Renderer:
    """Metadata is collected: a vocabulary's pages are for reading."""

    def __init__(self, triples: DataFrame, title: str = "Ontology"):
        self.triples, self.title = triples, title
        self.classes, self.properties, self.schemes = (f(triples).orderBy("uri") for f in (classes, properties, schemes))
        self.report = Validator(triples).validate()

    def _class_page(self) -> str:
        own, links = self.classes.collect(), self.properties.collect()
        known, names = {c.name for c in own}, {p.name for p in links}
        below: dict[str, list[str]] = {}
        for c in own:
            for above in c.super_classes:
                below.setdefault(above, []).append(c.name)
        by = {side: {} for side in ("domain", "range")}
        for p in links:
            for side, found in by.items():
                for uri in p[side]:
                    found.setdefault(uri, []).append(p.name)
        table = _table(["name", "label", "description", "super_classes"], own)
        return table + _details([
            (c.name, c.uri, c.label, c.description, {
                "Superclasses": _links(c.super_classes, "classes.html", known), "Subclasses": _links(below.get(c.name, []), "classes.html", known),
                "Properties": _links(by["domain"].get(c.uri, []), "properties.html", names), "Property values": _links(by["range"].get(c.uri, []), "properties.html", names),
            })
            for c in own
        ])

    def _property_page(self) -> str:
        own, known = self.properties.collect(), {c.name: c.uri for c in self.classes.collect()}
        uris = {u: n for n, u in known.items()}
        ends = lambda values: _links([uris.get(v, v) for v in values], "classes.html", set(known))
        table = _table(["name", "label", "description", "domain", "range"], own)
        return table + _details([
            (p.name, p.uri, p.label, p.description, {"Kind": "datatype property" if p.is_datatype else "property", "Domain": ends(p.domain), "Range": ends(p.range)}) for p in own
        ])

    def render(self, folder: str) -> list[str]:
        at = Path(folder)
        (at / "viz").mkdir(parents=True, exist_ok=True)
        pages = {
            "index.html": (self.title, _table(["what", "n"], counts(self.triples).collect()) + _table(["name", "label", "top_concepts"], self.schemes.collect())),
            "classes.html": ("Classes", self._class_page()),
            "properties.html": ("Properties", self._property_page()),
            "validation.html": ("Validation", _table(["severity", "type", "subject", "message"], self.report.ordered().collect())),
            "sparql.html": ("Query", QUERY),
            "viz/index.html": ("Graph", DRAW),
        }
        for name, (title, body) in pages.items():
            (at / name).write_text(PAGE.format(title=html.escape(title), body=body, up="../" if "/" in name else ""), encoding="utf-8")
        with (at / "viz/graph.json").open("w", encoding="utf-8") as file:
            file.writelines(graph_parts(GraphView(self.triples, site=True)))
        return sorted([*pages, "viz/graph.json"])


def copy_file(source: str, target: str) -> None:
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
